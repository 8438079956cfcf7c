"""Queries that read real files of each kind: written around the texts of documents by specimens, read by the importers."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import scalars as s, status
from ..operators import geometry, structure, updates, validation
from ..shipping import ship_code
from ..sources import convert, reader
from . import specimens
from .catalogue import normalize_duration, query, table


def _written(spark: SparkSession, sf_dir: str, write: Callable[[bytes], bytes]) -> DataFrame:
    """project_id, content: a file for each document."""
    ship_code(spark)

    @F.pandas_udf("binary")
    def run(text: pd.Series) -> pd.Series:
        return pd.Series([write((t or "").encode()) for t in text])

    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("project_id"), run("text").alias("content"))


def _held(rgba: Column) -> Column:
    """The md5 of the text that a picture holds; the picture is evaluated once."""
    size = lambda p: sum((F.conv(F.hex(F.substring(p, k + 1, 1)), 16, 10).cast("int") * 256**k for k in range(4)), F.lit(0))
    return F.element_at(F.transform(F.array(rgba), lambda p: F.md5(F.substring(p, F.lit(5), size(p)))), 1)


def _summary(rows: DataFrame, layer: int = 0, pixels: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """For each project: frames, their time, layers, what the first cel of a layer holds, the first pixels of the last cel, and an error."""
    of = lambda kind, value: F.when(F.col("kind") == kind, value)
    words = F.concat_ws(":", "name", F.col("visible").cast("string"), F.col("opacity").cast("string"))
    first = (F.col("layer_index") == layer) & (F.col("frame_index") == 0)
    narrow = rows.select(
        "project_id", "kind", "duration_ms", "layer_index", "frame_index", "code", "width", "height", of("layers", words).alias("layer"),
        of("cels", F.when(first, _held(pixels(F.col("rgba"))))).alias("value"), of("cels", F.hex(F.substring("rgba", 1, 24))).alias("start"),
    )
    layers = F.array_sort(F.collect_list(F.when(F.col("layer").isNotNull(), F.struct("layer_index", "layer"))))
    return narrow.groupBy("project_id").agg(
        F.count_if(F.col("kind") == "frames").alias("frames"), F.sum("duration_ms").alias("total_ms"), F.concat_ws(",", F.transform(layers, lambda x: x["layer"])).alias("layers"),
        F.max("value").alias("value"), F.max_by("start", F.when(F.col("start").isNotNull(), F.struct("layer_index", "frame_index"))).alias("last_start"), F.max("code").alias("error"), F.max("width").alias("width"),
    )


def _sql(frames: int, total: int, layers: str, last: str, width: int = specimens.SIDE) -> str:
    """last: SQL for the last cel's first 24 bytes, given t (a text) and b, its picture's bytes in hexadecimal, as far as needed."""
    return f"""WITH d AS (SELECT doc_id::VARCHAR AS project_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT *, octet_length(encode(t)) AS n FROM d),
q AS (SELECT *, printf('%02X%02X%02X%02X', n % 256, n // 256 % 256, n // 65536 % 256, n // 16777216) || hex(substr(t, 1, 20)) || repeat('0', 40) AS b FROM p)
SELECT project_id, {frames} AS frames, {total} AS total_ms, '{layers}' AS layers, md5(t) AS value, {last} AS last_start, NULL::VARCHAR AS error, {width} AS width FROM q"""


def _decoded(spark, sf_dir, kind: str, layer: int = 0, pixels: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    files = _written(spark, sf_dir, specimens.WRITERS[kind])
    files = files.select("project_id", F.lit(f"file.{kind}").alias("name"), F.lit(kind).alias("kind"), F.octet_length("content").cast("long").alias("length"), "content")
    return _summary(reader.decode(files), layer, pixels)


_PICTURE, _EMPTY = "substr(b, 1, 48)", "repeat('0', 48)"


@query(_sql(1, 100, "Main:true:255", _PICTURE))
def png_files(spark, sf_dir):
    return _decoded(spark, sf_dir, "png")


@query(_sql(2, 530, "APNG frames:true:255", "substr(b, 1, 8) || '01020304' || substr(b, 17, 32)"))
def apng_files(spark, sf_dir):
    return _decoded(spark, sf_dir, "apng")


def _coloured(at: int) -> str:
    byte = f"('0x' || substr(b, {2 * at + 1}, 2))::INT"
    return f"printf('%02X%02X07FF', {byte}, 255 - {byte})"


@query(_sql(2, 120, "GIF frames:true:255", f"{_coloured(0)} || {_coloured(1)} || '09F607FF' || {_coloured(3)} || {_coloured(4)} || {_coloured(5)}"))
def gif_files(spark, sf_dir):
    """Each pixel's red is a byte of the picture."""
    return _decoded(spark, sf_dir, "gif", pixels=lambda rgba: F.unhex(F.regexp_replace(F.hex(rgba), "(..)......", "$1")))


@query(_sql(1, 100, "Ink:true:128,Base:false:255", "'09080706'"))
def ora_files(spark, sf_dir):
    return _decoded(spark, sf_dir, "ora")


@query(_sql(2, 350, "Base:true:128,Ink:false:255", _EMPTY))
def pxo_files(spark, sf_dir):
    return _decoded(spark, sf_dir, "pxo")


@query(_sql(1, 100, "Ink:true:200", _PICTURE))
def kra_files(spark, sf_dir):
    return _decoded(spark, sf_dir, "kra")


@query(_sql(1, 100, "Base:true:255,Ink:false:128", "repeat('0', 24) || '09080706' || repeat('0', 16)"))
def psd_files(spark, sf_dir):
    return _decoded(spark, sf_dir, "psd")


@query(_sql(2, 200, "Ink:true:255", _EMPTY))
def piskel_files(spark, sf_dir):
    return _decoded(spark, sf_dir, "piskel")


@query(_sql(1, 90, "Base:true:128,Ink:true:255", _EMPTY))
def pixil_files(spark, sf_dir):
    return _decoded(spark, sf_dir, "pixil")


def _pairs(spark, sf_dir, writers: dict[str, Callable[[bytes], bytes]], path: str) -> DataFrame:
    """Files of several names for each document, in a folder of its own."""
    out = None
    for name, write in writers.items():
        files = _written(spark, sf_dir, write).select(F.format_string(path, "project_id").alias("folder"), "content")
        files = files.select(F.concat("folder", F.lit(name)).alias("project_id"), F.lit(name.strip("/")).alias("name"), F.lit(name.rpartition(".")[2]).alias("kind"), F.octet_length("content").cast("long").alias("length"), "content")
        out = files if out is None else out.unionByName(files)
    return out


@query(_sql(2, 205, "Main:true:255", "repeat('0', 40) || '01020304'"))
def atlas_files(spark, sf_dir):
    """Sheet and table of one name: a turned frame, and a trimmed one."""
    rows = reader.atlases(_pairs(spark, sf_dir, {".png": lambda b: specimens.atlas(b)[0], ".json": lambda b: specimens.atlas(b)[1]}, "%s"), 125)
    return _summary(rows)


@query(_sql(3, 240, "Main:true:255", _EMPTY))
def sequence_files(spark, sf_dir):
    """Images of a folder in the order of their names, numbers in names by value: f2 before f10."""
    empty = lambda b: specimens.png(0 * specimens.picture(b))
    files = _pairs(spark, sf_dir, {"/f10.png": empty, "/f9.png": empty, "/f2.png": specimens.WRITERS["png"]}, "%s")
    return _summary(reader.sequences(files, 80))


@query("SELECT doc_id::VARCHAR AS project_id, true AS refused FROM documents")
def cut_off_files(spark, sf_dir):
    """A file that lacks its last bytes is refused by every importer: rows of errors, no document."""
    out = None
    for kind, write in specimens.WRITERS.items():
        files = _written(spark, sf_dir, lambda b, write=write: write(b)[:-5])
        files = files.select("project_id", F.lit(f"file.{kind}").alias("name"), F.lit(kind).alias("kind"), F.octet_length("content").cast("long").alias("length"), "content")
        rows = reader.decode(files).select("project_id", "kind")
        out = rows if out is None else out.unionByName(rows)
    refused = (F.count_if(F.col("kind") == "import_errors") == len(specimens.WRITERS)) & (F.count(F.lit(1)) == len(specimens.WRITERS))
    return out.groupBy("project_id").agg(refused.alias("refused"))


_FAULTS = """WITH pr AS (SELECT c_custkey AS p, c_custkey % 5 AS width, CASE WHEN c_custkey % 7 = 0 THEN 'indexed' ELSE 'rgba' END AS mode FROM customer),
f AS (SELECT o_custkey AS p, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
g AS (SELECT f.*, CASE WHEN place = n - 1 AND p % 4 = 0 THEN place + 1 ELSE place END AS idx, k % 70 AS ms, k % 12 - 1 AS x, k % 13 = 0 AS short, width FROM f JOIN pr USING (p)),
l AS (SELECT p, p % 300 AS opacity, p % 3 = 0 AS blank FROM pr WHERE p % 17 <> 0)
SELECT code, count(*) AS n FROM (
  SELECT 'invalid_width' AS code FROM pr WHERE width = 0 UNION ALL SELECT 'invalid_color_mode' FROM pr WHERE mode <> 'rgba'
  UNION ALL SELECT 'invalid_frames' FROM pr WHERE p NOT IN (SELECT p FROM f) UNION ALL SELECT 'invalid_layers' FROM pr WHERE p % 17 = 0
  UNION ALL SELECT 'invalid_frame_index' FROM g WHERE idx <> place UNION ALL SELECT 'invalid_frame_duration' FROM g WHERE ms = 0
  UNION ALL SELECT 'invalid_frame_tag_name' FROM pr WHERE p % 6 = 0 UNION ALL SELECT 'invalid_frame_tag_direction' FROM pr WHERE p % 10 = 0
  UNION ALL SELECT 'invalid_frame_tag_from' FROM pr WHERE p % 9 = 0
  UNION ALL SELECT 'invalid_frame_tag_reference' FROM pr WHERE p % 9 <> 0 AND p NOT IN (SELECT p FROM g WHERE idx = place AND place = 0)
  UNION ALL SELECT 'invalid_frame_tag_reference' FROM pr WHERE p NOT IN (SELECT p FROM g WHERE idx = place AND place = 2)
  UNION ALL SELECT 'invalid_layer_name' FROM l WHERE blank UNION ALL SELECT 'duplicate_layer_id' FROM l WHERE p % 8 = 0 UNION ALL SELECT 'invalid_layer_opacity' FROM l WHERE opacity > 255
  UNION ALL SELECT 'invalid_cel_frame_reference' FROM g WHERE idx <> place AND p % 17 <> 0 UNION ALL SELECT 'invalid_cel_image_data' FROM g WHERE short AND p % 17 <> 0
  UNION ALL SELECT 'invalid_cel_x' FROM g WHERE x < 0 AND p % 17 <> 0 UNION ALL SELECT 'cel_out_of_bounds' FROM g WHERE NOT short AND x >= 0 AND width > 0 AND x + 1 > width AND p % 17 <> 0) GROUP BY code"""


@query(_FAULTS)
def model_violations(spark, sf_dir):
    """Codes of validation.violations() on a model of customers as projects and orders as frames and cels, faults among them."""
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    p, lit = F.col("c_custkey"), F.lit
    own = p.cast("string").alias("project_id")
    frames = orders.selectExpr("cast(o_custkey as string) as project_id", "o_custkey as p", "o_orderkey as k", "row_number() over (partition by o_custkey order by o_orderkey) - 1 as place", "count(*) over (partition by o_custkey) as n")
    index = F.when((F.col("place") == F.col("n") - 1) & (F.col("p") % 4 == 0), F.col("place") + 1).otherwise(F.col("place")).cast("int")
    layers = customers.where(p % 17 != 0)
    name = F.when(p % 3 == 0, " ").otherwise("Ink")
    one = layers.select(own, lit(0).alias("layer_index"), lit("a").alias("layer_id"), name.alias("name"), lit(True).alias("visible"), (p % 300).cast("int").alias("opacity"))
    two = layers.where(p % 8 == 0).select(own, lit(1).alias("layer_index"), lit("a").alias("layer_id"), lit("Two").alias("name"), lit(True).alias("visible"), lit(9).alias("opacity"))
    cels = frames.where(F.col("p") % 17 != 0).select(
        "project_id", lit(0).alias("layer_index"), F.when(index != F.col("place"), index).otherwise(F.col("place")).cast("int").alias("frame_index"), (F.col("k") % 12 - 1).cast("int").alias("x"), lit(0).alias("y"),
        lit(1).alias("w"), lit(1).alias("h"), lit("srgb").alias("color_space"), F.when(F.col("k") % 13 == 0, F.unhex(lit("010203"))).otherwise(F.unhex(lit("01020304"))).alias("rgba"),
    )
    tags = customers.select(
        own, lit(0).alias("tag_index"), F.when(p % 6 == 0, "").otherwise("walk").alias("name"), F.when(p % 9 == 0, -1).otherwise(0).alias("from_frame"), lit(2).alias("to_frame"), F.when(p % 10 == 0, "sideways").otherwise("forward").alias("direction")
    )
    model = {
        "projects": customers.select(own, lit("made").alias("source_format"), (p % 5).cast("int").alias("width"), lit(8).alias("height"), F.when(p % 7 == 0, "indexed").otherwise("rgba").alias("color_mode")),
        "frames": frames.select("project_id", index.alias("frame_index"), (F.col("k") % 70).cast("int").alias("duration_ms")), "frame_tags": tags, "layers": one.unionByName(two), "cels": cels,
    }
    return validation.violations(model).groupBy("code").agg(F.count(lit(1)).alias("n"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey = 3 THEN 'Ink' ELSE s_name END AS s_name FROM supplier")
def layer_rename(spark, sf_dir):
    """updates.rename_layer() on suppliers as the layers of one project."""
    layers = table(spark, sf_dir, "supplier").select("s_suppkey", F.lit("p").alias("project_id"), F.col("s_suppkey").cast("string").alias("layer_id"), F.col("s_name").alias("name"))
    return updates.rename_layer(layers, "p", "3", "Ink").select("s_suppkey", F.col("name").alias("s_name"))


@query("SELECT event_id, CASE WHEN event_id = 5 THEN 120 ELSE greatest(1, least(65535, floor(value * 1000 / 12 + 0.5)))::INT END AS duration_ms FROM events")
def frame_duration(spark, sf_dir):
    """updates.update_duration() on events as the frames of one project."""
    frames = normalize_duration(spark, sf_dir).select(F.lit("p").alias("project_id"), F.col("event_id").alias("frame_index"), "duration_ms")
    return updates.update_duration(frames, "p", 5, 120).select(F.col("frame_index").alias("event_id"), "duration_ms")


@query("SELECT * FROM (VALUES ('blank name', 'a layer name must not be blank'), ('no layer', 'no layer none'), ('no whole duration', 'a duration must be a whole number of milliseconds from 1 to 65535'), ('no frame', 'no frame -1')) AS v(edit, refused)")
def edit_refusals(spark, sf_dir):
    """What the edits refuse, and why."""
    layers = table(spark, sf_dir, "supplier").select(F.lit("p").alias("project_id"), F.col("s_suppkey").cast("string").alias("layer_id"), F.col("s_name").alias("name"))
    frames = table(spark, sf_dir, "supplier").select(F.lit("p").alias("project_id"), F.col("s_suppkey").alias("frame_index"), F.lit(1).alias("duration_ms"))
    edits = {
        "blank name": lambda: updates.rename_layer(layers, "p", "none", " "), "no layer": lambda: updates.rename_layer(layers, "p", "none", "x"),
        "no whole duration": lambda: updates.update_duration(frames, "p", -1, 1.5), "no frame": lambda: updates.update_duration(frames, "p", -1, 5),
    }
    refused = []
    for name, edit in edits.items():
        try:
            edit()
        except updates.EditError as e:
            refused.append((name, str(e)))
    return spark.createDataFrame(refused, "edit string, refused string")


_MD5S = "md5(t) || md5(t || '1') || md5(t || '2') || md5(t || '3')"


def _pixels_sql(order: list[int]) -> str:
    return " || ".join("repeat('0', 8)" if k < 0 else f"substr(b, {8 * k + 1}, 8)" for k in order)


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), p AS (SELECT doc_id, upper({_MD5S}) AS b FROM d)
SELECT doc_id, {_pixels_sql([9, 10])} AS cropped, {_pixels_sql([4 * c + 3 - r for r in range(4) for c in range(4)])} AS turned, {_pixels_sql([-1] * 6 + [9, 10, -1])} AS placed, regexp_replace(b, '(..)(..)(..)(..)', '\\3\\2\\1\\4', 'g') AS swapped FROM p""")
def pixel_geometry(spark, sf_dir):
    """geometry.crop(), unrotate(), place() and swap_red_blue() on images of 4 x 4 pixels made of each text's digests."""
    ship_code(spark)
    text = F.coalesce("text", F.lit(""))
    image = F.unhex(F.concat(F.md5(text), *[F.md5(F.concat(text, F.lit(str(k)))) for k in (1, 2, 3)]))
    rows = table(spark, sf_dir, "documents").select("doc_id", image.alias("rgba"))
    n = {k: F.lit(k) for k in range(5)}
    rows = rows.withColumn("cropped", geometry.crop("rgba", n[4], n[4], n[1], n[2], n[2], n[1]))
    return rows.select(
        "doc_id", F.hex("cropped").alias("cropped"), F.hex(geometry.unrotate("rgba", n[4], n[4])).alias("turned"),
        F.hex(geometry.place("cropped", n[2], n[1], n[0], n[2], n[3], n[3])).alias("placed"), F.hex(geometry.swap_red_blue("rgba")).alias("swapped"),
    )


@query("""SELECT event_id, value = floor(value) AND value BETWEEN 1 AND 65535 AS whole, event_id % 70000 BETWEEN 1 AND 65535 AS ranged,
  event_id % 4 <> 3 AS named FROM events""")
def valid_values(spark, sf_dir):
    """N2 and N11: durations that are whole and in range, and the names of directions."""
    direction = F.element_at(F.array(*map(F.lit, ("forward", "reverse", "ping-pong", "up"))), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", s.valid_duration(F.col("value")).alias("whole"), s.valid_duration((F.col("event_id") % 70000).cast("double")).alias("ranged"), s.valid_direction(direction).alias("named"))


@query("""SELECT p_partkey, CASE WHEN p_size > 0 AND r > 0 THEN (p_partkey % 512 + 16) // p_size END AS columns, CASE WHEN p_size > 0 AND r > 0 THEN (p_partkey % 300 + 8) // r END AS rows,
  CASE WHEN c > 0 AND r > 0 THEN (p_partkey % 512 + 16) // c END AS frame_width, CASE WHEN c > 0 AND r > 0 THEN (p_partkey % 300 + 8) // r END AS frame_height
FROM (SELECT p_partkey, p_size, p_partkey % 9 AS r, p_partkey % 6 AS c FROM part)""")
def grid_from_size(spark, sf_dir):
    """N17: the grid that frames of a size give, and the size of frames that a grid gives."""
    p = F.col("p_partkey")
    grid = s.grid_from_frame_size(p % 512 + 16, p % 300 + 8, F.col("p_size"), p % 9)
    frame = s.frame_size_from_grid(p % 512 + 16, p % 300 + 8, p % 6, p % 9)
    return table(spark, sf_dir, "part").select("p_partkey", grid.alias("g"), frame.alias("f")).select("p_partkey", "g.*", "f.*")


@query("""SELECT user_id, CASE WHEN NOT (count(*) FILTER (k = 'gif') = 1 AND count(*) = 1) THEN 'invalid-selection' END AS code
FROM (SELECT event_id // 2 AS user_id, CASE event_id % 3 WHEN 0 THEN 'gif' ELSE 'txt' END AS k FROM events) GROUP BY user_id HAVING code IS NOT NULL""")
def refused_selections(spark, sf_dir):
    """S17: groups of files that a mode does not take become rows of errors."""
    i = F.col("event_id")
    files = table(spark, sf_dir, "events").select(F.floor(i / 2).cast("string").alias("project_id"), F.when(i % 3 == 0, "gif").otherwise("txt").alias("kind"))
    return convert.refused(files, "gif").select(F.col("project_id").cast("long").alias("user_id"), "code")


#: JSON of the lists of a project, sound and not, chosen by a document's id: frames, frame tags (a field), layers.
_FRAMES = ("[{}]", "[]", "3", "[{}, 1, null, [0]]", "null", "{}")
_TAGS = ("", '"frameTags": [], ', '"frameTags": null, ', '"frameTags": [{}, "t"], ', '"frameTags": 1, ')
_LAYERS = ('[{"cels": []}]', "[]", "null", '[{"cels": [{}, 2]}, 7, {"cels": {}}, {}, []]', '[null, {"cels": [null, [1], "c"]}]', '{"cels": 1}', '["{}"]')


def _one_of(values: tuple[str, ...]) -> str:
    return f"[{', '.join(repr(v) for v in values)}][doc_id % {len(values)} + 1]"


@query(f"""WITH p AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN text ELSE '{{"name": ' || to_json([text])::VARCHAR || ', "frames": ' || {_one_of(_FRAMES)} || ', ' || {_one_of(_TAGS)} || '"layers": ' || {_one_of(_LAYERS)} || '}}' END AS j FROM documents),
v AS (SELECT doc_id, CASE WHEN json_valid(j) THEN j::JSON END AS v FROM p), r AS (SELECT doc_id, v, coalesce(json_type(v) IN ('OBJECT', 'ARRAY'), false) AS ok FROM v),
l AS (SELECT doc_id, v, json_type(v, '$.frames') AS f, json_type(v, '$.frameTags') AS t, json_type(v, '$.layers') AS y FROM r WHERE ok),
lists AS (SELECT doc_id, 1 AS s, 'invalid_frame' AS code, 'frames' AS name, v->'$.frames[*]' AS x FROM l WHERE f = 'ARRAY' UNION ALL SELECT doc_id, 3, 'invalid_frame_tag', 'frameTags', v->'$.frameTags[*]' FROM l WHERE t = 'ARRAY'
  UNION ALL SELECT doc_id, 5, 'invalid_layer', 'layers', v->'$.layers[*]' FROM l WHERE y = 'ARRAY'),
items AS (SELECT doc_id, s, code, name, unnest(x) AS x, generate_subscripts(x, 1) - 1 AS i FROM lists),
layers AS (SELECT doc_id, x, i FROM items WHERE s = 5 AND json_type(x) IN ('OBJECT', 'ARRAY')),
cels AS (SELECT doc_id, i, unnest(x->'$.cels[*]') AS c, generate_subscripts(x->'$.cels[*]', 1) - 1 AS j FROM layers WHERE json_type(x, '$.cels') = 'ARRAY'),
found AS (SELECT doc_id, 0 AS s, 0 AS i, 0 AS j, 'invalid_project' AS code, 'project' AS path FROM r WHERE NOT ok
  UNION ALL SELECT doc_id, 0, 0, 0, 'invalid_frames', 'frames' FROM l WHERE coalesce(f <> 'ARRAY', true) OR json_array_length(v, '$.frames') = 0
  UNION ALL SELECT doc_id, 2, 0, 0, 'invalid_frame_tags', 'frameTags' FROM l WHERE t <> 'ARRAY'
  UNION ALL SELECT doc_id, 4, 0, 0, 'invalid_layers', 'layers' FROM l WHERE coalesce(y <> 'ARRAY', true) OR json_array_length(v, '$.layers') = 0
  UNION ALL SELECT doc_id, s, i, -1, code, name || '[' || i || ']' FROM items WHERE json_type(x) NOT IN ('OBJECT', 'ARRAY')
  UNION ALL SELECT doc_id, 5, i, -1, 'invalid_cels', 'layers[' || i || '].cels' FROM layers WHERE coalesce(json_type(x, '$.cels') <> 'ARRAY', true)
  UNION ALL SELECT doc_id, 5, i, j, 'invalid_cel', 'layers[' || i || '].cels[' || j || ']' FROM cels WHERE json_type(c) NOT IN ('OBJECT', 'ARRAY'))
SELECT doc_id, code, path, row_number() OVER (PARTITION BY doc_id ORDER BY s, i, j)::INT AS ordinal FROM found""")
def structure_faults(spark, sf_dir):
    """Codes of structure.structure_violations() on JSON that names a document's text, with lists sound and not; some texts stand for JSON themselves."""
    one = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % len(values) + 1).cast("int"))
    name = F.to_json(F.array("text"))
    made = F.concat(F.lit('{"name": '), name, F.lit(', "frames": '), one(_FRAMES), F.lit(", "), one(_TAGS), F.lit('"layers": '), one(_LAYERS), F.lit("}"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 11 == 0, F.col("text")).otherwise(made).alias("json"))
    return structure.structure_violations(rows, "doc_id").select(F.col("project_id").alias("doc_id"), "code", "path", "ordinal")


def _of_mode(field: int, absent: str) -> str:
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    return "CASE mode " + " ".join(f"WHEN '{m}' THEN {quoted(v[field])}" for m, v in status.MODES.items()) + f" ELSE '{absent}' END"


@query(f"""WITH e AS (SELECT event_id, [{', '.join(f"'{m}'" for m in status.MODES)}, 'none'][event_id % {len(status.MODES) + 1} + 1] AS mode, user_id % 4 AS n, event_id % 3 AS m,
  CASE WHEN event_type <> 'click' THEN event_type END AS code, CASE WHEN event_id % 5 = 0 THEN '  ' ELSE props || chr(10) || ' ' || event_type END AS message FROM events)
SELECT event_id, CASE WHEN mode IN ('png-sequence', 'spritesheet-grid', 'spritesheet-json', 'none') THEN 'Selected ' || n || CASE n WHEN 1 THEN ' file.' ELSE ' files.' END ELSE 'Selected 1 ' || {_of_mode(0, 'PNG image')} || '.' END AS selected,
  'Converted a ' || {_of_mode(0, 'PNG image')} || ' of ' || n || CASE n WHEN 1 THEN ' frame' ELSE ' frames' END ||
  CASE WHEN mode IN ('piskel', 'pixil', 'openraster', 'pixelorama', 'krita', 'psd') THEN ' and ' || m || CASE m WHEN 1 THEN ' layer' ELSE ' layers' END ELSE '' END || '.' AS converted,
  'Could not convert the ' || {_of_mode(0, 'PNG image')} || ': ' || CASE WHEN code IS NOT NULL AND event_id % 5 <> 0 THEN trim(regexp_replace(message, '\\s+', ' ', 'g')) ELSE 'check that ' || {_of_mode(1, 'it is a PNG image')} || '.' END AS failed FROM e""")
def status_messages(spark, sf_dir):
    """N29 and N30: texts about selections, conversions and failures, which show only what an importer wrote."""
    i = F.col("event_id")
    mode = F.element_at(F.array(*map(F.lit, [*status.MODES, "none"])), (i % (len(status.MODES) + 1) + 1).cast("int"))
    frames, layers, code = F.col("user_id") % 4, i % 3, F.when(F.col("event_type") != "click", F.col("event_type"))
    message = F.when(i % 5 == 0, "  ").otherwise(F.concat("props", F.lit("\n "), "event_type"))
    out = {"selected": status.selection_status(mode, frames), "converted": status.success_status(mode, frames, layers), "failed": status.failure_status(mode, code, message)}
    return table(spark, sf_dir, "events").select("event_id", *[c.alias(n) for n, c in out.items()])


@query("""SELECT user_id, CASE WHEN list_contains(k, 'piskel') THEN 'piskel' WHEN list_contains(k, 'gif') THEN 'gif' WHEN list_contains(k, 'kra') THEN 'krita' WHEN list_contains(k, 'json') THEN 'spritesheet-json'
  WHEN len(k) > 1 THEN 'png-sequence' END AS mode FROM (SELECT event_id // 2 AS user_id, list(DISTINCT CASE event_id % 17 WHEN 0 THEN 'piskel' WHEN 3 THEN 'gif' WHEN 5 THEN 'kra' WHEN 8 THEN 'json' ELSE 'png' || event_id END) AS k
FROM events GROUP BY 1)""")
def mode_of_files(spark, sf_dir):
    """N30: the mode that the kinds of a group of files call for where none was chosen."""
    i = F.col("event_id")
    kind = F.when(i % 17 == 0, "piskel").when(i % 17 == 3, "gif").when(i % 17 == 5, "kra").when(i % 17 == 8, "json").otherwise(F.concat(F.lit("png"), i.cast("string")))
    groups = table(spark, sf_dir, "events").groupBy(F.floor(i / 2).alias("user_id")).agg(F.collect_set(kind).alias("kinds"))
    return groups.select("user_id", status.mode_of(F.col("kinds")).alias("mode"))


@query("""WITH p AS (SELECT p_partkey, (p_partkey % 4097)::BIGINT AS w, (p_size * 41)::BIGINT AS h, (p_partkey % 5)::BIGINT AS f, (p_partkey % 3)::BIGINT AS l FROM part), b AS (SELECT *, 4 * w * h * f * l AS n FROM p)
SELECT p_partkey, CASE WHEN w > 0 AND h > 0 AND f > 0 AND l > 0 THEN 'about ' || CASE WHEN n < 1048576 THEN ceil(n / 1024.0)::BIGINT || ' KiB' WHEN n % 1048576 = 0 THEN n // 1048576 || ' MiB' ELSE printf('%.1f', floor(n / 1048576.0 * 10 + 0.5) / 10) || ' MiB' END ||
  ' (' || w || ' x ' || h || ' x 4 bytes' || CASE WHEN f > 1 THEN ' x ' || f || ' frames' ELSE '' END || CASE WHEN l > 1 THEN ' x ' || l || ' layers' ELSE '' END || ')' END AS estimate FROM b""")
def decoded_estimates(spark, sf_dir):
    """N13: the decoded size of a document, and the factors that give it."""
    p = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", s.decoded_estimate((p % 4097).cast("long"), (F.col("p_size") * 41).cast("long"), (p % 5).cast("long"), (p % 3).cast("long")).alias("estimate"))
