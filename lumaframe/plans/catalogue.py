"""Queries that apply the engine's operators to the tables of a folder, with the same in SQL."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import scalars as s
from ..operators import compositing, relational as r, updates, validation
from ..shipping import ship_code
from ..sources import animated, convert, layered, png, reader, sheets, timeline_file
from ..sources.document import main_layer

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that gives its rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""
WITH d AS (SELECT user_id, event_id, greatest(1, least(65535, floor(value * 1000 / 12 + 0.5)))::INT AS duration_ms FROM events)
SELECT user_id, (row_number() OVER w - 1)::INT AS frame_index, duration_ms,
  (sum(duration_ms) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) - duration_ms)::BIGINT AS start_ms
FROM d WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    ms = F.greatest(F.lit(1), F.least(F.lit(65535), F.floor(F.col("value") * 1000 / 12 + 0.5))).cast("int")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", ms.alias("duration_ms"))
    return rows.select(
        "user_id",
        (F.row_number().over(w) - 1).alias("frame_index"),
        "duration_ms",
        (F.sum("duration_ms").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("duration_ms")).cast("long").alias("start_ms"),
    )


def clamp_sql(x: str, low: int = 1, high: int = 65535) -> str:
    return f"greatest({low}, least({high}, {x}))::INT"


@query(f"SELECT event_id, {clamp_sql('floor(value * 1000 / 12 + 0.5)')} AS duration_ms FROM events")
def normalize_duration(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", s.normalize_duration(F.col("value") * 1000 / 12).alias("duration_ms"))


@query("SELECT event_id, CASE WHEN event_id % 7000 = 0 THEN 100 ELSE greatest(20, least(65535, (event_id % 7000) * 10)) END::INT AS duration_ms FROM events")
def gif_delay(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", s.gif_delay(F.col("event_id") % 7000).alias("duration_ms"))


@query(f"SELECT event_id, {clamp_sql('floor((event_id % 1000) * 1000 / (CASE WHEN user_id % 60 = 0 THEN 100 ELSE user_id % 60 END) + 0.5)')} AS duration_ms FROM events")
def apng_delay(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", s.apng_delay(F.col("event_id") % 1000, F.col("user_id") % 60).alias("duration_ms"))


@query(f"""SELECT event_id, {clamp_sql('floor(1000.0::DOUBLE / (event_id % 120 + 1) + 0.5)')} AS piskel_ms,
  {clamp_sql('floor((user_id % 9) / 4.0::DOUBLE * 1000 / (event_id % 120 + 1) + 0.5)')} AS pixelorama_ms FROM events""")
def fps_durations(spark, sf_dir):
    fps = F.col("event_id") % 120 + 1
    return table(spark, sf_dir, "events").select("event_id", s.piskel_duration(fps).alias("piskel_ms"), s.pixelorama_duration(F.col("user_id") % 9 / 4.0, fps).alias("pixelorama_ms"))


@query("SELECT l_orderkey, l_linenumber, floor(l_discount * 255 + 0.5)::INT AS opacity FROM lineitem")
def opacity_scale(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", s.opacity_byte(F.col("l_discount")).alias("opacity"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN v BETWEEN 0 AND 1 THEN floor(v * 255 + 0.5)::INT WHEN v = floor(v) AND v BETWEEN 0 AND 255 THEN v::INT END AS opacity
FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_discount ELSE l_quantity * 8 END AS v FROM lineitem)""")
def psd_opacity(spark, sf_dir):
    value = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_discount")).otherwise(F.col("l_quantity") * 8)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", s.psd_opacity(value).alias("opacity"))


def _grid(spark, sf_dir, column_major):
    i, rows, columns = F.col("event_id") % 96, F.lit(8), F.lit(12)
    return table(spark, sf_dir, "events").select("event_id", s.grid_row(i, rows, columns, column_major).alias("grid_row"), s.grid_column(i, rows, columns, column_major).alias("grid_col"))


@query("SELECT event_id, floor((event_id % 96) / 12)::INT AS grid_row, ((event_id % 96) % 12)::INT AS grid_col FROM events")
def grid_index_row_major(spark, sf_dir):
    return _grid(spark, sf_dir, False)


@query("SELECT event_id, ((event_id % 96) % 8)::INT AS grid_row, floor((event_id % 96) / 8)::INT AS grid_col FROM events")
def grid_index_column_major(spark, sf_dir):
    return _grid(spark, sf_dir, True)


def divisor_sql(n: str, target: str) -> str:
    return f"(SELECT d FROM unnest(range(1, {n} + 1)) AS u(d) WHERE {n} % d = 0 ORDER BY abs({target} - d), d DESC LIMIT 1)"


@query(f"SELECT p_partkey, CASE WHEN p_size > 0 THEN {divisor_sql('n', 'p_size')} END AS divisor FROM (SELECT p_partkey, p_partkey % 1024 + 1 AS n, p_size FROM part)")
def nearest_divisor(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", s.nearest_divisor(F.col("p_partkey") % 1024 + 1, F.col("p_size")).alias("divisor"))


@query(f"""WITH g AS (SELECT p_partkey, w, h, {divisor_sql('w', 'w / (p_size + 0.0::DOUBLE)')} AS columns, {divisor_sql('h', 'h / 7.0::DOUBLE')} AS rows
  FROM (SELECT p_partkey, p_partkey % 512 + 16 AS w, p_partkey % 300 + 8 AS h, p_size FROM part WHERE p_size > 0))
SELECT p_partkey, columns, rows, w // columns AS frame_width, h // rows AS frame_height FROM g""")
def exact_fit_grid(spark, sf_dir):
    rows = table(spark, sf_dir, "part").where("p_size > 0")
    grid = s.exact_fit_grid(F.col("p_partkey") % 512 + 16, F.col("p_partkey") % 300 + 8, F.col("p_size"), F.lit(7.0))
    return rows.select("p_partkey", grid.alias("g")).select("p_partkey", "g.*")


@query("""SELECT p_partkey, CASE WHEN p_size = 0 OR r = 0 THEN 'invalid' WHEN p_size * 4 > 100 OR r * 7 > 42 THEN 'exceeds' WHEN p_size * 4 <> 100 OR r * 7 <> 42 THEN 'uncovered' ELSE 'valid' END AS state
FROM (SELECT p_partkey, p_size, p_partkey % 9 AS r FROM part)""")
def grid_preview_state(spark, sf_dir):
    state = s.grid_state(F.lit(100), F.lit(42), F.col("p_size"), F.lit(7), F.col("p_partkey") % 9, F.lit(4))
    return table(spark, sf_dir, "part").select("p_partkey", state.alias("state"))


_NAMES = ("a.png", "b.JSON", "c.piskel", "d.gif", "e.x.APNG", "f.ora", "g.pxo", "h", "i.kra", "j.PSD", "k.pixil", "l.txt", "m.", "gif")
_MIMES = ("", "image/gif", "IMAGE/PNG", "application/x-krita", "image/psd", "text/plain", "application/x-pixelorama")


@query(f"""WITH f AS (SELECT page_id, {list(_NAMES)}[(page_id % {len(_NAMES)} + 1)::INT] AS name, {list(_MIMES)}[(page_id % {len(_MIMES)} + 1)::INT] AS mime FROM pages),
e AS (SELECT *, lower(regexp_extract(name, '\\.([^.]*)$', 1)) AS ext FROM f)
SELECT page_id, CASE WHEN ext IN ('png','json','piskel','pixil','gif','apng','ora','pxo','kra','psd') THEN ext
  WHEN lower(mime) = 'image/gif' THEN 'gif' WHEN lower(mime) = 'image/png' THEN 'png' WHEN lower(mime) = 'application/x-krita' THEN 'kra'
  WHEN lower(mime) = 'image/psd' THEN 'psd' WHEN lower(mime) = 'application/x-pixelorama' THEN 'pxo' END AS kind FROM e""")
def classify_source(spark, sf_dir):
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("page_id") % len(values) + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", s.source_kind(pick(_NAMES), pick(_MIMES)).alias("kind"))


def _size_sql(x: str) -> str:
    scaled = lambda v: f"CASE WHEN {v} >= 10 THEN floor({v} + 0.5)::BIGINT::VARCHAR ELSE printf('%.1f', floor({v} * 10 + 0.5) / 10) END"
    return f"""CASE WHEN {x} >= 1073741824 THEN {scaled(f'({x} / 1073741824.0::DOUBLE)')} || ' GB' WHEN {x} >= 1048576 THEN {scaled(f'({x} / 1048576.0::DOUBLE)')} || ' MB'
  WHEN {x} >= 1024 THEN {scaled(f'({x} / 1024.0::DOUBLE)')} || ' KB' WHEN {x} = 1 THEN '1 byte' ELSE {x}::VARCHAR || ' bytes' END"""


@query(f"SELECT doc_id, {_size_sql('(n_chars * (doc_id % 5) * (doc_id % 5) * (doc_id % 5) * (doc_id % 5) * 97)')} AS size FROM documents")
def format_file_size(spark, sf_dir):
    k = F.col("doc_id") % 5
    return table(spark, sf_dir, "documents").select("doc_id", s.format_file_size(F.col("n_chars") * k * k * k * k * 97).alias("size"))


@query("""SELECT source, sum(n_chars)::BIGINT AS total, count(*) AS files,
  (source = 'src0' AND count(*) >= 100) OR sum(n_chars) >= 67108864 OR coalesce(4 * max(n_chars) * 64 >= 67108864, false) AS large FROM documents GROUP BY source""")
def large_file_warning(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("total"), F.count(F.lit(1)).alias("files"), F.max("n_chars").alias("most"))
    large = s.is_large(F.col("total"), F.col("files"), F.col("source") == "src0", s.decoded_bytes(F.col("most"), F.lit(64)))
    return rows.select("source", "total", "files", large.alias("large"))


@query("SELECT doc_id, CASE WHEN doc_id % 7 > 0 AND n_chars > 0 AND 4::HUGEINT * n_chars * n_chars * (doc_id % 7) * 1000003 <= 9007199254740991 THEN 4 * n_chars * n_chars * (doc_id % 7) * 1000003 ELSE -1 END::BIGINT AS bytes FROM documents")
def decoded_bytes_estimate(spark, sf_dir):
    size = s.decoded_bytes(F.col("n_chars"), F.col("n_chars"), F.col("doc_id") % 7, F.lit(1000003))
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(size, F.lit(-1)).alias("bytes"))


@query("SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS frame_index FROM conversations WHERE role <> 'system'")
def reindex_visible(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    shown = r.visible(rows, rows.where("role = 'system'").select("conv_id", "turn"), ["conv_id", "turn"])
    return r.reindex(shown, ["conv_id"], ["turn"], F.lit(True)).select("conv_id", "turn", "frame_index")


@query("""WITH o AS (SELECT conv_id, turn, turn * 100 AS start, turn * 100 + length(text) AS stop FROM conversations)
SELECT conv_id, turn, start, lead(start, 1, 1000000) OVER w AS next_start, stop > lead(start, 1, 1000000) OVER w AS overlaps FROM o WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def next_offset_overlap(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") * 100).alias("start"), (F.col("turn") * 100 + F.length("text")).alias("stop"))
    rows = rows.withColumn("next_start", r.next_value("start", ["conv_id"], ["turn"], 1000000))
    return rows.select("conv_id", "turn", "start", "next_start", (F.col("stop") > F.col("next_start")).alias("overlaps"))


@query("""WITH s AS (SELECT user_id, event_id, floor(value)::BIGINT AS size FROM events),
t AS (SELECT *, sum(size) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM s)
SELECT user_id, min(event_id) AS event_id, min_by(running, event_id) AS running FROM t WHERE running > 2000 GROUP BY user_id""")
def running_output_cap(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.floor("value").cast("bigint").alias("size"))
    return r.first_breach(rows, "size", ["user_id"], "event_id", 2000)


@query("SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY ALL HAVING count(*) > 1")
def duplicate_key_check(spark, sf_dir):
    return r.duplicates(table(spark, sf_dir, "conversations"), ["conv_id", "role"])


@query("""SELECT coalesce('unqid:' || CASE WHEN o_custkey % 3 = 0 THEN o_custkey::VARCHAR END, 'id:' || o_orderpriority) AS layer, count(*) AS n,
  min(o_orderstatus) IS NOT DISTINCT FROM max(o_orderstatus) AS same_o_orderstatus, min(o_totalprice) IS NOT DISTINCT FROM max(o_totalprice) AS same_o_totalprice FROM orders GROUP BY 1""")
def layer_identity_regroup(spark, sf_dir):
    identity = s.layer_identity(F.when(F.col("o_custkey") % 3 == 0, F.col("o_custkey").cast("string")), F.col("o_orderpriority"))
    return r.regroup(table(spark, sf_dir, "orders").withColumn("layer", identity), ["layer"], ["o_orderstatus", "o_totalprice"])


@query("""SELECT r_regionkey AS frame, n_nationkey AS layer, 'image_data/frames/' || r_regionkey || '/layer_' || n_nationkey AS entry, e.n IS NULL AS missing
FROM region CROSS JOIN nation LEFT JOIN (SELECT DISTINCT n_regionkey AS k, n_nationkey AS n FROM nation) e ON e.k = r_regionkey AND e.n = n_nationkey""")
def frame_layer_cross(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    rows = r.cells(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("frame")), nation.select(F.col("n_nationkey").alias("layer")))
    path = F.format_string("image_data/frames/%d/layer_%d", "frame", "layer")
    entries = nation.select(F.format_string("image_data/frames/%d/layer_%d", "n_regionkey", "n_nationkey").alias("entry"), F.lit(True).alias("found"))
    return rows.withColumn("entry", path).join(entries, "entry", "left").select("frame", "layer", "entry", F.col("found").isNull().alias("missing"))


@query("""WITH t AS (SELECT n_nationkey AS tag, n_nationkey * 37 AS low, n_nationkey * 37 + 60 AS high FROM nation)
SELECT tag, count(*) AS frames, min(event_id) AS first_frame, max(event_id) AS last_frame FROM events JOIN t ON event_id BETWEEN low AND high GROUP BY tag""")
def tag_range_join(spark, sf_dir):
    tags = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("tag"), (F.col("n_nationkey") * 37).alias("low"), (F.col("n_nationkey") * 37 + 60).alias("high"))
    rows = r.in_ranges(table(spark, sf_dir, "events").select("event_id"), tags, "event_id", "low", "high", 64)
    return rows.groupBy("tag").agg(F.count(F.lit(1)).alias("frames"), F.min("event_id").alias("first_frame"), F.max("event_id").alias("last_frame"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def fk_violations(spark, sf_dir):
    return r.references(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), ["doc_id"], missing=True)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def archive_allowlist(spark, sf_dir):
    allowed = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return r.references(table(spark, sf_dir, "orders").select("o_orderkey"), allowed, ["o_orderkey"], missing=False)


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 = turn AS in_place FROM conversations WHERE role <> 'system'")
def position_check(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role <> 'system'")
    return rows.select("conv_id", "turn", (r.position(["conv_id"], ["turn"]) == F.col("turn")).alias("in_place"))


@query("""SELECT conv_id, count(*) FILTER (p <> turn) AS out_of_sequence FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p FROM conversations WHERE length(text) > 40) GROUP BY conv_id""")
def sequence_check(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where(F.length("text") > 40).select("conv_id", "turn", r.position(["conv_id"], ["turn"]).alias("p"))
    return rows.groupBy("conv_id").agg(F.count_if(F.col("p") != F.col("turn")).alias("out_of_sequence"))


@query("SELECT conv_id, turn, role IS NOT DISTINCT FROM first_value(role) OVER (PARTITION BY conv_id ORDER BY turn) AS as_first FROM conversations")
def first_row_equality(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", r.equals_first("role", ["conv_id"], ["turn"]).alias("as_first"))


@query("SELECT conv_id, count(DISTINCT turn) AS covered, max(turn) + 1 AS needed, count(DISTINCT turn) = max(turn) + 1 AS complete FROM conversations WHERE role <> 'system' GROUP BY conv_id")
def coverage_check(spark, sf_dir):
    return r.coverage(table(spark, sf_dir, "conversations").where("role <> 'system'"), ["conv_id"], "turn")


@query("SELECT user_id, count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'error') AS n_error, count(*) FILTER (event_type = 'view') AS n_view FROM events GROUP BY user_id")
def kind_counts(spark, sf_dir):
    return r.kind_counts(table(spark, sf_dir, "events"), ["user_id"], "event_type", ["click", "error", "view"])


@query("SELECT event_id, (props::JSON->>'k')::BIGINT AS k, (props::JSON->>'k')::BIGINT BETWEEN 1 AND 50 AS ok FROM events")
def json_prop_parse(spark, sf_dir):
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), k.between(1, 50).alias("ok"))


@query("""WITH a AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'http://www.aseprite.org/' WHEN 1 THEN 'Phaser 3' WHEN 2 THEN 'https://www.codeandweb.com/TexturePacker' WHEN 3 THEN 'pixi' ELSE '' END AS app,
  user_id % 5 = 0 AS tex, user_id % 7 = 0 AS ani, CASE event_id % 4 WHEN 0 THEN 'array' WHEN 1 THEN 'hash' WHEN 2 THEN 'root-frames' END AS v FROM events),
f AS (SELECT event_id, v, app, tex, CASE WHEN app LIKE '%aseprite%' THEN 'aseprite' WHEN tex THEN 'phaser-pixi' WHEN app IN ('Phaser 3', 'pixi') OR ani THEN 'phaser-pixi'
  WHEN app LIKE '%TexturePacker%' OR v IN ('array', 'hash') THEN 'texturepacker' ELSE 'unknown' END AS family FROM a)
SELECT event_id, family, CASE WHEN family = 'phaser-pixi' AND tex AND app NOT LIKE '%aseprite%' THEN 'multiatlas' WHEN family = 'unknown' THEN coalesce(v, 'unknown') ELSE coalesce(v, 'root-frames') END AS variant FROM f""")
def atlas_family_case(spark, sf_dir):
    i, u = F.col("event_id"), F.col("user_id")
    app = F.when(i % 6 == 0, "http://www.aseprite.org/").when(i % 6 == 1, "Phaser 3").when(i % 6 == 2, "https://www.codeandweb.com/TexturePacker").when(i % 6 == 3, "pixi").otherwise("")
    variant = F.when(i % 4 == 0, "array").when(i % 4 == 1, "hash").when(i % 4 == 2, "root-frames")
    return table(spark, sf_dir, "events").select("event_id", s.atlas_format(app, u % 5 == 0, u % 7 == 0, variant).alias("f")).select("event_id", "f.*")


_RECT = ("l_orderkey", "l_linenumber", "l_partkey % 40 - 2 AS x", "l_suppkey % 30 AS y", "l_linenumber AS w", "l_orderkey % 9 AS h")
_RECTS = f"SELECT {', '.join(_RECT)} FROM lineitem"


def _rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*_RECT)


@query(f"SELECT l_orderkey, l_linenumber, x, y, w > 0 AND h > 0 AND x >= 0 AND y >= 0 AND x + w <= 32 AND y + h <= 24 AS inside FROM ({_RECTS})")
def rect_containment(spark, sf_dir):
    rows = _rects(spark, sf_dir)
    return rows.select("l_orderkey", "l_linenumber", "x", "y", validation.inside("x", "y", "w", "h", F.lit(32), F.lit(24)).alias("inside"))


@query(f"""WITH c AS ({_RECTS})
SELECT code, count(*) AS n FROM (SELECT 'invalid_cel_x' AS code FROM c WHERE x < 0 UNION ALL SELECT 'invalid_cel_y' FROM c WHERE y < 0
  UNION ALL SELECT 'cel_out_of_bounds' FROM c WHERE x >= 0 AND x + w > 32 UNION ALL SELECT 'cel_out_of_bounds' FROM c WHERE y >= 0 AND y + h > 24) GROUP BY code""")
def cel_bounds(spark, sf_dir):
    codes = F.explode(validation.bound_codes(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(32), F.lit(24)))
    return _rects(spark, sf_dir).select(codes.alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey = 3 THEN 'Ink' ELSE s_name END AS s_name FROM supplier")
def rename_update(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return updates.set_where(rows, F.col("s_suppkey") == 3, "s_name", F.lit("Ink"))


@query("SELECT event_id, CASE WHEN event_id = 5 THEN 120 ELSE greatest(1, least(65535, floor(value * 1000 / 12 + 0.5)))::INT END AS duration_ms FROM events")
def duration_update(spark, sf_dir):
    return updates.set_where(normalize_duration(spark, sf_dir), F.col("event_id") == 5, "duration_ms", F.lit(120))


_PATHS = ("a/b.png", "/abs", "../up", "a//b", "a/./b", "C:/x", "dir/", "", "a\\b", "x/..", "http://h/p", "ok")


_PATHS_SQL = "[" + ", ".join(f"'{p}'" for p in _PATHS) + "]"


@query(f"""SELECT page_id, p AS path, p = '' OR p LIKE '/%' OR contains(p, '{chr(92)}') OR regexp_matches(p, '^[A-Za-z][A-Za-z0-9+.-]*:')
  OR regexp_matches(regexp_replace(p, '/$', ''), '(^|/)[.]{{0,2}}(/|$)') AS unsafe
FROM (SELECT page_id, {_PATHS_SQL}[(page_id % {len(_PATHS)} + 1)::INT] AS p FROM pages)""")
def path_safety(spark, sf_dir):
    path = F.element_at(F.array(*map(F.lit, _PATHS)), (F.col("page_id") % len(_PATHS) + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"), s.unsafe_path(path).alias("unsafe"))


@query("""WITH v AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_id::VARCHAR WHEN 1 THEN '0' || event_id WHEN 2 THEN '-' || event_id WHEN 3 THEN event_id || '.0' ELSE NULL END AS t FROM events)
SELECT event_id, CASE WHEN regexp_full_match(t, '0|[1-9][0-9]*') THEN t::BIGINT END AS whole,
  CASE WHEN t IS NULL THEN 0 WHEN regexp_full_match(t, '-?(0|[1-9][0-9]{0,4})') AND t <> '-0' AND try_cast(t AS BIGINT) BETWEEN -32768 AND 32767 THEN t::INT END AS signed FROM v""")
def strict_int(spark, sf_dir):
    i = F.col("event_id").cast("string")
    kind = F.col("event_id") % 5
    text = F.when(kind == 0, i).when(kind == 1, F.concat(F.lit("0"), i)).when(kind == 2, F.concat(F.lit("-"), i)).when(kind == 3, F.concat(i, F.lit(".0")))
    return table(spark, sf_dir, "events").select("event_id", s.strict_integer(text).alias("whole"), s.signed_integer(text).alias("signed"))


_BASE64 = ("QQ==", "QR==", "QUI=", "QUJ=", "QUJD", "Q", "QUJDRA==", "Q=Q=", "", "QU-D", "QQ")


@query(f"""SELECT doc_id, t AS payload, regexp_full_match(t, '([A-Za-z0-9+/]{{4}})*([A-Za-z0-9+/][AQgw]==|[A-Za-z0-9+/]{{2}}[AEIMQUYcgkosw048]=)?') AS canonical
FROM (SELECT doc_id, {list(_BASE64)}[(doc_id % {len(_BASE64)} + 1)::INT] AS t FROM documents)""")
def base64_shape(spark, sf_dir):
    text = F.element_at(F.array(*map(F.lit, _BASE64)), (F.col("doc_id") % len(_BASE64) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("payload"), s.strict_base64(text).alias("canonical"))


def _unsafe_sql(p: str) -> str:
    return f"""({p} = '' OR length({p}) + length(regexp_replace({p}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) > {s.MAX_PATH} OR contains({p}, '{chr(92)}') OR contains({p}, chr(0))
  OR regexp_matches({p}, '^(/|[A-Za-z][A-Za-z0-9+.-]*:)') OR regexp_matches(regexp_replace({p}, '/$', ''), '(^|/)[.]{{0,2}}(/|$)'))"""


@query(f"""SELECT page_id, url, {_unsafe_sql("url")} AS unsafe, path, {_unsafe_sql("path")} AS path_unsafe, CASE WHEN ext IN ('png','json','piskel','pixil','gif','apng','ora','pxo','kra','psd') THEN ext END AS kind
FROM (SELECT page_id, url, regexp_replace(url, '^[a-z]+://[^/]*/', '') AS path, lower(regexp_extract(url, '\\.([^.]*)$', 1)) AS ext FROM pages)""")
def page_urls(spark, sf_dir):
    """path_safety and classify_source on the addresses of pages."""
    path = F.regexp_replace("url", "^[a-z]+://[^/]*/", "")
    return table(spark, sf_dir, "pages").select("page_id", "url", s.unsafe_path(F.col("url")).alias("unsafe"), path.alias("path"), s.unsafe_path(path).alias("path_unsafe"), s.source_kind(F.col("url"), F.lit("")).alias("kind"))


_CANONICAL = "([A-Za-z0-9+/]{4})*([A-Za-z0-9+/][AQgw]==|[A-Za-z0-9+/]{2}[AEIMQUYcgkosw048]=)?"


@query(f"SELECT doc_id, regexp_full_match(text, '{_CANONICAL}') AS text_canonical, regexp_full_match(base64(encode(text)), '{_CANONICAL}') AS base64_canonical FROM documents")
def document_base64(spark, sf_dir):
    """base64_shape on whole texts of documents and on their base64 form."""
    coded = F.translate(F.base64(F.encode("text", "utf-8")), "\r\n", "")
    return table(spark, sf_dir, "documents").select("doc_id", s.strict_base64(F.col("text")).alias("text_canonical"), s.strict_base64(coded).alias("base64_canonical"))


@query("""WITH v AS (SELECT conv_id, turn, 0 AS section, 'invalid_layer_name' AS code FROM conversations WHERE trim(role) = 'system'
  UNION ALL SELECT conv_id, turn, 1, 'invalid_frame_duration' FROM conversations WHERE length(text) > 65 UNION ALL SELECT conv_id, turn, 2, 'invalid_frame_index' FROM conversations WHERE turn % 3 = 1)
SELECT conv_id, turn, code, (row_number() OVER (PARTITION BY conv_id ORDER BY section, turn))::INT AS ordinal FROM v""")
def ordered_violations(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    rules = [("invalid_layer_name", F.trim("role") == "system"), ("invalid_frame_duration", F.length("text") > 65), ("invalid_frame_index", F.col("turn") % 3 == 1)]
    return validation.ordered(rows, rules, ["conv_id"], "turn").select("conv_id", "turn", "code", "ordinal")


@query("SELECT vec_id, i::INT AS pos, embedding[i + 5]::DOUBLE AS value FROM embeddings, range(0, 8) AS r(i)")
def embedding_slice(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.slice("embedding", 5, 8)).alias("pos", "value"))
    return rows.select("vec_id", "pos", F.col("value").cast("double").alias("value"))


@query("SELECT vec_id, i::INT AS pos, embedding[[3, 2, 1, 4][i + 1]]::DOUBLE AS value FROM embeddings, range(0, 4) AS r(i)")
def channel_swizzle(spark, sf_dir):
    """Blue, green, red, alpha put into the order red, green, blue, alpha."""
    rgba = F.array(*[F.element_at("embedding", i) for i in (3, 2, 1, 4)])
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(rgba).alias("pos", "value"))
    return rows.select("vec_id", "pos", F.col("value").cast("double").alias("value"))


@query("""SELECT p_partkey, CASE WHEN trimmed THEN 10 WHEN rotated THEN 7 ELSE p_size END::INT AS width, CASE WHEN trimmed THEN 12 WHEN rotated THEN p_size ELSE 7 END::INT AS height
FROM (SELECT p_partkey, p_size, p_partkey % 3 = 0 AS rotated, p_partkey % 4 = 0 AS trimmed FROM part)""")
def frame_dimensions(spark, sf_dir):
    size = s.frame_size(F.col("p_size"), F.lit(7), F.col("p_partkey") % 3 == 0, F.col("p_partkey") % 4 == 0, F.lit(10), F.lit(12))
    return table(spark, sf_dir, "part").select("p_partkey", size.alias("size")).select("p_partkey", "size.*")


@query("SELECT user_id, min_by(event_id, (-floor(value), event_id)) AS top_event, max(floor(value))::BIGINT AS priority FROM events GROUP BY user_id")
def top_priority(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rows.groupBy("user_id").agg(F.min_by("event_id", F.struct((-F.floor("value")).alias("p"), "event_id")).alias("top_event"), F.max(F.floor("value")).cast("bigint").alias("priority"))


def _on_text(spark: SparkSession, sf_dir: str, f, kind: str) -> DataFrame:
    """doc_id, value: f of the UTF-8 bytes of each text, run on Arrow batches."""
    ship_code(spark)

    @F.pandas_udf(kind)
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: f((t or "").encode()))

    return table(spark, sf_dir, "documents").select("doc_id", run("text").alias("value"))


@query("""WITH RECURSIVE t(b, k, c) AS (SELECT range, 0, range FROM range(256)
  UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM t WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS l FROM t WHERE k = 8), v AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, [('0x' || substr(h, 2 * i + 1, 2))::BIGINT FOR i IN range(0, length(h) // 2)] AS bytes FROM v)
SELECT doc_id, xor(list_reduce(list_prepend(4294967295, bytes), lambda a, x: xor(a >> 8, l[(xor(a, x) & 255) + 1])), 4294967295)::BIGINT AS value FROM b, crc""")
def crc32_bytes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("value"))


@query(r"""WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
v AS (SELECT doc_id, length(h) // 2 AS n, [('0x' || substr(h, 2 * i + 1, 2))::BIGINT FOR i IN range(0, length(h) // 2)] AS bytes FROM b)
SELECT doc_id, ((n + coalesce(list_sum([(n - i + 1) * bytes[i] FOR i IN range(1, n + 1)]), 0)) % 65521 * 65536 + (1 + coalesce(list_sum(bytes), 0)) % 65521)::BIGINT AS value FROM v""")
def adler32_bytes(spark, sf_dir):
    return _on_text(spark, sf_dir, zlib.adler32, "bigint")


@query("SELECT doc_id, md5(coalesce(text, '')) AS value FROM documents")
def lzw_roundtrip(spark, sf_dir):
    """What the GIF decoder makes of each text's code stream."""
    return _on_text(spark, sf_dir, lambda b: hashlib.md5(animated.lzw_decode(animated.lzw_encode(b, 8), 8, len(b))).hexdigest(), "string")


@query("SELECT doc_id, md5(coalesce(text, '')) AS value FROM documents")
def packbits_roundtrip(spark, sf_dir):
    return _on_text(spark, sf_dir, lambda b: hashlib.md5(layered.unpack_bits(layered.pack_bits(b), len(b))).hexdigest(), "string")


@query("SELECT doc_id, md5(coalesce(text, '')) AS value FROM documents")
def zlib_store(spark, sf_dir):
    """What zlib makes of each text's stream of stored blocks; the format has no block for no bytes."""
    return _on_text(spark, sf_dir, lambda b: hashlib.md5(zlib.decompress(timeline_file.store(b)) if b else b).hexdigest(), "string")


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A canvas of 8 x 8 a user, on which the user's events draw rectangles of one colour."""
    e = table(spark, sf_dir, "events").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1)
    left, top = F.when(F.col("n") == 0, 0).otherwise(F.col("event_id") % 5).cast("int"), F.when(F.col("n") == 0, 0).otherwise(F.col("event_id") % 3).cast("int")
    side = F.when(F.col("n") == 0, 8).otherwise(F.col("event_id") % 4 + 1).cast("int")
    colour = F.concat(F.lpad(F.hex(F.col("event_id") % 256), 2, "0"), F.lpad(F.hex(F.col("user_id") % 256), 2, "0"), F.lit("40"), F.lpad(F.hex(F.floor(F.col("value")).cast("long") % 256), 2, "0"))
    return e.select(
        F.col("user_id").cast("string").alias("project_id"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.col("n").cast("int").alias("frame_index"),
        left.alias("left"), top.alias("top"), side.alias("w"), side.alias("h"), F.unhex(F.repeat(colour, side * side)).alias("rgba"),
    )


def _composite(spark, sf_dir, dispose, blend) -> DataFrame:
    rows = _frames(spark, sf_dir).withColumn("dispose", dispose).withColumn("blend", F.lit(blend)).withColumn("background", F.unhex(F.lit("102030FF")))
    return compositing.composite(rows).select("project_id", "frame_index", F.crc32("rgba").alias("checksum"))


@query()
def gif_composite(spark, sf_dir):
    return _composite(spark, sf_dir, F.element_at(F.array(*map(F.lit, ("keep", "clear", "background", "previous"))), F.col("frame_index") % 4 + 1), False)


@query()
def apng_composite(spark, sf_dir):
    return _composite(spark, sf_dir, F.element_at(F.array(*map(F.lit, ("keep", "clear", "previous"))), F.col("frame_index") % 3 + 1), True)


@query()
def document_write(spark, sf_dir):
    """The size and checksum of the timeline document that each user's composited events make."""
    drawn = _frames(spark, sf_dir)
    cels = compositing.composite(drawn.select("*", F.lit("keep").alias("dispose"), F.lit(True).alias("blend"), F.lit(None).cast("binary").alias("background")))
    own = ["project_id"]
    frames = drawn.select("project_id", "frame_index", (F.col("frame_index") % 500 + 1).alias("duration_ms"))
    projects = frames.select(*own).distinct()
    model = {
        "projects": projects.select("project_id", F.lit("events").alias("source_format"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit("rgba").alias("color_mode")),
        "frames": frames,
        "frame_tags": projects.select("project_id", F.lit(0).alias("tag_index"), F.lit("all").alias("name"), F.lit(0).alias("from_frame"), F.lit(0).alias("to_frame"), F.lit("forward").alias("direction")),
        "layers": projects.select("project_id", F.lit(0).alias("layer_index"), F.lit("main").alias("layer_id"), F.lit("Main").alias("name"), F.lit(True).alias("visible"), F.lit(255).alias("opacity")),
        "cels": cels.select("project_id", F.lit(0).alias("layer_index"), "frame_index", F.lit(0).alias("x"), F.lit(0).alias("y"), "w", "h", F.lit("srgb").alias("color_space"), "rgba"),
    }
    return reader.export(model).select("project_id", F.octet_length("content").alias("size"), F.crc32("content").alias("checksum"), "error")


@query("""SELECT user_id, count(*) AS files, CASE WHEN NOT (count(*) FILTER (k IN ('png')) = 1 AND count(*) FILTER (k IN ('json')) = 1 AND count(*) = 2) THEN 'spritesheet-json takes 1 .png, 1 .json' END AS error
FROM (SELECT event_id // 2 AS user_id, CASE event_id % 3 WHEN 0 THEN 'png' WHEN 1 THEN 'json' ELSE 'png' END AS k FROM events) GROUP BY user_id""")
def source_selection(spark, sf_dir):
    i = F.col("event_id")
    files = table(spark, sf_dir, "events").select(F.floor(i / 2).alias("user_id"), F.when(i % 3 == 1, "json").otherwise("png").alias("kind"))
    return convert.selections(files, "spritesheet-json", "user_id")


@query("""WITH n AS (SELECT conv_id, turn, coalesce(role, 'Layer ' || (turn + 1)) AS name, text FROM conversations)
SELECT conv_id, turn, name, length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) > 0 AS valid FROM n""")
def layer_names(spark, sf_dir):
    name = s.layer_name(F.col("role"), F.col("turn"))
    letters = F.regexp_replace("text", "[^a-zA-Z]", "")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", name.alias("name"), s.valid_name(letters).alias("valid"))


@query("SELECT p_partkey, ceil(p_size / 64.0)::INT AS tiles, lower(regexp_replace(p_name, '[^a-zA-Z0-9]+', '-', 'g')) AS slug FROM part WHERE p_name ~ '^[a-zA-Z].*[a-zA-Z]$'")
def tiles_and_slugs(spark, sf_dir):
    rows = table(spark, sf_dir, "part").where(F.col("p_name").rlike("^[a-zA-Z].*[a-zA-Z]$"))
    return rows.select("p_partkey", s.tile_limit(F.col("p_size")).alias("tiles"), s.slug(F.col("p_name")).alias("slug"))


@query("""SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY part, o_orderkey) AS chunks FROM (
  SELECT o_custkey, o_orderkey, 0 AS part FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, o_orderkey, 1 FROM orders WHERE o_orderstatus <> 'F') GROUP BY o_custkey""")
def ordered_concat(spark, sf_dir):
    """Chunks of two kinds, those of the first kind before the others, joined in order."""
    orders = table(spark, sf_dir, "orders")
    part = lambda where, n: orders.where(where).select("o_custkey", F.lit(n).alias("part"), "o_orderkey")
    parts = F.array_sort(F.collect_list(F.struct("part", "o_orderkey")))
    rows = part("o_orderstatus = 'F'", 0).unionByName(part("o_orderstatus <> 'F'", 1))
    return rows.groupBy("o_custkey").agg(F.concat_ws(",", F.transform(parts, lambda x: x["o_orderkey"].cast("string"))).alias("chunks"))


@query("""WITH v AS (SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN 'group' WHEN o_custkey % 5 = 0 THEN 'text' WHEN o_orderstatus = 'O' THEN 'blend' END AS code FROM orders)
SELECT code, count(*) AS n FROM v WHERE code IS NOT NULL GROUP BY code""")
def feature_ladder(spark, sf_dir):
    """The first feature, in the order of refusal, that stops each document."""
    rules = [("group", F.col("o_custkey") % 7 == 0), ("text", F.col("o_custkey") % 5 == 0), ("blend", F.col("o_orderstatus") == "O")]
    codes = F.filter(F.array(*[F.when(c, F.lit(code)) for code, c in rules]), lambda x: x.isNotNull())
    return table(spark, sf_dir, "orders").select(F.get(codes, F.lit(0)).alias("code")).where("code is not null").groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT conv_id, min(turn) AS a, max(turn) AS b, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT conv_id, NOT (a >= 0 AND a <= b) AS bad_range, b NOT IN (SELECT turn FROM conversations) AS bad_reference FROM c""")
def tag_checks(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    tags = rows.groupBy("conv_id").agg(F.min("turn").alias("a"), F.max("turn").alias("b"))
    known = rows.select(F.col("turn").alias("b")).distinct().withColumn("known", F.lit(True))
    return tags.join(known, "b", "left").select("conv_id", (~((F.col("a") >= 0) & (F.col("a") <= F.col("b")))).alias("bad_range"), F.col("known").isNull().alias("bad_reference"))


def _as_image(data: bytes) -> np.ndarray:
    """Bytes as the pixels of an image 16 wide; the first four hold how many there are."""
    held = len(data).to_bytes(4, "little") + data
    return np.frombuffer(held.ljust(-(-len(held) // 64) * 64, b"\0"), np.uint8).reshape(-1, 16, 4)


def _from_image(pixels: np.ndarray) -> bytes:
    held = pixels.tobytes()
    return held[4 : 4 + int.from_bytes(held[:4], "little")]


@query("SELECT doc_id, md5(coalesce(text, '')) AS value FROM documents")
def png_roundtrip(spark, sf_dir):
    """What the PNG decoder makes of each text's bytes written as an image."""
    return _on_text(spark, sf_dir, lambda b: hashlib.md5(_from_image(png.decode(png.encode(_as_image(b))))).hexdigest(), "string")


@query("SELECT doc_id, md5(coalesce(text, '')) AS value FROM documents")
def timeline_roundtrip(spark, sf_dir):
    """What is read back of each text's bytes as the only cel of a timeline document."""

    def run(b: bytes) -> str:
        image = _as_image(b)
        doc = timeline_file.read(timeline_file.write(main_layer(image.shape[1], image.shape[0], [100], [image])))
        return hashlib.md5(_from_image(doc.layers[0].cels[0].pixels)).hexdigest()

    return _on_text(spark, sf_dir, run, "string")


@query("SELECT doc_id, md5(coalesce(text, '')) AS value FROM documents")
def sheet_roundtrip(spark, sf_dir):
    """Each text's bytes as a sheet, cut by a grid of 4 x 1 and put together from the frames."""

    def run(b: bytes) -> str:
        image = _as_image(b)
        doc = sheets.grid_sheet(image, 4, image.shape[0], 1, 4)
        return hashlib.md5(_from_image(np.concatenate([c.pixels for c in doc.layers[0].cels], axis=1))).hexdigest()

    return _on_text(spark, sf_dir, run, "string")
