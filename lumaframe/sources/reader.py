"""Sources as Spark tables: files are scanned as binary, decoded where they are read, and split into the model's tables.

A file's size is checked by the scan, before its content is read. Decoding gives flat rows, one a cel, so that no row holds a
whole document; the tables are filters on them. Errors are rows of their own table, never failures of the job."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import source_kind
from ..shipping import ship_code
from . import animated, layered, png, sheets
from .document import Cel, Document, Layer, SourceError, Tag
from .timeline_file import ExportError, write

#: A row of any table: what it is, then every column that a table has.
ROWS = (
    "project_id string, kind string, source_format string, width int, height int, frame_index int, duration_ms int, tag_index int, name string, from_frame int, to_frame int, "
    "direction string, layer_index int, layer_id string, visible boolean, opacity int, x int, y int, w int, h int, rgba binary, code string, message string"
)
_SCHEMA = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in ROWS.split(", "))])
#: The largest file of each kind that is read.
LARGEST = {"gif": animated.FILE, "apng": animated.FILE, "ora": layered.ORA.file, "pxo": layered.PXO.file, "kra": layered.KRA.file, "psd": layered.PSD_FILE, "pixil": sheets.PIXIL_FILE}


def _json(f: Callable[[str], Document]) -> Callable[[bytes], Document]:
    def run(data: bytes) -> Document:
        try:
            return f(data.decode("utf-8-sig"))
        except UnicodeDecodeError:
            raise SourceError("invalid-json", "the file is not valid UTF-8") from None

    return run


#: One file, one document.
IMPORTERS: dict[str, Callable[[bytes], Document]] = {
    "gif": animated.import_gif, "apng": animated.import_apng, "ora": layered.import_ora, "pxo": layered.import_pxo, "kra": layered.import_kra, "psd": layered.import_psd,
    "piskel": _json(sheets.import_piskel), "pixil": _json(sheets.import_pixil), "png": lambda data: sheets.png_sequence([png.image(data, "invalid-png")]),
}


def document_rows(project_id: str, source_format: str, doc: Document) -> Iterator[dict]:
    """The rows of a document, in order."""
    own = {"project_id": project_id}
    yield own | {"kind": "projects", "source_format": source_format, "width": doc.width, "height": doc.height}
    for i, ms in enumerate(doc.durations):
        yield own | {"kind": "frames", "frame_index": i, "duration_ms": ms}
    for i, t in enumerate(doc.tags):
        yield own | {"kind": "frame_tags", "tag_index": i, "name": t.name, "from_frame": t.first, "to_frame": t.last, "direction": t.direction}
    for i, layer in enumerate(doc.layers):
        yield own | {"kind": "layers", "layer_index": i, "layer_id": layer.id, "name": layer.name, "visible": layer.visible, "opacity": layer.opacity}
        for c in layer.cels:
            yield own | {"kind": "cels", "layer_index": i, "frame_index": c.frame, "x": c.x, "y": c.y, "w": c.pixels.shape[1], "h": c.pixels.shape[0], "rgba": np.ascontiguousarray(c.pixels).tobytes()}


def import_rows(project_id: str, source_format: str, decode: Callable[[], Document]) -> Iterator[dict]:
    """The rows of a document, or the one row of the error that stopped it."""
    try:
        rows = list(document_rows(project_id, source_format, decode()))
    except SourceError as e:
        rows = [{"project_id": project_id, "kind": "import_errors", "source_format": source_format, "code": e.code, "message": str(e)}]
    yield from rows


def batches(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    """Record batches of some megabytes of pixels each."""
    some, size = [], 0
    for row in rows:
        some.append(row)
        size += len(row.get("rgba") or b"") + 200
        if size > 16 << 20:
            yield pa.RecordBatch.from_pylist(some, _SCHEMA)
            some, size = [], 0
    if some:
        yield pa.RecordBatch.from_pylist(some, _SCHEMA)


def one_by_one(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of batches, one file's content at a time."""
    for b in parts:
        for k in range(b.num_rows):
            yield b.slice(k, 1).to_pylist()[0]


def sources(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """project_id (the path), name, kind, length, content of the files under path."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.col("path").alias("project_id"), name.alias("name"), source_kind(name, F.lit("")).alias("kind"), "length", "content")


def decode(files: DataFrame) -> DataFrame:
    """ROWS of files (project_id, name, kind, length, content). Files of no kind, or too large, become errors unread."""
    ship_code(files.sparkSession)
    limit = F.coalesce(*[F.when(F.col("kind") == k, F.lit(n)) for k, n in LARGEST.items()], F.lit((1 << 31) - 1))
    files = files.withColumn("large", F.col("length") > limit)
    files = files.withColumn("content", F.when(~F.col("large") & F.col("kind").isNotNull(), F.col("content")))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for r in one_by_one(parts):
                yield from import_rows(r["project_id"], r["kind"] or "unknown", lambda r=r: _import(r))

        yield from batches(rows())

    return files.select("project_id", "kind", "large", "content").mapInArrow(run, ROWS)


def _import(row: dict) -> Document:
    if row["large"]:
        raise SourceError("file-too-large", "the file is too large")
    if row["kind"] not in IMPORTERS:
        raise SourceError("unsupported-source", "no importer takes such a file by itself")
    return IMPORTERS[row["kind"]](row["content"])


def natural(name: str) -> tuple[list[tuple[int, str]], str]:
    """A sort key of names: runs of digits by value, before other text."""
    return [(int(x) if x.isdecimal() else -1, x) for x in re.split(r"([0-9]+)", name)], name


def sequences(files: DataFrame, duration: int = sheets.DURATION) -> DataFrame:
    """ROWS of image sequences: the PNG files of a folder are the frames of a project, in the order of their names, where runs of
    digits go by their value: f2 before f10."""
    ship_code(files.sparkSession)
    files = files.where("kind = 'png'").withColumn("folder", F.regexp_replace("project_id", "/[^/]*$", ""))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        images = [x for _, x in sorted(zip(table.column("name").to_pylist(), table.column("content").to_pylist()), key=lambda x: natural(x[0]))]
        rows = import_rows(key[0].as_py(), "png-sequence", lambda: sheets.png_sequence([png.image(x, "invalid-png") for x in images], duration))
        return pa.Table.from_pylist(list(rows), _SCHEMA)

    return files.select("folder", "name", "content").groupBy("folder").applyInArrow(run, ROWS)


def atlases(files: DataFrame, default_duration: int = sheets.DURATION) -> DataFrame:
    """ROWS of atlases: a .json file and the .png file of the same name beside it. Several of either (of one name but for the case of
    its suffix) are an error, not a choice."""
    ship_code(files.sparkSession)
    stem = F.regexp_replace("project_id", r"\.[^./]*$", "")
    both = files.where("kind in ('json', 'png')").groupBy(stem.alias("project_id")).agg(F.max(F.when(F.col("kind") == "json", F.col("content"))).alias("json"), F.max(F.when(F.col("kind") == "png", F.col("content"))).alias("png"), F.count(F.lit(1)).alias("n"))

    def build(row: dict) -> Document:
        if row["png"] is None:
            raise SourceError("invalid-png", "the sheet is missing")
        if row["n"] > 2:
            raise SourceError("invalid-selection", "there are several sheets or tables of this name")
        return _json(lambda text: sheets.atlas_sheet(png.image(row["png"], "invalid-png"), text, default_duration))(row["json"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(x for r in one_by_one(parts) for x in import_rows(r["project_id"], "atlas", lambda r=r: build(r)))

    return both.where("json is not null").mapInArrow(run, ROWS)


def grids(files: DataFrame, frame_width: int, frame_height: int, rows: int, columns: int, order: str = "row-major", duration: int = sheets.DURATION) -> DataFrame:
    """ROWS of PNG sheets that are cut by one grid."""
    ship_code(files.sparkSession)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def build(data: bytes) -> Document:
            return sheets.grid_sheet(png.image(data, "invalid-png"), frame_width, frame_height, rows, columns, order, duration)

        yield from batches(x for r in one_by_one(parts) for x in import_rows(r["project_id"], "grid", lambda r=r: build(r["content"])))

    return files.where("kind = 'png'").select("project_id", "content").mapInArrow(run, ROWS)


def tables(rows: DataFrame) -> dict[str, DataFrame]:
    """The model's tables, and import_errors, from ROWS. Write rows first (partitioned by kind) to decode but once."""
    of = lambda kind: rows.where(F.col("kind") == kind)
    return {
        "projects": of("projects").select("project_id", "source_format", "width", "height", F.lit("rgba").alias("color_mode")),
        "frames": of("frames").select("project_id", "frame_index", "duration_ms"),
        "frame_tags": of("frame_tags").select("project_id", "tag_index", "name", "from_frame", "to_frame", "direction"),
        "layers": of("layers").select("project_id", "layer_index", "layer_id", "name", "visible", "opacity"),
        "cels": of("cels").select("project_id", "layer_index", "frame_index", "x", "y", "w", "h", F.lit("srgb").alias("color_space"), "rgba"),
        "import_errors": of("import_errors").select("project_id", "source_format", "code", "message"),
    }


def import_sources(spark: SparkSession, path: str, out: str, glob: str | None = None) -> dict[str, DataFrame]:
    """Decodes the files under path once, into Parquet under out by table, and returns the tables."""
    decode(sources(spark, path, glob)).write.mode("overwrite").partitionBy("kind").parquet(out)
    return tables(spark.read.schema(ROWS).parquet(out))


def to_rows(model: dict[str, DataFrame]) -> DataFrame:
    """ROWS from the model's tables."""
    out = None
    for kind in ("projects", "frames", "frame_tags", "layers", "cels"):
        part = model[kind].withColumn("kind", F.lit(kind))
        part = part.select(*[(F.col(f.name) if f.name in part.columns else F.lit(None)).cast(_spark_type(f)).alias(f.name) for f in _SCHEMA])
        out = part if out is None else out.unionByName(part)
    return out


def _spark_type(field: pa.Field) -> str:
    return {pa.string(): "string", pa.int32(): "int", pa.bool_(): "boolean", pa.binary(): "binary"}[field.type]


def build_document(rows: list[dict]) -> Document:
    """The document that the rows of one project hold, whatever their order."""
    by: dict[str, list[dict]] = {k: [] for k in ("projects", "frames", "frame_tags", "layers", "cels")}
    for r in rows:
        by[r["kind"]].append(r)
    head = by["projects"][0]
    layers = [Layer(r["layer_id"], r["name"], r["visible"], r["opacity"]) for r in sorted(by["layers"], key=lambda r: r["layer_index"])]
    for r in sorted(by["cels"], key=lambda r: (r["layer_index"], r["frame_index"])):
        layers[r["layer_index"]].cels.append(Cel(r["frame_index"], np.frombuffer(r["rgba"], np.uint8).reshape(r["h"], r["w"], 4), r["x"], r["y"]))
    tags = [Tag(r["name"], r["from_frame"], r["to_frame"], r["direction"]) for r in sorted(by["frame_tags"], key=lambda r: r["tag_index"])]
    return Document(head["width"], head["height"], [r["duration_ms"] for r in sorted(by["frames"], key=lambda r: r["frame_index"])], layers, tags)


def export(model: dict[str, DataFrame]) -> DataFrame:
    """project_id, content (the binary timeline document), error (why there is none): one row a project.

    A project is built where its rows meet; a document has 4 GiB at most by its format."""
    ship_code(model["projects"].sparkSession)
    schema = pa.schema([("project_id", pa.string()), ("content", pa.binary()), ("error", pa.string())])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        try:
            made = {"content": write(build_document(table.to_pylist())), "error": None}
        except (ExportError, IndexError) as e:
            made = {"content": None, "error": str(e)}
        return pa.Table.from_pylist([made | {"project_id": key[0].as_py()}], schema)

    return to_rows(model).groupBy("project_id").applyInArrow(run, "project_id string, content binary, error string")


def default_name(project_id: str) -> str:
    return posixpath.splitext(posixpath.basename(project_id))[0] or "sprite-project"
