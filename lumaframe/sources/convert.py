"""Conversion by mode: which files a mode takes, one importer for each, and a summary of what came of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import reader, sheets

#: For each mode the kinds it takes, with least and most files of each; other kinds are not allowed.
MODES: dict[str, dict[tuple[str, ...], tuple[int, int | None]]] = {
    "png-sequence": {("png",): (1, None)}, "spritesheet-grid": {("png",): (1, 1)}, "spritesheet-json": {("png",): (1, 1), ("json",): (1, 1)}, "piskel": {("piskel",): (1, 1)}, "pixil": {("pixil",): (1, 1)},
    "gif": {("gif",): (1, 1)}, "apng": {("apng", "png"): (1, 1)}, "openraster": {("ora",): (1, 1)}, "pixelorama": {("pxo",): (1, 1)}, "krita": {("kra",): (1, 1)}, "psd": {("psd",): (1, 1)},
}


def selection_ok(mode: str, kind: Column) -> Column:
    """An aggregate: whether the files of a group are what a mode takes."""
    ok, taken = F.lit(True), F.lit(0)
    for kinds, (least, most) in MODES[mode].items():
        n = F.count_if(kind.isin(*kinds))
        ok = ok & (n >= least) & (n <= most if most is not None else F.lit(True))
        taken = taken + n
    return ok & (taken == F.count(F.lit(1)))


def selections(files: DataFrame, mode: str, key: str = "project_id") -> DataFrame:
    """For each group of files its number, and an error where the mode does not take it."""
    takes = ", ".join(f"{low if low == high else f'{low} or more'} .{' or .'.join(k)}" for k, (low, high) in MODES[mode].items())
    return files.groupBy(key).agg(F.count(F.lit(1)).alias("files"), F.when(~selection_ok(mode, F.col("kind")), F.lit(f"{mode} takes {takes}")).alias("error"))


def refused(files: DataFrame, mode: str, key: str = "project_id") -> DataFrame:
    """project_id, source_format, code, message: a row of import errors for each group of files that a mode does not take."""
    return selections(files, mode, key).where("error is not null").select(F.col(key).alias("project_id"), F.lit(mode).alias("source_format"), F.lit("invalid-selection").alias("code"), F.col("error").alias("message"))


def convert(files: DataFrame, mode: str, duration: int = sheets.DURATION, grid: dict | None = None) -> DataFrame:
    """reader.ROWS of files (of reader.sources) by the importer of a mode. grid: frame_width, frame_height, rows, columns, order.

    Sequences are folders of PNG files, atlases pairs of .png and .json of one name; else a file is a project. Files of kinds that
    the mode does not take are rows of errors (invalid-selection), not left out."""
    kinds = [k for group in MODES[mode] for k in group]
    taken = F.coalesce(F.col("kind").isin(*kinds), F.lit(False))
    error = {"kind": F.lit("import_errors"), "source_format": F.lit(mode), "code": F.lit("invalid-selection"), "message": F.concat(F.lit(f"{mode} takes no such file as "), "name")}
    wrong = files.where(~taken).select(*[error.get(f.name, F.col(f.name) if f.name == "project_id" else F.lit(None)).cast(reader._spark_type(f)).alias(f.name) for f in reader._SCHEMA])
    return _imported(files.where(taken), mode, kinds, duration, grid).unionByName(wrong)


def _imported(files: DataFrame, mode: str, kinds: list[str], duration: int, grid: dict | None) -> DataFrame:
    if mode == "png-sequence":
        return reader.sequences(files, duration)
    if mode == "spritesheet-grid":
        return reader.grids(files, **(grid or {}), duration=duration)
    if mode == "spritesheet-json":
        return reader.atlases(files, duration)
    return reader.decode(files.withColumn("kind", F.lit(kinds[0])))


def summary(tables: dict[str, DataFrame]) -> DataFrame:
    """project_id, frames, layers, cels, total_ms: what each project has."""
    frames = tables["frames"].groupBy("project_id").agg(F.count(F.lit(1)).alias("frames"), F.sum("duration_ms").alias("total_ms"))
    layers = tables["layers"].groupBy("project_id").agg(F.count(F.lit(1)).alias("layers"))
    cels = tables["cels"].groupBy("project_id").agg(F.count(F.lit(1)).alias("cels"))
    out = tables["projects"].select("project_id").join(frames, "project_id", "left").join(layers, "project_id", "left").join(cels, "project_id", "left")
    return out.select("project_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("frames", "layers", "cels", "total_ms")])
