"""Texts for people: what was selected, what a conversion gave, why it failed. Column expressions over a lookup by mode."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: For each mode what one of its sources is called, what a source must be, and whether its layers are worth counting. The modes.
MODES = {
    "png-sequence": ("PNG sequence", "every file is a PNG image of the same size", False), "spritesheet-grid": ("sprite sheet", "the frames of the grid lie within the image", False),
    "spritesheet-json": ("sprite atlas", "the table's frames lie within the image", False), "piskel": ("Piskel file", "it is of model version 2", True), "pixil": ("Pixil project", "its frames hold layers of PNG images", True),
    "gif": ("GIF animation", "it is whole and uses no extension that changes its pixels", False), "apng": ("APNG animation", "it is whole and its frames lie within the canvas", False),
    "openraster": ("OpenRaster project", "its layers are plain PNG images", True), "pixelorama": ("Pixelorama project", "its layers are of pixels", True), "krita": ("Krita project", "its layers are paint layers of 8-bit RGBA", True),
    "psd": ("PSD project", "its layers are rasters of 8-bit RGB", True),
}
#: The mode that a kind of file calls for, the first that is there winning. Fixed values.
KINDS = {"piskel": "piskel", "pixil": "pixil", "gif": "gif", "apng": "apng", "ora": "openraster", "pxo": "pixelorama", "kra": "krita", "psd": "psd", "json": "spritesheet-json"}


def _lookup(mode: Column, field: int, absent: str | bool) -> Column:
    table = F.create_map(*[F.lit(x) for m, values in MODES.items() for x in (m, values[field])])
    return F.coalesce(F.element_at(table, F.coalesce(mode, F.lit(""))), F.lit(absent))


def counted(n: Column, noun: str) -> Column:
    """1 frame, 2 frames."""
    return F.concat(n.cast("string"), F.when(n == 1, f" {noun}").otherwise(f" {noun}s"))


def mode_of(kinds: Column) -> Column:
    """The mode that an array of kinds of files calls for where none was chosen: null for a single image, or no file."""
    by_kind = [F.when(F.array_contains(kinds, kind), F.lit(mode)) for kind, mode in KINDS.items()]
    return F.coalesce(*by_kind, F.when(F.size(kinds) > 1, F.lit("png-sequence")))


def diagnostic(code: Column, message: Column) -> Column:
    """An importer's own message on one line; null where no code says that an importer wrote it, or where it is blank."""
    line = F.trim(F.regexp_replace(message, r"\s+", " "))
    return F.when(code.isNotNull() & (line != ""), line)


def selection_status(mode: Column, files: Column) -> Column:
    """What was selected: a project by its name, other files by their number."""
    single = mode.isin(*[m for m in MODES if m not in ("png-sequence", "spritesheet-grid", "spritesheet-json")])
    named = F.concat(F.lit("Selected 1 "), _lookup(mode, 0, "PNG image"), F.lit("."))
    return F.when(single, named).otherwise(F.concat(F.lit("Selected "), counted(files, "file"), F.lit(".")))


def success_status(mode: Column, frames: Column, layers: Column) -> Column:
    """What a conversion gave: frames, and layers in modes whose sources have them."""
    with_layers = F.when(_lookup(mode, 2, False), F.concat(F.lit(" and "), counted(layers, "layer"))).otherwise("")
    return F.concat(F.lit("Converted a "), _lookup(mode, 0, "PNG image"), F.lit(" of "), counted(frames, "frame"), with_layers, F.lit("."))


def failure_status(mode: Column, code: Column, message: Column) -> Column:
    """Why a conversion failed: the importer's own message, or what to check; what others threw is not shown."""
    told = diagnostic(code, message)
    check = F.concat(F.lit("check that "), _lookup(mode, 1, "it is a PNG image"), F.lit("."))
    return F.concat(F.lit("Could not convert the "), _lookup(mode, 0, "PNG image"), F.lit(": "), F.coalesce(told, check))
