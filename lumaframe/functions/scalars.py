"""Scalar functions of the timeline model, as Column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MAX_DURATION = 65535
#: File extensions and MIME types of the source kinds.
EXTENSIONS = ("png", "json", "piskel", "pixil", "gif", "apng", "ora", "pxo", "kra", "psd")
MIME_TYPES = {
    "image/gif": "gif", "image/apng": "apng", "image/openraster": "ora", "application/x-pixelorama": "pxo", "application/x-krita": "kra", "application/x-kra": "kra",
    "image/vnd.adobe.photoshop": "psd", "image/x-photoshop": "psd", "image/psd": "psd", "application/x-photoshop": "psd", "application/photoshop": "psd", "application/psd": "psd", "image/png": "png",
}
#: From which sizes a selection is large, in bytes and files.
LARGE_BYTES, LONG_SEQUENCE = 64 * 1024 * 1024, 100
#: White space that trimming removes: Unicode spaces, line ends and the byte order mark.
BLANKS = r"[\s\x0B   -     　﻿]"
SAFE_INTEGER, MAX_PATH = (1 << 53) - 1, 512


def half_up(x: Column) -> Column:
    """Rounded to a whole number, halves towards plus infinity."""
    return F.floor(x + 0.5)


def clamp(x: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def normalize_duration(ms: Column) -> Column:
    """Milliseconds as a whole number from 1 to 65535; null for null, NaN and infinities."""
    return F.when(F.abs(ms) < float("inf"), clamp(half_up(ms), 1, MAX_DURATION)).cast("int")


def valid_duration(ms: Column) -> Column:
    return (ms == F.floor(ms)) & ms.between(1, MAX_DURATION)


def gif_delay(centiseconds: Column) -> Column:
    return F.when(centiseconds == 0, 100).otherwise(clamp(centiseconds * 10, 20, MAX_DURATION)).cast("int")


def apng_delay(numerator: Column, denominator: Column) -> Column:
    return clamp(half_up(numerator * 1000 / F.when(denominator == 0, 100).otherwise(denominator)), 1, MAX_DURATION).cast("int")


def piskel_duration(fps: Column) -> Column:
    return normalize_duration(F.lit(1000.0) / fps)


def pixelorama_duration(multiple: Column, fps: Column) -> Column:
    return normalize_duration(multiple * 1000 / fps)


def opacity_byte(share: Column) -> Column:
    return F.floor(share * 255 + 0.5).cast("int")


def psd_opacity(value: Column) -> Column:
    """A share from 0 to 1 is scaled; a whole number up to 255 stands for itself; else null."""
    return F.when(value.between(0, 1), opacity_byte(value)).when((value == F.floor(value)) & value.between(0, 255), value.cast("int"))


def decoded_bytes(*factors: Column) -> Column:
    """4 bytes for each pixel of the product; null where a factor isn't positive or the product isn't a safe integer."""
    product = F.lit(4).cast("bigint")
    ok = F.lit(True)
    for x in factors:
        product = F.try_multiply(product, x.cast("bigint"))
        ok = ok & (x > 0)
    return F.when(ok & (product <= SAFE_INTEGER), product)


def format_file_size(size: Column) -> Column:
    """bytes, KB, MB or GB by 1024, with a decimal under 10 units."""
    out = F.concat(size.cast("string"), F.when(size == 1, " byte").otherwise(" bytes"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        value = size / float(1024**power)
        text = F.when(value >= 10, F.floor(value + 0.5).cast("string")).otherwise(F.format_string("%.1f", F.floor(value * 10 + 0.5) / 10))
        out = F.when(size >= 1024**power, F.concat(text, F.lit(f" {unit}"))).otherwise(out)
    return out


def format_bytes(size: Column) -> Column:
    """MiB, with a decimal unless whole, or KiB rounded up."""
    mib = size / float(1 << 20)
    text = F.when(mib == F.floor(mib), F.floor(mib).cast("string")).otherwise(F.format_string("%.1f", F.floor(mib * 10 + 0.5) / 10))
    return F.when(mib >= 1, F.concat(text, F.lit(" MiB"))).otherwise(F.concat(F.ceil(size / 1024.0).cast("string"), F.lit(" KiB")))


def decoded_estimate(width: Column, height: Column, frames: Column, layers: Column) -> Column:
    """The decoded size and the factors that give it, frames and layers only where there are several; null as decoded_bytes()."""
    several = lambda n, noun: F.when(n > 1, F.concat(F.lit(" x "), n.cast("string"), F.lit(f" {noun}"))).otherwise("")
    factors = F.concat(width.cast("string"), F.lit(" x "), height.cast("string"), F.lit(" x 4 bytes"), several(frames, "frames"), several(layers, "layers"))
    return F.concat(F.lit("about "), format_bytes(decoded_bytes(width, height, frames, layers)), F.lit(" ("), factors, F.lit(")"))


def is_large(total: Column, files: Column, sequence: Column, decoded: Column) -> Column:
    """Whether a selection deserves a warning: long sequences, large sources or large decoded pixels."""
    return (sequence & (files >= LONG_SEQUENCE)) | (total >= LARGE_BYTES) | F.coalesce(decoded >= LARGE_BYTES, F.lit(False))


def nearest_divisor(n: Column, target: Column) -> Column:
    """The divisor of n nearest to target, of two as near the larger; null if either isn't positive."""
    small = F.filter(F.sequence(F.lit(1).cast("bigint"), F.floor(F.sqrt(n.cast("double"))).cast("bigint")), lambda d: n % d == 0)
    both = F.concat(small, F.transform(small, lambda d: (n / d).cast("bigint")))
    best = F.array_min(F.transform(both, lambda d: F.struct(F.abs(target.cast("double") - d).alias("off"), (-d).alias("less"))))
    return F.when((n > 0) & (target > 0), -best["less"])


def exact_fit_grid(width: Column, height: Column, frame_width: Column, frame_height: Column) -> Column:
    """columns, rows, frame_width, frame_height of the grid nearest to a frame size that covers the image exactly."""
    columns, rows = nearest_divisor(width, width / frame_width), nearest_divisor(height, height / frame_height)
    return F.struct(columns.alias("columns"), rows.alias("rows"), (width / columns).cast("bigint").alias("frame_width"), (height / rows).cast("bigint").alias("frame_height"))


def _parts(width: Column, height: Column, across: Column, down: Column, names: tuple[str, str]) -> Column:
    ok = (width > 0) & (height > 0) & (across > 0) & (down > 0)
    whole = lambda a, b: F.when(ok, F.floor(a / b).cast("bigint"))
    return F.struct(whole(width, across).alias(names[0]), whole(height, down).alias(names[1]))


def grid_from_frame_size(width: Column, height: Column, frame_width: Column, frame_height: Column) -> Column:
    """columns, rows of whole frames of a size in an image; null where a size isn't positive."""
    return _parts(width, height, frame_width, frame_height, ("columns", "rows"))


def frame_size_from_grid(width: Column, height: Column, columns: Column, rows: Column) -> Column:
    """frame_width, frame_height of the frames that a grid cuts an image into; null where a number isn't positive."""
    return _parts(width, height, columns, rows, ("frame_width", "frame_height"))


def grid_state(width: Column, height: Column, frame_width: Column, frame_height: Column, rows: Column, columns: Column) -> Column:
    """valid, invalid, exceeds or uncovered."""
    positive = (frame_width > 0) & (frame_height > 0) & (rows > 0) & (columns > 0)
    w, h = frame_width * columns, frame_height * rows
    return F.when(~positive, "invalid").when((w > width) | (h > height), "exceeds").when((w != width) | (h != height), "uncovered").otherwise("valid")


def grid_row(i: Column, rows: Column, columns: Column, column_major: bool = False) -> Column:
    return (i % rows if column_major else F.floor(i / columns)).cast("int")


def grid_column(i: Column, rows: Column, columns: Column, column_major: bool = False) -> Column:
    return (F.floor(i / rows) if column_major else i % columns).cast("int")


def source_kind(name: Column, mime: Column) -> Column:
    """The kind of a source by its extension, else by its MIME type, else null."""
    extension = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    by_mime = F.lit(None).cast("string")
    for known, kind in MIME_TYPES.items():
        by_mime = F.when(F.lower(mime) == known, kind).otherwise(by_mime)
    return F.when(extension.isin(*EXTENSIONS), extension).otherwise(by_mime)


def unsafe_path(path: Column) -> Column:
    """Empty, too long, absolute, with a scheme, a backslash, a NUL, or a part that is empty, . or .. (one slash at the end is allowed)."""
    parts = F.split(F.regexp_replace(path, "/$", ""), "/")
    return (path == "") | (utf16_length(path) > MAX_PATH) | F.contains(path, F.lit("\\")) | F.contains(path, F.lit("\x00")) | path.rlike("^(/|[A-Za-z][A-Za-z0-9+.-]*:)") | F.exists(parts, lambda p: p.isin("", ".", ".."))


def strict_integer(text: Column) -> Column:
    """A canonical decimal whole number as bigint, else null."""
    return F.when(text.rlike(r"\A(?:0|[1-9][0-9]*)\z"), F.try_to_number(text, F.lit("9" * 18)).cast("bigint"))


def signed_integer(text: Column) -> Column:
    """A canonical whole number of 16 bits with a sign, 0 if missing, else null."""
    value = text.try_cast("int")
    return F.when(text.isNull(), 0).when(text.rlike(r"\A-?(?:0|[1-9][0-9]{0,4})\z") & value.between(-32768, 32767) & (text != "-0"), value)


def strict_base64(text: Column) -> Column:
    """Whether text is canonical base64: whole groups of four, padding only at the end, no bits left over."""
    shape = text.rlike(r"\A(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z")
    return shape & ~text.rlike(r"(?:[^AQgw]==|[^AEIMQUYcgkosw048=]=)\z")


def layer_identity(unique_id: Column, layer_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("unqid:"), unique_id), F.concat(F.lit("id:"), layer_id))


def layer_name(name: Column, index: Column) -> Column:
    """The name, or one by position where it is missing."""
    return F.coalesce(name, F.concat(F.lit("Layer "), (index + 1).cast("string")))


def valid_name(name: Column) -> Column:
    """Not blank once white space of all kinds is trimmed."""
    return F.coalesce(F.regexp_replace(name, BLANKS, "") != "", F.lit(False))


def valid_direction(direction: Column) -> Column:
    return direction.isin("forward", "reverse", "ping-pong")


def direction(source: Column) -> Column:
    return F.when(source == "pingpong", "ping-pong").otherwise(source)


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def tile_limit(size: Column) -> Column:
    return F.ceil(size / 64.0).cast("int")


def slug(title: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", " ")), " ", "-")


def frame_size(width: Column, height: Column, rotated: Column, trimmed: Column, source_width: Column, source_height: Column) -> Column:
    """Width and height of an atlas frame: the source's where trimmed, else swapped where rotated."""
    w = F.when(trimmed, source_width).when(rotated, height).otherwise(width)
    h = F.when(trimmed, source_height).when(rotated, width).otherwise(height)
    return F.struct(w.alias("width"), h.alias("height"))


def atlas_format(app: Column, has_textures: Column, has_animations: Column, variant: Column) -> Column:
    """family and variant of an atlas, by the first rule that holds. variant: array, hash or root-frames by the type of
    its frames, null where it has none; has_textures: whether the key is there; has_animations: whether it is an object."""
    says = lambda word: F.contains(F.lower(F.coalesce(app, F.lit(""))), F.lit(word))
    shape = F.coalesce(variant, F.lit("root-frames"))
    of = lambda family, kind: F.struct(F.lit(family).alias("family"), kind.alias("variant"))
    return (
        F.when(says("aseprite"), of("aseprite", shape))
        .when(has_textures, of("phaser-pixi", F.lit("multiatlas")))
        .when(says("phaser") | says("pixi") | has_animations, of("phaser-pixi", shape))
        .when(says("texturepacker") | shape.isin("array", "hash"), of("texturepacker", shape))
        .otherwise(of("unknown", F.coalesce(variant, F.lit("unknown"))))
    )


def atlas_label(family: Column, variant: Column) -> Column:
    # fixed values: the labels
    tool = F.when(variant == "array", "TexturePacker Array").when(variant == "hash", "TexturePacker Hash").otherwise("TexturePacker")
    pixi = F.when(variant == "multiatlas", "Phaser Multi-Atlas").otherwise("Phaser/Pixi-compatible atlas")
    return F.when(family == "aseprite", "Aseprite JSON").when(family == "texturepacker", tool).when(family == "phaser-pixi", pixi).otherwise("Atlas JSON")
