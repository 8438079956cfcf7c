"""Sheets and JSON documents: image sequences, grids, atlases, Piskel and Pixil projects."""

from __future__ import annotations

import base64
import binascii
import re

import numpy as np

from . import png
from .document import Cel, Document, Layer, SourceError, Tag, clamp_duration, main_layer, need, opacity_byte
from .layered import closed, is_number, is_whole, parse_json

DURATION = 100
_WHOLE = re.compile(r"0|[1-9][0-9]*")


def natural(v: object, least: int = 0) -> bool:
    return is_whole(v) and v >= least


def _duration(ms: object, code: str = "invalid-field") -> int:
    need(natural(ms, 1), code, "a duration must be a positive whole number of milliseconds")
    return int(ms)


def png_sequence(images: list[np.ndarray], duration: int = DURATION) -> Document:
    """Images in the order given, all of one size, as the frames of one layer."""
    need(images, "invalid-sequence", "a sequence needs an image")
    ms = _duration(duration)
    need(len({x.shape for x in images}) == 1, "invalid-sequence", "the images of a sequence must have one size")
    height, width = images[0].shape[:2]
    return main_layer(width, height, [ms] * len(images), images)


def grid_sheet(sheet: np.ndarray, frame_width: int, frame_height: int, rows: int, columns: int, order: str = "row-major", duration: int = DURATION) -> Document:
    """Frames of a sheet that a grid covers exactly, row by row or column by column."""
    need(all(natural(v, 1) for v in (frame_width, frame_height, rows, columns)), "invalid-grid", "a grid needs positive whole numbers")
    need(order in ("row-major", "column-major"), "invalid-grid", "the order must be row-major or column-major")
    ms = _duration(duration, "invalid-grid")
    need(sheet.shape[:2] == (rows * frame_height, columns * frame_width), "invalid-grid", "the grid does not cover the sheet exactly")
    cells = sheet.reshape(rows, frame_height, columns, frame_width, 4).transpose((0, 2, 1, 3, 4) if order == "row-major" else (2, 0, 1, 3, 4))
    return main_layer(frame_width, frame_height, [ms] * (rows * columns), list(cells.reshape(-1, frame_height, frame_width, 4).copy()))


def atlas_format(value: object) -> tuple[str, str]:
    """Family and variant of an atlas; functions.scalars.atlas_format says the rules."""
    if not isinstance(value, dict):
        return "unknown", "unknown"
    meta, frames = value.get("meta"), value.get("frames")
    app = meta.get("app") if isinstance(meta, dict) else ""
    app = app.lower() if isinstance(app, str) else ""
    variant = "array" if isinstance(frames, list) else "hash" if isinstance(frames, dict) else "root-frames"
    if "aseprite" in app:
        return "aseprite", variant
    if "textures" in value:
        return "phaser-pixi", "multiatlas"
    if "phaser" in app or "pixi" in app or isinstance(value.get("animations"), dict):
        return "phaser-pixi", variant
    if "texturepacker" in app or variant != "root-frames":
        return "texturepacker", variant
    return "unknown", "root-frames" if "frames" in value else "unknown"


def in_object_order(pairs: dict) -> list:
    """Values of an object as scripts list them: keys that are array indexes ascending, then the others as written."""
    index = {k: int(k) for k in pairs if _WHOLE.fullmatch(k) and int(k) < (1 << 32) - 1}
    return [pairs[k] for k in (*sorted(index, key=index.get), *(k for k in pairs if k not in index))]


def _numbers(v: object, least: dict[str, int], what: str) -> dict[str, int]:
    need(isinstance(v, dict), "invalid-field", f"{what} must be an object")
    for k, low in least.items():
        need(natural(v.get(k), low), "invalid-field", f"{what}.{k} must be a whole number from {low}")
    return {k: int(v[k]) for k in least}


def _atlas_frame(v: object, default: int) -> dict:
    need(isinstance(v, dict), "invalid-field", "a frame must be an object")
    for k in ("rotated", "trimmed"):
        need(k not in v or isinstance(v[k], bool), "invalid-field", f"{k} must be true or false")
    rect = _numbers(v.get("frame"), {"x": 0, "y": 0, "w": 1, "h": 1}, "frame")
    out = {"rect": rect, "rotated": v.get("rotated", False), "trim": None, "duration": _duration(default if v.get("duration") is None else v["duration"])}
    w, h = (rect["h"], rect["w"]) if out["rotated"] else (rect["w"], rect["h"])
    out["size"] = (w, h)
    if v.get("trimmed"):
        source = _numbers(v.get("sourceSize"), {"w": 1, "h": 1}, "sourceSize")
        at = _numbers(v.get("spriteSourceSize"), {"x": 0, "y": 0, "w": 1, "h": 1}, "spriteSourceSize")
        bad = "invalid-frame-geometry"
        need((at["w"], at["h"]) == (w, h), bad, "a trimmed frame has another size than its place")
        need(at["x"] + w <= source["w"] and at["y"] + h <= source["h"], bad, "a trimmed frame reaches beyond its source")
        need((at["x"], at["y"], w, h) != (0, 0, source["w"], source["h"]), bad, "a trimmed frame is not trimmed")
        out |= {"trim": (at["x"], at["y"]), "size": (source["w"], source["h"])}
    return out


def _atlas_tags(value: dict, frames: int) -> list[Tag]:
    meta = value.get("meta")
    tags = meta.get("frameTags", []) if isinstance(meta, dict) else []
    need(isinstance(tags, list), "invalid-field", "frameTags must be a list")
    out: list[Tag] = []
    for t in tags:
        ends = _numbers(t, {"from": 0, "to": 0}, "a tag")
        name = t.get("name")
        need(isinstance(name, str) and name.strip() and name not in [x.name for x in out], "invalid-field", "a tag needs a name of its own")
        need(ends["from"] <= ends["to"] < frames, "invalid-field", "a tag's frames do not exist")
        need(t.get("direction") in ("forward", "reverse", "pingpong"), "invalid-field", "a tag's direction is not known")
        out.append(Tag(name, ends["from"], ends["to"], t["direction"].replace("pingpong", "ping-pong")))
    return out


def parse_atlas(source: str, default_duration: int = DURATION) -> tuple[list[dict], list[Tag]]:
    """Frames and tags of an atlas."""
    _duration(default_duration)
    value = parse_json(source)
    family, variant = atlas_format(value)
    need(isinstance(value, dict), "unknown-schema", "an atlas must be an object")
    if variant == "multiatlas":
        pages = value["textures"]
        need(isinstance(pages, list) and pages and all(isinstance(p, dict) and isinstance(p.get("frames"), list) for p in pages), "invalid-field", "textures must list pages with frames")
        raise SourceError("unsupported-variant", "atlases of several pages are not supported")
    need((family, variant) != ("unknown", "unknown"), "unknown-schema", "the atlas has no frames")
    frames = value.get("frames")
    need(isinstance(frames, (list, dict)) and frames, "invalid-field", "frames must be a list or an object that isn't empty")
    parsed = [_atlas_frame(f, default_duration) for f in (in_object_order(frames) if isinstance(frames, dict) else frames)]
    return parsed, _atlas_tags(value, len(parsed)) if family == "aseprite" else []


def cut_frame(sheet: np.ndarray, frame: dict) -> np.ndarray:
    """A frame's pixels: cut from the sheet, turned back by 90 degrees if rotated, put in its place if trimmed."""
    r = frame["rect"]
    need(r["x"] + r["w"] <= sheet.shape[1] and r["y"] + r["h"] <= sheet.shape[0], "invalid-frame-geometry", "a frame reaches beyond the sheet")
    part = sheet[r["y"] : r["y"] + r["h"], r["x"] : r["x"] + r["w"]]
    if frame["rotated"]:
        part = np.rot90(part, 1)
    if frame["trim"] is None:
        return np.ascontiguousarray(part)
    x, y = frame["trim"]
    canvas = np.zeros((frame["size"][1], frame["size"][0], 4), np.uint8)
    canvas[y : y + part.shape[0], x : x + part.shape[1]] = part
    return canvas


def atlas_sheet(sheet: np.ndarray, source: str, default_duration: int = DURATION) -> Document:
    frames, tags = parse_atlas(source, default_duration)
    need(len({f["size"] for f in frames}) == 1, "invalid-frame-geometry", "the frames must have one size")
    width, height = frames[0]["size"]
    return main_layer(width, height, [f["duration"] for f in frames], [cut_frame(sheet, f) for f in frames], tags=tags)


def strict_base64(text: str, code: str) -> bytes:
    """Canonical base64: whole groups, padding at the end, and no bits left over."""
    try:
        data = base64.b64decode(text, validate=True) if text else b""
    except (binascii.Error, ValueError):
        data = b""
    need(data and base64.b64encode(data).decode() == text, code, "the base64 is malformed")
    return data


PISKEL_SIDE, PISKEL_PREFIX = 1024, "data:image/png;base64,"
#: The fields of a Piskel file, its project, a layer and a chunk.
PISKEL_OUTER = {"modelVersion", "piskel"}
PISKEL_PROJECT = {"description", "expanded", "fps", "height", "hiddenFrames", "layers", "name", "width"}
PISKEL_LAYER, PISKEL_CHUNK = {"base64PNG", "chunks", "frameCount", "name", "opacity", "visible"}, {"base64PNG", "layout"}


def _piskel_fields(v: object, allowed: set[str], required: list[str], what: str, code: str) -> dict:
    need(isinstance(v, dict), code, f"{what} must be an object")
    closed(v, allowed, set(), what, code, "unsupported-field")
    need(set(required) <= v.keys(), "missing-field", f"{what} lacks a field")
    return v


def import_piskel(source: str) -> Document:
    bad = "invalid-field"
    outer = _piskel_fields(parse_json(source), PISKEL_OUTER, ["modelVersion", "piskel"], "the file", bad)
    need(is_whole(outer["modelVersion"]) and outer["modelVersion"] == 2, "unsupported-model-version", "only model version 2 is supported")
    p = _piskel_fields(outer["piskel"], PISKEL_PROJECT, ["name", "fps", "height", "width", "layers"], "the project", bad)
    need(isinstance(p["name"], str) and p["name"].strip(), bad, "the project has no name")
    need(isinstance(p.get("description", ""), str) and isinstance(p.get("expanded", False), bool), bad, "a field has another type")
    need(is_number(p["fps"]) and p["fps"] > 0, "invalid-fps", "fps must be positive")
    need(all(natural(p[k], 1) and p[k] <= PISKEL_SIDE for k in ("width", "height")), "invalid-dimension", "the canvas is empty or too large")
    need(isinstance(p["layers"], list) and p["layers"], bad, "layers must be a list that isn't empty")
    width, height, count, layers = int(p["width"]), int(p["height"]), None, []
    for encoded in p["layers"]:
        layer = _piskel_layer(encoded, width, height, count)
        count = layer["frames"]
        layers.append(layer)
    shown = _piskel_visible(p.get("hiddenFrames", ""), count)
    out = []
    for i, layer in enumerate(layers):
        images: dict[int, np.ndarray] = {}
        for layout, data in layer["chunks"]:
            sheet = png.image(data, "browser-image-decode")
            for c, column in enumerate(layout):
                for r, f in enumerate(column):
                    images[f] = sheet[r * height : (r + 1) * height, c * width : (c + 1) * width].copy()
        out.append(Layer(f"piskel-layer-{i}", layer["name"], layer["visible"], layer["opacity"], [Cel(k, images[f]) for k, f in enumerate(shown)]))
    return Document(width, height, [clamp_duration(1000 / p["fps"])] * len(shown), out)


def _piskel_layer(encoded: object, width: int, height: int, count: int | None) -> dict:
    bad = "invalid-layer-json"
    need(isinstance(encoded, str), bad, "a layer must be JSON in a string")
    v = _piskel_fields(parse_json(encoded, bad), PISKEL_LAYER, ["name", "frameCount"], "a layer", bad)
    need("chunks" not in v or "base64PNG" not in v, "legacy-layer-layout", "a layer has chunks and a sheet")
    need("chunks" in v or "base64PNG" in v, "missing-chunks", "a layer has no pixels")
    bad = "invalid-field"
    need(isinstance(v["name"], str) and v["name"].strip(), bad, "a layer has no name")
    opacity = 1 if v.get("opacity") is None else v["opacity"]
    need(is_number(opacity) and 0 <= opacity <= 1, bad, "an opacity must be from 0 to 1")
    need(isinstance(v.get("visible", True), bool), bad, "visible must be true or false")
    need(natural(v["frameCount"], 1), bad, "a frame count must be positive")
    frames = int(v["frameCount"])
    need(count in (None, frames), "frame-coverage", "all layers must have one frame count")
    chunks = v["chunks"] if "chunks" in v else [{"layout": [[f] for f in range(frames)], "base64PNG": v["base64PNG"]}]
    need(isinstance(chunks, list) and chunks, "missing-chunks", "a layer has no chunks")
    covered: set[int] = set()
    parsed = [_piskel_chunk(c, width, height, frames, covered) for c in chunks]
    need(len(covered) == frames, "frame-coverage", "a layer lacks frames")
    return {"name": v["name"], "opacity": opacity_byte(opacity), "visible": v.get("visible", True), "frames": frames, "chunks": parsed}


def _piskel_chunk(v: object, width: int, height: int, frames: int, covered: set[int]) -> tuple[list[list[int]], bytes]:
    bad = "invalid-chunk-layout"
    v = _piskel_fields(v, PISKEL_CHUNK, ["layout", "base64PNG"], "a chunk", bad)
    layout = v["layout"]
    need(isinstance(layout, list) and layout and all(isinstance(c, list) and c for c in layout), bad, "a layout must be columns of frames")
    for column in layout:
        need(len(column) == len(layout[0]), bad, "a layout must be rectangular")
        for f in column:
            need(natural(f) and f < frames, bad, "a layout has a frame that does not exist")
            need(f not in covered, "frame-coverage", "a layout has a frame twice")
            covered.add(int(f))
    url = v["base64PNG"]
    need(isinstance(url, str) and url.startswith(PISKEL_PREFIX), "invalid-png-data-url", "a sheet must be a PNG data URL")
    data = strict_base64(url.removeprefix(PISKEL_PREFIX), "invalid-png-data-url")
    need(png.size_of(data, "invalid-png-data-url") == (width * len(layout), height * len(layout[0])), "png-dimension-mismatch", "a sheet has another size than its layout")
    return [[int(f) for f in c] for c in layout], data


def _piskel_visible(hidden: object, count: int) -> list[int]:
    """Frames that are shown. An empty string hides none; a list has numbers, or strings of them, and empty strings."""
    bad = "hidden-frames"
    if hidden == "":
        return list(range(count))
    need(isinstance(hidden, list), bad, "hidden frames must be a list")
    gone: set[int] = set()
    for f in hidden:
        if f == "":
            continue
        f = int(f) if isinstance(f, str) and _WHOLE.fullmatch(f) else f
        need(natural(f) and f < count and f not in gone, bad, "a hidden frame does not exist, or is there twice")
        gone.add(int(f))
    need(len(gone) < count, bad, "all frames are hidden")
    return [f for f in range(count) if f not in gone]


PIXIL_FILE, PIXIL_SIDE, PIXIL_FRAMES, PIXIL_LAYERS, PIXIL_CELS, PIXIL_BYTES, PIXIL_TEXT = 96 << 20, 1024, 512, 64, 4096, 64 << 20, 1024


def _pixil(v: object, *fields: str) -> list:
    need(isinstance(v, dict) and set(fields) <= v.keys(), "invalid-project", "an object lacks a field")
    return [v[f] for f in fields]


def _pixil_whole(v: object) -> int:
    v = int(v) if isinstance(v, str) and _WHOLE.fullmatch(v) else v
    need(is_whole(v), "invalid-project", "a number is malformed")
    return int(v)


def _pixil_size(v: object) -> int:
    v = _pixil_whole(v)
    need(1 <= v <= PIXIL_SIDE, "allocation-limit", "the canvas is empty or too large")
    return v


def _pixil_text(v: object) -> str:
    need(isinstance(v, str) and v.strip() and len(v.encode("utf-16-le", "surrogatepass")) <= 2 * PIXIL_TEXT, "invalid-project", "a text is blank or too long")
    return v


def _pixil_opacity(v: object) -> int:
    v = float(v) if isinstance(v, str) and re.fullmatch(r"0(?:\.[0-9]+)?|1(?:\.0+)?", v) else v
    need(is_number(v) and 0 <= v <= 1, "invalid-project", "an opacity must be from 0 to 1")
    return opacity_byte(v)


def import_pixil(source: str) -> Document:
    bad, big = "invalid-project", "allocation-limit"
    need(len(source) <= PIXIL_FILE, "file-too-large", "the file is too large")
    d = parse_json(source)
    need(isinstance(d, dict), "invalid-container", "the file must be an object")
    need("pixil" not in d, "unsupported-version", "an old form of the file is not supported")
    need((d.get("application"), d.get("type"), d.get("website")) == ("pixil", ".pixil", "pixilart.com"), "invalid-container", "the file does not say what it is")
    need(d.get("version") == "2.7.0", "unsupported-version", "only version 2.7.0 is supported")
    width, height = map(_pixil_size, _pixil(d, "width", "height"))
    (frames,) = _pixil(d, "frames")
    need(isinstance(frames, list), bad, "frames must be a list")
    need(1 <= len(frames) <= PIXIL_FRAMES, big, "there are no frames, or too many")
    durations, layers, order, total = [], {}, None, 0
    for f, frame in enumerate(frames):
        w, h, speed, values = _pixil(frame, "width", "height", "speed", "layers")
        need((_pixil_size(w), _pixil_size(h)) == (width, height), bad, "a frame has another size than the canvas")
        need(_pixil_whole(speed) >= 1, bad, "a speed must be positive")
        durations.append(clamp_duration(_pixil_whole(speed)))
        need(isinstance(values, list), bad, "layers must be a list")
        need(1 <= len(values) <= PIXIL_LAYERS, big, "there are no layers, or too many")
        keys: list[str] = []
        for v in values:
            key, name, opacity, data = _pixil_layer(v)
            need(key not in keys, bad, "a frame has a layer twice")
            keys.append(key)
            total += len(data)
            need(total <= PIXIL_BYTES, big, "all images together are too large")
            layer = layers.setdefault(key, (name, opacity, []))
            need(layer[:2] == (name, opacity), bad, "a layer's name or opacity changes")
            layer[2].append(data)
        order = order or keys
        need(keys == order, bad, "layers change from frame to frame")
    cels = len(frames) * len(order)
    need(cels <= PIXIL_CELS and width * height * 4 * cels <= PIXIL_BYTES, big, "there are too many cels or pixels")
    out = []
    for i, key in enumerate(order):
        name, opacity, images = layers[key]
        pixels = [png.image(x, "browser-image-decode") for x in images]
        need(all(x.shape == (height, width, 4) for x in pixels), "png-dimension-mismatch", "an image has another size than the canvas")
        out.append(Layer(f"pixil-layer-{i}", name, True, opacity, [Cel(f, x) for f, x in enumerate(pixels)]))
    return Document(width, height, durations, out)


def _pixil_layer(v: object) -> tuple[str, str, int, bytes]:
    need(isinstance(v, dict), "invalid-project", "a layer must be an object")
    if "unqid" in v:
        key = f"unqid:{_pixil_text(v['unqid'])}"
    else:
        number = _pixil_whole(*_pixil(v, "id"))
        need(number >= 0, "invalid-project", "an id must not be negative")
        key = f"id:{number}"
    options, name, opacity, src = _pixil(v, "options", "name", "opacity", "src")
    need(isinstance(options, dict), "invalid-project", "options must be an object")
    need(options.get("blend") == "source-over", "unsupported-feature", "a blend mode is not supported")
    need(isinstance(v.get("active", False), bool), "invalid-project", "active must be true or false")
    name, opacity = _pixil_text(name), _pixil_opacity(opacity)
    need(isinstance(src, str) and "base64," in src, "invalid-pixels", "an image must be embedded as base64")
    data = strict_base64(src.partition("base64,")[2], "invalid-pixels")
    need(data.startswith(png.SIGNATURE), "invalid-pixels", "an image is not a PNG image")
    return key, name, opacity, data
