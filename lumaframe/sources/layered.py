"""Layered documents: OpenRaster, Pixelorama and Krita archives, and PSD files."""

from __future__ import annotations

import json
import math
import re
import struct

import numpy as np

from . import archive as z, png
from .document import Cel, Document, Layer, SourceError, clamp_duration, need, opacity_byte

#: The duration of the only frame of a still document.
STILL = 100
INT16 = (-32768, 32767)

ORA = z.Limits(entries=4096, total=64 << 20, path=512, entry=32 << 20, any_flags=True, file=16 << 20)
ORA_SIDE, ORA_CANVAS, ORA_LAYERS, ORA_PIXELS, ORA_XML = 4096, 16_777_216, 256, 67_108_864, 1 << 20


def _mimetype(entries: list[z.Entry], expected: bytes) -> None:
    need(entries[0].name == "mimetype" and entries[0].method == z.STORED and entries[0].content == expected, "invalid-mimetype", "the archive must start with its type, stored")


def import_ora(data: bytes) -> Document:
    entries = z.read(data, ORA)
    _mimetype(entries, b"image/openraster")
    named = z.by_name(entries)
    stack = z.require(named, "stack.xml")
    need(len(stack) <= ORA_XML, "allocation-limit", "stack.xml is too large")
    width, height, layers = _ora_stack(z.parse_xml(z.text(stack, "invalid-container"), "invalid-stack"))
    out, pixels = [], 0
    for i, (name, src, visible, opacity, x, y) in enumerate(layers):
        content = z.require(named, src)
        w, h = png.size_of(content, "invalid-png", ORA_SIDE, still=True)
        need(w * h <= ORA_CANVAS, "allocation-limit", "a layer has too many pixels")
        pixels += w * h
        need(pixels <= ORA_PIXELS, "allocation-limit", "all layers together have too many pixels")
        out.append(Layer(f"openraster-layer-{i}", name, visible, opacity, [Cel(0, png.image(content, "browser-image-decode"), x, y)]))
    return Document(width, height, [STILL], out)


def _ora_stack(root: z.Element) -> tuple[int, int, list[tuple]]:
    bad = "invalid-stack"
    need(root.name == "image", bad, "the root must be <image>")
    z.only(root, "h", "version", "w", "xres", "yres")
    width, height = (z.whole(root.attributes.get(k), bad, 1, ORA_SIDE, "allocation-limit") for k in "wh")
    need(width * height <= ORA_CANVAS, "allocation-limit", "the canvas is too large")
    need(not any(z.is_animation(c.name) for c in root.children), "unsupported-feature", "animations are not supported")
    need([c.name for c in root.children] == ["stack"], bad, "<image> must hold one <stack>")
    stack = root.children[0]
    z.only(stack, "name")
    need(stack.children, bad, "the stack has no layer")
    need(len(stack.children) <= ORA_LAYERS, "allocation-limit", "there are too many layers")
    return width, height, [_ora_layer(c, i) for i, c in enumerate(stack.children)]


def _ora_layer(e: z.Element, i: int) -> tuple:
    bad, a = "invalid-stack", e.attributes
    need(e.name == "layer", "unsupported-feature", f"<{e.name}> in a stack is not supported")
    z.only(e, "composite-op", "name", "opacity", "src", "visibility", "x", "y")
    need(not e.children, "unsupported-feature", "content of layers is not supported")
    need(a.get("composite-op", "svg:src-over") == "svg:src-over", "unsupported-feature", "a blend mode is not supported")
    need("src" in a, bad, "a layer has no src")
    need(not z.unsafe(a["src"], ORA.path, directory=False), "unsafe-path", "a layer has an unsafe path")
    name, opacity = a.get("name", f"Layer {i + 1}"), a.get("opacity", "1")
    need(name.strip(), bad, "a layer has a blank name")
    need(re.fullmatch(r"0|0\.[0-9]+|1|1\.0+", opacity), bad, "an opacity must be from 0 to 1")
    need(a.get("visibility", "visible") in ("visible", "hidden"), bad, "a visibility is malformed")
    x, y = (z.whole(a.get(k), bad, *INT16, default="0") for k in "xy")
    return name, a["src"], a.get("visibility") != "hidden", opacity_byte(float(opacity)), x, y


PXO = z.Limits(entries=512, total=64 << 20, path=512, file=25 << 20)
PXO_SIDE, PXO_FRAMES, PXO_LAYERS, PXO_CELS, PXO_BYTES, PXO_JSON, PXO_TEXT = 1024, 512, 64, 4096, 64 << 20, 5 << 20, 1024
#: The fields of a project, by what each must hold.
PXO_EMPTY_TEXT = ("author_company", "author_contact", "author_display_name", "author_real_name", "license", "project_current_palette_name", "user_data")
PXO_EMPTY_LISTS = ("brushes", "guides", "palettes", "reference_images", "tags", "tilesets", "vanishing_points")
PXO_WHOLE = ("current_frame", "current_layer", "export_file_format", "tile_mode_x_basis_x", "tile_mode_x_basis_y", "tile_mode_y_basis_x", "tile_mode_y_basis_y")
PXO_TEXTS = ("export_directory_path", "export_file_name")
PXO_FIELDS = {*PXO_EMPTY_TEXT, *PXO_EMPTY_LISTS, *PXO_WHOLE, *PXO_TEXTS, "color_mode", "fps", "frames", "layers", "metadata", "pixelorama_version", "pxo_version", "size_x", "size_y", "symmetry_points"}
PXO_LAYER = {"blend_mode", "clipping_mask", "effects", "locked", "metadata", "name", "new_cels_linked", "opacity", "parent", "type", "ui_color", "visible"}
PXO_FRAME, PXO_CEL = {"cels", "duration", "metadata", "user_data"}, {"metadata", "opacity", "ui_color", "user_data", "z_index"}


def is_number(v: object) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v)


def is_whole(v: object) -> bool:
    return is_number(v) and v == int(v) and abs(v) < 1 << 53


def is_text(v: object) -> bool:
    """A string of at most PXO_TEXT UTF-16 units."""
    return isinstance(v, str) and len(v.encode("utf-16-le", "surrogatepass")) <= 2 * PXO_TEXT


def closed(v: object, allowed: set[str], required: set[str], what: str, missing: str, extra: str) -> dict:
    need(isinstance(v, dict), missing, f"{what} must be an object")
    odd = [k for k in v if k not in allowed]
    need(not odd, extra, f"{what} has the field {odd[0] if odd else ''}, which is not supported")
    need(required <= v.keys(), missing, f"{what} lacks a field")
    return v


def _empty(v: object, kind: type, what: str) -> None:
    need(isinstance(v, kind), "invalid-project", f"{what} has another type")
    need(len(v) == 0, "unsupported-feature", f"{what} must be empty")


def import_pxo(data: bytes) -> Document:
    named = z.by_name(z.read(data, PXO))
    need(z.require(named, "mimetype") == b"application/x-pixelorama", "invalid-mimetype", "the archive has another type")
    for name in named:
        odd = not name.endswith("/") and (name.startswith("tilesets/") or "tilemap" in name or "tile_mask" in name)
        need(not odd, "unsupported-feature", "tile sets and tile maps are not supported")
    source = z.require(named, "data.json")
    need(len(source) <= PXO_JSON, "allocation-limit", "data.json is too large")
    p = _pxo_project(z.text(source, "invalid-container"))
    width, height, n_frames, n_layers = int(p["size_x"]), int(p["size_y"]), len(p["frames"]), len(p["layers"])
    for name in named:
        need(not name.endswith("/"), "unsupported-feature", "folders in the archive are not supported")
        cel = re.fullmatch(r"image_data/frames/(0|[1-9][0-9]*)/(?:indices_)?layer_(0|[1-9][0-9]*)", name)
        known = name in ("data.json", "mimetype", "preview.png") or name.startswith("image_data/final_images/")
        need(known or (cel and 1 <= int(cel[1]) <= n_frames and 1 <= int(cel[2]) <= n_layers), "unsupported-feature", f"the entry {name} is not supported")
    durations, layers = [clamp_duration(f["duration"] * 1000 / p["fps"]) for f in p["frames"]], []
    for i, layer in enumerate(p["layers"]):
        cels = []
        for f in range(n_frames):
            raw = z.require(named, f"image_data/frames/{f + 1}/layer_{i + 1}")
            need(len(raw) == width * height * 4, "invalid-container", "a cel has another size than the canvas")
            cels.append(Cel(f, np.frombuffer(raw, np.uint8).reshape(height, width, 4)))
        layers.append(Layer(f"pixelorama-layer-{i}", layer["name"], layer["visible"], opacity_byte(layer["opacity"]), cels))
    return Document(width, height, durations, layers)


def _pxo_project(source: str) -> dict:
    bad, other = "invalid-project", "unsupported-feature"
    p = closed(parse_json(source), PXO_FIELDS, PXO_FIELDS, "the project", bad, other)
    need(p["pxo_version"] == 6 and is_whole(p["pxo_version"]), "unsupported-version", "only version 6 is supported")
    need(p["color_mode"] == 5 and is_whole(p["color_mode"]), other, "only RGBA of 8 bits is supported")
    need(is_text(p["pixelorama_version"]) and p["pixelorama_version"].strip(), bad, "the program's version is missing")
    for k in ("size_x", "size_y"):
        need(is_whole(p[k]) and 1 <= p[k] <= PXO_SIDE, "allocation-limit", "the canvas is empty or too large")
    need(is_number(p["fps"]) and p["fps"] > 0, bad, "fps must be positive")
    for k, most in (("frames", PXO_FRAMES), ("layers", PXO_LAYERS)):
        need(isinstance(p[k], list) and p[k], bad, f"{k} must be a list that isn't empty")
        need(len(p[k]) <= most, "allocation-limit", f"there are too many {k}")
    cels = len(p["frames"]) * len(p["layers"])
    need(cels <= PXO_CELS and cels * p["size_x"] * p["size_y"] * 4 <= PXO_BYTES, "allocation-limit", "there are too many cels or pixels")
    _empty(p["metadata"], dict, "metadata")
    for names, kind in ((PXO_EMPTY_TEXT, str), (PXO_EMPTY_LISTS, list)):
        for k in names:
            _empty(p[k], kind, k)
    need(all(is_whole(p[k]) for k in PXO_WHOLE) and all(is_text(p[k]) for k in PXO_TEXTS), bad, "a field has another type")
    points = p["symmetry_points"]
    need(isinstance(points, list) and len(points) == 2 and all(map(is_number, points)), bad, "symmetry_points must be two numbers")
    for i, layer in enumerate(p["layers"]):
        _pxo_layer(layer, f"layer {i + 1}")
    for i, frame in enumerate(p["frames"]):
        _pxo_frame(frame, f"frame {i + 1}", len(p["layers"]))
    return p


def _pxo_layer(v: object, what: str) -> None:
    bad, other = "invalid-project", "unsupported-feature"
    v = closed(v, PXO_LAYER, PXO_LAYER, what, bad, other)
    for k, only in (("type", 0), ("blend_mode", 0), ("clipping_mask", False), ("parent", -1)):
        need(v[k] == only and isinstance(v[k], bool) == isinstance(only, bool) and v[k] is not None, other, f"{what} has a {k} that is not supported")
    _empty(v["effects"], list, f"{what}'s effects")
    _empty(v["metadata"], dict, f"{what}'s metadata")
    need(v["new_cels_linked"] is False, other, f"{what} links cels")
    need(is_text(v["name"]) and v["name"].strip(), bad, f"{what} has no name")
    need(isinstance(v["visible"], bool) and isinstance(v["locked"], bool) and is_text(v["ui_color"]), bad, f"{what} is malformed")
    need(is_number(v["opacity"]) and 0 <= v["opacity"] <= 1, bad, f"{what}'s opacity must be from 0 to 1")


def _pxo_frame(v: object, what: str, layers: int) -> None:
    bad, other = "invalid-project", "unsupported-feature"
    v = closed(v, PXO_FRAME, PXO_FRAME - {"user_data"}, what, bad, other)
    _empty(v["metadata"], dict, f"{what}'s metadata")
    _empty(v.get("user_data", ""), str, f"{what}'s user data")
    need(is_number(v["duration"]) and v["duration"] > 0, bad, f"{what}'s duration must be positive")
    need(isinstance(v["cels"], list) and len(v["cels"]) == layers, bad, f"{what} must have a cel for each layer")
    for cel in v["cels"]:
        cel = closed(cel, PXO_CEL, PXO_CEL - {"user_data"}, f"{what}'s cel", bad, other)
        _empty(cel["metadata"], dict, "a cel's metadata")
        _empty(cel.get("user_data", ""), str, "a cel's user data")
        need(is_number(cel["opacity"]) and cel["opacity"] == 1 and is_number(cel["z_index"]) and cel["z_index"] == 0, other, "a cel's opacity or order is not supported")
        need(is_text(cel["ui_color"]), bad, "a cel's colour is malformed")


def parse_json(source: str, code: str = "invalid-json") -> object:
    """A JSON value; NaN and infinities are no JSON, and of equal keys the last counts."""

    def refuse(word: str):
        raise ValueError(word)

    try:
        return json.loads(source, parse_constant=refuse)
    except (ValueError, RecursionError):
        raise SourceError(code, "the JSON is malformed") from None


KRA = z.Limits(entries=512, total=64 << 20, path=1024, file=25 << 20)
KRA_SIDE, KRA_LAYERS, KRA_TILES, KRA_BYTES, KRA_XML, TILE = 1024, 64, 1024, 64 << 20, 5 << 20, 64
KRA_PROFILE = "sRGB-elle-V2-srgbtrc.icc"
#: Attributes of a layer that must have one value where they are there.
KRA_FIXED = {"compositeop": "normal", "channelflags": "OOOO", "channellockflags": "OOOO", "locked": "0", "collapsed": "0", "colorlabel": "0", "intimeline": "0", "onionskin": "0", "profile": KRA_PROFILE}
KRA_OWN = ("mimetype", "maindoc.xml", "documentinfo.xml", "preview.png", "mergedimage.png", "META-INF/manifest.xml")


def import_kra(data: bytes) -> Document:
    entries = z.read(data, KRA)
    _mimetype(entries, b"application/x-krita")
    named = z.by_name(entries)
    for name in ("preview.png", "mergedimage.png"):
        z.require(named, name)
    source = z.require(named, "maindoc.xml")
    need(len(source) <= KRA_XML, "allocation-limit", "maindoc.xml is too large")
    width, height, image, layers = _kra_document(z.parse_xml(z.text(source, "invalid-container"), "invalid-maindoc"))
    paths = [f"{image}/layers/{layer[0]}" for layer in layers]
    allowed = {*KRA_OWN, *paths, *(f"{p}.defaultpixel" for p in paths)}
    for name in named:
        need(name.endswith("/") or name in allowed, "unsupported-feature", f"the entry {name} is not supported")
    out = []
    for i, (path, (_, name, opacity, visible, x, y)) in enumerate(zip(paths, layers)):
        need(z.require(named, f"{path}.defaultpixel") == bytes(4), "unsupported-feature", "a layer's default pixel is not transparent")
        out.append(Layer(f"krita-layer-{i}", name, visible, opacity, [Cel(0, _kra_tiles(z.require(named, path), width, height), x, y)]))
    return Document(width, height, [STILL], out)


def _unsafe_part(name: str) -> bool:
    return z.unsafe(name, 1024, directory=False) or "/" in name


def _kra_document(root: z.Element) -> tuple[int, int, str, list[tuple]]:
    bad, other, a = "invalid-maindoc", "unsupported-feature", root.attributes
    need(root.name == "DOC", bad, "the root must be <DOC>")
    z.only(root, "depth", "editor", "syntaxVersion")
    need(a.get("editor") == "krita", bad, "the editor is another")
    need(a.get("syntaxVersion") == "2.0" and a.get("depth", "8") == "8", other, "the syntax or depth is not supported")
    need([c.name for c in root.children] == ["IMAGE"], bad, "<DOC> must hold one <IMAGE>")
    image = root.children[0]
    z.only(image, "colorspacename", "height", "mime", "name", "profile", "width", "x-res", "y-res")
    a = image.attributes
    need(a.get("mime") == "application/x-kra" and "name" in a, bad, "the image's type or name is missing")
    need(not _unsafe_part(a["name"]), "unsafe-path", "the image's name is unsafe")
    need(a.get("colorspacename") == "RGBA" and a.get("profile", KRA_PROFILE) == KRA_PROFILE, other, "the colours are not supported")
    width, height = (z.whole(a.get(k), bad, 1, KRA_SIDE, "allocation-limit") for k in ("width", "height"))
    need([c.name for c in image.children] == ["LAYERS"], bad, "<IMAGE> must hold one <LAYERS>")
    stack = image.children[0]
    z.only(stack)
    need(stack.children, other, "there is no layer, only a preview")
    need(len(stack.children) <= KRA_LAYERS, "allocation-limit", "there are too many layers")
    layers = [_kra_layer(c, i) for i, c in enumerate(stack.children)]
    need(width * height * 4 * len(layers) <= KRA_BYTES, "allocation-limit", "all layers together are too large")
    return width, height, a["name"], layers


def _kra_layer(e: z.Element, i: int) -> tuple:
    bad, other, a = "invalid-maindoc", "unsupported-feature", e.attributes
    need(e.name == "layer", other, f"<{e.name}> among layers is not supported")
    z.only(e, *KRA_FIXED, "colorspacename", "filename", "name", "nodetype", "opacity", "uuid", "visible", "x", "y")
    need(not e.children, other, "content of layers is not supported")
    need(e.self_closing, bad, "a layer must close itself")
    need(a.get("nodetype") == "paintlayer" and a.get("colorspacename") == "RGBA", other, "only paint layers of RGBA with 8 bits are supported")
    for k, value in KRA_FIXED.items():
        need(a.get(k, value) == value, other, f"a layer's {k} is not supported")
    need("filename" in a, bad, "a layer has no file")
    need(not _unsafe_part(a["filename"]), "unsafe-path", "a layer has an unsafe file")
    name = a.get("name", f"Layer {i + 1}")
    need(name.strip(), bad, "a layer has a blank name")
    opacity = z.whole(a.get("opacity"), bad, 0, 255)
    need(a.get("visible", "1") in ("0", "1"), bad, "a visibility is malformed")
    x, y = (z.whole(a.get(k), bad, *INT16, default="0") for k in "xy")
    return a["filename"], name, opacity, a.get("visible") != "0", x, y


def _kra_tiles(data: bytes, width: int, height: int) -> np.ndarray:
    """RGBA pixels of a canvas from raw tiles of blue, green, red and alpha; what no tile covers is transparent."""
    bad = "invalid-layer-data"
    at = 0

    def line() -> str:
        nonlocal at
        end = data.find(b"\n", at)
        need(end >= 0 and all(0x20 <= c <= 0x7E for c in data[at:end]), bad, "a header line is missing or malformed")
        text, at = data[at:end].decode(), end + 1
        return text

    for expected in ("VERSION 2", f"TILEWIDTH {TILE}", f"TILEHEIGHT {TILE}", "PIXELSIZE 4"):
        need(line() == expected, "unsupported-feature", f"the header must say {expected}")
    count = re.fullmatch(r"DATA (0|[1-9][0-9]*)", line())
    need(count, bad, "the tile count is malformed")
    need(1 <= int(count[1]) <= KRA_TILES, "allocation-limit", "there are no tiles, or too many")
    canvas = np.zeros((-(-height // TILE) * TILE, -(-width // TILE) * TILE, 4), np.uint8)
    seen, size = set(), TILE * TILE * 4 + 1
    for _ in range(int(count[1])):
        head = re.fullmatch(r"(-?(?:0|[1-9][0-9]*)),(-?(?:0|[1-9][0-9]*)),LZF,([1-9][0-9]*)", line())
        need(head, bad, "a tile's header is malformed")
        x, y = int(head[1]) * TILE, int(head[2]) * TILE
        need(0 <= x < width and 0 <= y < height and (x, y) not in seen, bad, "a tile is outside of the canvas or there twice")
        seen.add((x, y))
        need(int(head[3]) == size and at + size <= len(data), bad, "a tile has another size")
        need(data[at] != 1, "unsupported-feature", "compressed tiles are not supported")
        need(data[at] == 0, bad, "a tile's flag is not known")
        tile = np.frombuffer(data, np.uint8, size - 1, at + 1).reshape(TILE, TILE, 4)
        canvas[y : y + TILE, x : x + TILE] = tile[..., [2, 1, 0, 3]]
        at += size
    need(at == len(data), bad, "there is data after the tiles")
    return canvas[:height, :width].copy()


PSD_FILE, PSD_SIDE, PSD_LAYERS, PSD_PIXELS, PSD_NAME = 25 << 20, 2048, 64, 16_777_216, 1024
#: Blocks of a layer by the feature they tell of, in the order in which features are refused.
PSD_BLOCKS = {
    "groups": ("lsct", "lsdk"), "text": ("TySh", "tySh"), "smart objects": ("SoLd", "PlLd", "lnk2", "lnk3", "lnkD", "lnkE"),
    "adjustments and fills": ("brit", "levl", "curv", "expA", "vibA", "hue2", "blnc", "blwh", "phfl", "mixr", "clrL", "nvrt", "post", "thrs", "grdm", "selc", "SoCo", "GdFl", "PtFl"),
    "masks": ("vmsk", "vsms"), "effects": ("lfx2", "lrFX"), "clipping": (),
}
PSD_FEATURE = {k: feature for feature, keys in PSD_BLOCKS.items() for k in keys}


class _Big:
    """Reads big-endian values up to an end; what reaches beyond is a broken container."""

    def __init__(self, data: bytes, at: int, end: int):
        need(0 <= at <= end <= len(data), "invalid-container", "a section is cut off")
        self.data, self.at, self.end = data, at, end

    def take(self, n: int) -> bytes:
        need(0 <= n <= self.end - self.at, "invalid-container", "a section is cut off")
        self.at += n
        return self.data[self.at - n : self.at]

    def unpack(self, form: str) -> tuple:
        return struct.unpack(">" + form, self.take(struct.calcsize(">" + form)))

    def section(self) -> _Big:
        (n,) = self.unpack("I")
        self.take(n)
        return _Big(self.data, self.at - n, self.at)


def import_psd(data: bytes) -> Document:
    bad, other = "invalid-container", "unsupported-feature"
    need(len(data) <= PSD_FILE, "allocation-limit", "the file is too large")
    r = _Big(data, 0, len(data))
    signature, version, _, channels, height, width, depth, mode = r.unpack("4sH6sHIIHH")
    need(signature == b"8BPS" and 1 <= channels <= 56, bad, "not a PSD file")
    need(version == 1 and 3 <= channels <= 4, other, "the version or the channels are not supported")
    need(1 <= width <= PSD_SIDE and 1 <= height <= PSD_SIDE, "allocation-limit", "the canvas is empty or too large")
    need(depth == 8 and mode == 3, other, "only RGB of 8 bits is supported")
    r.section()
    r.section()
    outer = r.section()
    info = outer.section() if outer.end > outer.at else outer
    count = abs(info.unpack("h")[0]) if info.end > info.at else 0
    need(1 <= count <= PSD_LAYERS, "allocation-limit", "there are no layers, or too many")
    need(width * height * count <= PSD_PIXELS, "allocation-limit", "all layers together are too large")
    records = [_psd_record(info, i, width, height) for i in range(count)]
    pixels = [_psd_pixels(info, record) for record in records]
    need(not data[info.at : info.end].strip(b"\0"), bad, "there is data after the layers")
    layers = []
    for i, (r_, image) in enumerate(zip(records, pixels)):
        refused = [f for f in PSD_BLOCKS if f in r_["features"]]
        need(not refused, other, f"{refused[0] if refused else ''} are not supported")
        need(r_["blend"] == b"norm", other, "a blend mode is not supported")
        canvas = np.zeros((height, width, 4), np.uint8)
        canvas[r_["top"] : r_["bottom"], r_["left"] : r_["right"]] = image
        layers.append(Layer(f"psd-layer-{i}", r_["name"], r_["visible"], r_["opacity"], [Cel(0, canvas)]))
    return Document(width, height, [STILL], layers)


def _psd_record(r: _Big, i: int, width: int, height: int) -> dict:
    bad, other = "invalid-container", "unsupported-feature"
    top, left, bottom, right, n = r.unpack("4iH")
    need(0 <= left < right <= width and 0 <= top < bottom <= height, bad, "a layer is empty or reaches beyond the canvas")
    need(3 <= n <= 4, other, "a layer's channels are not supported")
    channels = [r.unpack("hI") for _ in range(n)]
    signature, blend, opacity, clipping, flags, _ = r.unpack("4s4s4B")
    need(signature in (b"8BIM", b"8B64"), bad, "a layer's signature is not known")
    extra = r.section()
    features = {"clipping"} if clipping else set()
    mask = extra.section()
    if mask.end > mask.at:
        features.add("masks")
    ranges = extra.section()
    need(ranges.end == ranges.at, other, "blending ranges are not supported")
    (size,) = extra.unpack("B")
    name = extra.take(size).decode("latin-1")
    extra.take(-(size + 1) % 4)
    while extra.end - extra.at >= 12:
        signature, key, size = extra.unpack("4s4sI")
        body = extra.take(size + size % 2)
        need(signature in (b"8BIM", b"8B64"), bad, "a block's signature is not known")
        key = key.decode("latin-1")
        if key == "luni":
            need(size >= 4, bad, "a layer's name is cut off")
            (units,) = struct.unpack_from(">I", body)
            need(units <= PSD_NAME and 2 * units <= size - 4, bad, "a layer's name has another length")
            name = body[4 : 4 + 2 * units].decode("utf-16-be", "replace")
        else:
            need(key in PSD_FEATURE, other, f"the block {key} is not supported")
            features.add(PSD_FEATURE[key])
    need(not extra.data[extra.at : extra.end].strip(b"\0"), bad, "a block is cut off")
    need(len(name) <= PSD_NAME or not name.strip(), bad, "a layer's name is too long")
    return {"top": top, "left": left, "bottom": bottom, "right": right, "channels": channels, "blend": blend, "opacity": opacity, "visible": not flags & 2, "features": features, "name": name if name.strip() else f"Layer {i + 1}"}


def _psd_pixels(r: _Big, record: dict) -> np.ndarray:
    width, height, planes = record["right"] - record["left"], record["bottom"] - record["top"], {}
    for channel, size in record["channels"]:
        need(channel in (0, 1, 2, -1), "unsupported-feature", f"channel {channel} is not supported")
        need(channel not in planes, "invalid-container", f"channel {channel} is there twice")
        part = r.take(size)
        need(size >= 2, "invalid-container", "a channel is cut off")
        (packing,) = struct.unpack_from(">H", part)
        need(packing in (0, 1), "unsupported-feature", "a channel's compression is not supported")
        raw = part[2:] if packing == 0 else unpack_rows(part[2:], width, height)
        need(len(raw) == width * height, "invalid-container", "a channel has another size than its layer")
        planes[channel] = np.frombuffer(raw, np.uint8).reshape(height, width)
    need({0, 1, 2} <= planes.keys(), "invalid-container", "a colour channel is missing")
    return np.stack([planes[0], planes[1], planes[2], planes.get(-1, np.full((height, width), 255, np.uint8))], axis=-1)


def unpack_bits(data: bytes, size: int) -> bytes:
    """Exactly size bytes from runs: up to 127 copies what follows, from 129 repeats a byte, 128 does nothing."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        at += 1
        if n == 128:
            continue
        run = data[at : at + n + 1] if n < 128 else data[at : at + 1] * (257 - n)
        need(len(run) == (n + 1 if n < 128 else 257 - n) and len(out) + len(run) <= size, "invalid-container", "a run is malformed")
        out += run
        at += n + 1 if n < 128 else 1
    need(len(out) == size, "invalid-container", "a row has another length")
    return bytes(out)


def unpack_rows(data: bytes, width: int, height: int) -> bytes:
    need(len(data) >= 2 * height, "invalid-container", "the row lengths are cut off")
    sizes, at, out = struct.unpack_from(f">{height}H", data), 2 * height, []
    for n in sizes:
        need(at + n <= len(data), "invalid-container", "a row is cut off")
        out.append(unpack_bits(data[at : at + n], width))
        at += n
    need(at == len(data), "invalid-container", "there is data after the rows")
    return b"".join(out)


def pack_bits(data: bytes) -> bytes:
    """Runs that unpack_bits() takes: repeats of two bytes or more, and literals between them."""
    out, at, literal = bytearray(), 0, bytearray()

    def flush() -> None:
        for k in range(0, len(literal), 128):
            out.append(len(literal[k : k + 128]) - 1)
            out.extend(literal[k : k + 128])
        literal.clear()

    while at < len(data):
        n = 1
        while n < 128 and data[at + n : at + n + 1] == data[at : at + 1]:
            n += 1
        if n > 1:
            flush()
            out += bytes([257 - n, data[at]])
        else:
            literal.append(data[at])
        at += n
    flush()
    return bytes(out)
