"""Encoders of the sources that the importers read, for tests."""

import base64
import json
import struct
import zlib

import numpy as np

from lumaframe.sources import png
from lumaframe.sources.animated import lzw_encode

CLEAR, RED, GREEN, BLUE = (0, 0, 0, 0), (200, 10, 20, 255), (0, 255, 0, 255), (0, 0, 255, 128)


def image(*rows):
    return np.array(rows, np.uint8)


def data_url(pixels):
    return "data:image/png;base64," + base64.b64encode(png.encode(pixels)).decode()


def gif(width, height, palette, frames, version=b"GIF89a", back=0, end=b"\x3b"):
    """frames: (left, top, width, height, indexes, delay, disposal, transparent or None)."""
    bits = max(0, (len(palette) - 1).bit_length() - 1)
    table = bytes(c for p in palette for c in p).ljust(3 << (bits + 1), b"\0")
    out = [version, struct.pack("<HHBBB", width, height, 0x80 | bits, back, 0), table]
    for left, top, w, h, indexes, delay, disposal, clear in frames:
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", disposal << 2 | (clear is not None), delay, clear or 0, 0))
        code = lzw_encode(bytes(indexes), 2)
        out.append(b"\x2c" + struct.pack("<4HB", left, top, w, h, 0) + b"\x02" + b"".join(bytes([len(code[i : i + 255])]) + code[i : i + 255] for i in range(0, len(code), 255)) + b"\0")
    return b"".join([*out, end])


def apng(width, height, frames, plays=0, declared=None):
    """frames: (left, top, pixels, numerator, denominator, dispose, blend)."""
    out, n = [png.SIGNATURE, png.chunk(b"IHDR", struct.pack(">2I5B", width, height, 8, 6, 0, 0, 0)), png.chunk(b"acTL", struct.pack(">2I", declared or len(frames), plays))], 0
    for k, (left, top, pixels, num, den, dispose, blend) in enumerate(frames):
        h, w = pixels.shape[:2]
        out.append(png.chunk(b"fcTL", struct.pack(">5I2H2B", n, w, h, left, top, num, den, dispose, blend)))
        n += 1
        body = zlib.compress(b"".join(b"\0" + row.tobytes() for row in pixels))
        out.append(png.chunk(b"fdAT", struct.pack(">I", n) + body) if k else png.chunk(b"IDAT", body))
        n += bool(k)
    return b"".join([*out, png.chunk(b"IEND", b"")])


def archive(entries, flags=0):
    """A ZIP archive of (name, content, deflated) entries, in order."""
    out, central, at = [], [], 0
    for name, content, deflated in entries:
        packer = zlib.compressobj(9, zlib.DEFLATED, -15)
        body = packer.compress(content) + packer.flush() if deflated else content
        method, raw = 8 if deflated else 0, name.encode()
        head = struct.pack("<5H3I2H", 20, flags, method, 0, 0, zlib.crc32(content), len(body), len(content), len(raw), 0)
        central.append(b"PK\1\2" + struct.pack("<H", 20) + head + struct.pack("<3H2I", 0, 0, 0, 0, at) + raw)
        out.append(b"PK\3\4" + head + raw + body)
        at += len(out[-1])
    directory = b"".join(central)
    return b"".join(out) + directory + b"PK\5\6" + struct.pack("<4H2IH", 0, 0, len(entries), len(entries), len(directory), at, 0)


def ora(layers, width=4, height=3, attributes="", stack=None):
    """layers: (attributes, pixels)."""
    inner = "".join(f'<layer src="data/{i}.png" {a}/>' for i, (a, _) in enumerate(layers))
    xml = stack or f'<?xml version="1.0"?>\n<image w="{width}" h="{height}" {attributes}><stack>{inner}</stack></image>'
    return archive([("mimetype", b"image/openraster", False), ("stack.xml", xml.encode(), True), *((f"data/{i}.png", png.encode(p), True) for i, (_, p) in enumerate(layers))])


def pxo_json(width=2, height=2, frames=(1, 2.5), layers=(("Base", 0.5, True), ("Ink", 1, False)), **changes):
    empty = dict.fromkeys(("author_company", "author_contact", "author_display_name", "author_real_name", "license", "project_current_palette_name", "user_data", "export_directory_path", "export_file_name"), "")
    lists = {k: [] for k in ("brushes", "guides", "palettes", "reference_images", "tags", "tilesets", "vanishing_points")}
    wholes = dict.fromkeys(("current_frame", "current_layer", "export_file_format", "tile_mode_x_basis_x", "tile_mode_x_basis_y", "tile_mode_y_basis_x", "tile_mode_y_basis_y"), 0)
    layer = lambda n, o, v: {"blend_mode": 0, "clipping_mask": False, "effects": [], "locked": False, "metadata": {}, "name": n, "new_cels_linked": False, "opacity": o, "parent": -1, "type": 0, "ui_color": "", "visible": v}
    cel = {"metadata": {}, "opacity": 1, "ui_color": "", "z_index": 0}
    return empty | lists | wholes | {
        "color_mode": 5, "fps": 10, "metadata": {}, "pixelorama_version": "v1", "pxo_version": 6, "size_x": width, "size_y": height, "symmetry_points": [1, 2.5],
        "layers": [layer(*x) for x in layers], "frames": [{"cels": [cel] * len(layers), "duration": d, "metadata": {}} for d in frames],
    } | changes


def pxo(project, cel=lambda f, i: bytes([f, i, 9, 255]) * 4, more=(), without=()):
    cels = [(f"image_data/frames/{f + 1}/layer_{i + 1}", cel(f, i), True) for f in range(len(project["frames"])) for i in range(len(project["layers"]))]
    return archive([x for x in [("mimetype", b"application/x-pixelorama", False), ("data.json", json.dumps(project).encode(), True), *cels, *more] if x[0] not in without])


def krita_tiles(pixels, size=64):
    height, width = pixels.shape[:2]
    tiles = []
    for y in range(0, height, size):
        for x in range(0, width, size):
            tile = np.zeros((size, size, 4), np.uint8)
            part = pixels[y : y + size, x : x + size]
            tile[: part.shape[0], : part.shape[1]] = part
            tiles.append(f"{x // size},{y // size},LZF,{size * size * 4 + 1}\n".encode() + b"\0" + tile[..., [2, 1, 0, 3]].tobytes())
    return f"VERSION 2\nTILEWIDTH {size}\nTILEHEIGHT {size}\nPIXELSIZE 4\nDATA {len(tiles)}\n".encode() + b"".join(tiles)


def kra(layers, width=2, height=2, depth="8", inner=None, more=(), without=()):
    """layers: (attributes, pixels)."""
    xml = inner if inner is not None else "".join(f'<layer nodetype="paintlayer" colorspacename="RGBA" filename="layer{i}" {a}/>' for i, (a, _) in enumerate(layers))
    xml = f'<DOC editor="krita" syntaxVersion="2.0" depth="{depth}"><IMAGE mime="application/x-kra" name="img" colorspacename="RGBA" width="{width}" height="{height}"><LAYERS>{xml}</LAYERS></IMAGE></DOC>'
    pixels = [e for i, (_, p) in enumerate(layers) for e in ((f"img/layers/layer{i}", krita_tiles(p), True), (f"img/layers/layer{i}.defaultpixel", bytes(4), False))]
    return archive([x for x in [("mimetype", b"application/x-krita", False), ("maindoc.xml", xml.encode(), True), ("preview.png", b"p", False), ("mergedimage.png", b"m", False), *pixels, *more] if x[0] not in without])


def psd(layers, width=4, height=3, depth=8, version=1):
    """layers: (name, top, left, pixels, opacity, hidden, blend, packed, blocks)."""
    from lumaframe.sources.layered import pack_bits

    records, planes = b"", b""
    for name, top, left, pixels, opacity, hidden, blend, packed, blocks in layers:
        h, w = pixels.shape[:2]
        channels = []
        for k in (-1, 0, 1, 2):
            plane = pixels[..., 3 if k < 0 else k]
            rows = [pack_bits(r.tobytes()) for r in plane]
            body = struct.pack(">H", 1) + struct.pack(f">{h}H", *map(len, rows)) + b"".join(rows) if packed else struct.pack(">H", 0) + plane.tobytes()
            channels.append((k, body))
        pascal = bytes([len(name)]) + name.encode("latin-1")
        extra = struct.pack(">II", 0, 0) + pascal + bytes(-len(pascal) % 4)
        for key, body in blocks:
            extra += b"8BIM" + key + struct.pack(">I", len(body)) + body + bytes(len(body) % 2)
        records += struct.pack(">4iH", top, left, top + h, left + w, 4) + b"".join(struct.pack(">hI", k, len(b)) for k, b in channels)
        records += b"8BIM" + blend + struct.pack(">4BI", opacity, 0, 2 if hidden else 0, 0, len(extra)) + extra
        planes += b"".join(b for _, b in channels)
    info = struct.pack(">h", len(layers)) + records + planes
    mask = struct.pack(">I", len(info)) + info
    return b"8BPS" + struct.pack(">H6xHIIHH", version, 4, height, width, depth, 3) + struct.pack(">III", 0, 0, len(mask)) + mask


def piskel(layers, fps=12, width=2, height=2, hidden=None, version=2, **more):
    project = {"name": "p", "fps": fps, "height": height, "width": width, "layers": [json.dumps(x) for x in layers]} | more
    return json.dumps({"modelVersion": version, "piskel": project | ({} if hidden is None else {"hiddenFrames": hidden})})


def piskel_layer(layout, sheet, name="L", count=None, **more):
    return {"name": name, "frameCount": count or sum(map(len, layout)), "chunks": [{"layout": layout, "base64PNG": data_url(sheet)}]} | more


def pixil(frames, width=2, height=2, version="2.7.0", **more):
    """frames: (speed, layers), layers: (unqid, name, opacity, pixels)."""
    layer = lambda u, n, o, p: {"id": 0, "unqid": u, "name": n, "opacity": o, "src": data_url(p), "options": {"blend": "source-over"}, "active": True}
    made = [{"width": str(width), "height": height, "speed": s, "layers": [layer(*x) for x in layers]} for s, layers in frames]
    return json.dumps({"application": "pixil", "type": ".pixil", "website": "pixilart.com", "version": version, "width": width, "height": str(height), "frames": made} | more)
