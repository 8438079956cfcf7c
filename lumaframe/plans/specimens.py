"""Writers of source files around a text's bytes, for queries that read them back. They share no code with the importers.

A text is held by an image SIDE pixels wide: four bytes of its length, then its bytes, as the bytes of pixels."""

from __future__ import annotations

import base64
import io
import json
import struct
import zipfile
import zlib

import numpy as np

SIDE = 256


def picture(data: bytes) -> np.ndarray:
    held = len(data).to_bytes(4, "little") + data
    return np.frombuffer(held.ljust(-(-len(held) // (4 * SIDE)) * 4 * SIDE, b"\0"), np.uint8).reshape(-1, SIDE, 4)


def dot(*colour: int) -> np.ndarray:
    return np.array([[colour]], np.uint8)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _scanlines(pixels: np.ndarray) -> bytes:
    """Rows filtered by none, left and above in turn."""
    rows = pixels.reshape(len(pixels), -1)
    left = np.concatenate((np.zeros((len(rows), 4), np.uint8), rows[:, :-4]), axis=1)
    above = np.concatenate((np.zeros((1, rows.shape[1]), np.uint8), rows[:-1]))
    kind = np.arange(len(rows), dtype=np.uint8)[:, None] % 3
    return zlib.compress(np.concatenate((kind, rows - np.where(kind == 1, left, np.where(kind == 2, above, 0)).astype(np.uint8)), axis=1).tobytes())


def _head(pixels: np.ndarray) -> bytes:
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">2I5B", pixels.shape[1], pixels.shape[0], 8, 6, 0, 0, 0))


def png(pixels: np.ndarray) -> bytes:
    body = _scanlines(pixels)
    return _head(pixels) + _chunk(b"IDAT", body[:7]) + _chunk(b"IDAT", body[7:]) + _chunk(b"IEND", b"")


def _url(pixels: np.ndarray) -> str:
    return "data:image/png;base64," + base64.b64encode(png(pixels)).decode()


def apng(data: bytes) -> bytes:
    """Two frames, 30 and 500 ms: the picture, and a pixel put into it."""
    image = picture(data)
    control = lambda n, w, h, x, num, den: _chunk(b"fcTL", struct.pack(">5I2H2B", n, w, h, x, 0, num, den, 0, 0))
    first = control(0, SIDE, len(image), 0, 3, 100) + _chunk(b"IDAT", _scanlines(image))
    second = control(1, 1, 1, 1, 1, 2) + _chunk(b"fdAT", struct.pack(">I", 2) + _scanlines(dot(1, 2, 3, 4)))
    return _head(image) + _chunk(b"acTL", struct.pack(">2I", 2, 0)) + first + second + _chunk(b"IEND", b"")


def gif(data: bytes) -> bytes:
    """Two frames, 50 and 70 ms, in a palette whose reds count up: the picture's bytes as indexes, and a pixel put into it."""

    def codes(indexes: bytes) -> bytes:
        out: list[int] = []
        for k in range(0, len(indexes), 200):  # cleared before codes would grow beyond 9 bits
            out += [256, *indexes[k : k + 200]]
        bits = (np.array([*out, 257])[:, None] >> np.arange(9)) & 1
        packed = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
        return b"\x08" + b"".join(bytes([len(packed[k : k + 255])]) + packed[k : k + 255] for k in range(0, len(packed), 255)) + b"\0"

    indexes = picture(data).tobytes()
    height = len(indexes) // SIDE
    frame = lambda delay, w, h, x, body: b"\x21\xf9\x04" + struct.pack("<BHBB", 1 << 2, delay, 0, 0) + b"\x2c" + struct.pack("<4HB", x, 0, w, h, 0) + codes(body)
    palette = bytes(c for k in range(256) for c in (k, 255 - k, 7))
    return b"GIF89a" + struct.pack("<2H3B", SIDE, height, 0xF7, 0, 0) + palette + frame(5, SIDE, height, 0, indexes) + frame(7, 1, 1, 2, b"\x09") + b"\x3b"


def _zip(entries: list[tuple[str, bytes]], stored: int = 1) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, (name, body) in enumerate(entries):
            z.writestr(zipfile.ZipInfo(name), body, zipfile.ZIP_STORED if k < stored else zipfile.ZIP_DEFLATED)
    return out.getvalue()


def ora(data: bytes) -> bytes:
    """A picture over a hidden pixel; the uppermost layer stands first."""
    image = picture(data)
    xml = f'<image w="{SIDE}" h="{len(image)}"><stack><layer src="data/0.png" name="Ink" opacity="0.5"/><layer src="data/1.png" name="Base" visibility="hidden" x="2"/></stack></image>'
    return _zip([("mimetype", b"image/openraster"), ("stack.xml", xml.encode()), ("data/0.png", png(image)), ("data/1.png", png(dot(9, 8, 7, 6)))])


def pxo(data: bytes) -> bytes:
    """Two frames of two layers, raw pixels: the picture in the lower layer of the first frame."""
    image = picture(data)
    texts = ("author_company", "author_contact", "author_display_name", "author_real_name", "license", "project_current_palette_name", "user_data", "export_directory_path", "export_file_name")
    lists = ("brushes", "guides", "palettes", "reference_images", "tags", "tilesets", "vanishing_points", "symmetry_points")
    wholes = ("current_frame", "current_layer", "export_file_format", "tile_mode_x_basis_x", "tile_mode_x_basis_y", "tile_mode_y_basis_x", "tile_mode_y_basis_y")
    layer = lambda name, opacity, visible: dict(
        blend_mode=0, clipping_mask=False, effects=[], locked=False, metadata={}, name=name, new_cels_linked=False, opacity=opacity, parent=-1, type=0, ui_color="", visible=visible
    )
    cel = dict(metadata={}, opacity=1, ui_color="", z_index=0)
    project = dict.fromkeys(texts, "") | {k: [] for k in lists} | dict.fromkeys(wholes, 0) | dict(color_mode=5, fps=10, metadata={}, pixelorama_version="v1", pxo_version=6, size_x=SIDE, size_y=len(image))
    project |= dict(symmetry_points=[1, 2.5], layers=[layer("Base", 0.5, True), layer("Ink", 1, False)], frames=[dict(cels=[cel, cel], duration=d, metadata={}) for d in (1, 2.5)])
    cels = [(f"image_data/frames/{f}/layer_{k}", image.tobytes() if (f, k) == (1, 1) else bytes(image.size)) for f in (1, 2) for k in (1, 2)]
    return _zip([("mimetype", b"application/x-pixelorama"), ("data.json", json.dumps(project).encode()), *cels])


def kra(data: bytes) -> bytes:
    """One layer of raw tiles of 64 pixels a side, blue first."""
    image = picture(data)
    whole = np.zeros((-(-len(image) // 64) * 64, SIDE, 4), np.uint8)
    whole[: len(image)] = image[..., [2, 1, 0, 3]]
    tiles = [f"{x // 64},{y // 64},LZF,{4 * 64 * 64 + 1}\n".encode() + b"\0" + whole[y : y + 64, x : x + 64].tobytes() for y in range(0, len(whole), 64) for x in range(0, SIDE, 64)]
    device = f"VERSION 2\nTILEWIDTH 64\nTILEHEIGHT 64\nPIXELSIZE 4\nDATA {len(tiles)}\n".encode() + b"".join(tiles)
    layer = '<layer nodetype="paintlayer" colorspacename="RGBA" filename="layer1" name="Ink" opacity="200" visible="1"/>'
    xml = f'<DOC editor="krita" syntaxVersion="2.0" depth="8"><IMAGE mime="application/x-kra" name="img" colorspacename="RGBA" width="{SIDE}" height="{len(image)}"><LAYERS>{layer}</LAYERS></IMAGE></DOC>'
    return _zip([("mimetype", b"application/x-krita"), ("maindoc.xml", xml.encode()), ("preview.png", b"p"), ("mergedimage.png", b"m"), ("img/layers/layer1", device), ("img/layers/layer1.defaultpixel", bytes(4))])


def psd(data: bytes) -> bytes:
    """A layer in runs of bytes under a hidden one of raw planes."""

    def runs(row: bytes) -> bytes:
        return b"".join(bytes([len(row[k : k + 128]) - 1]) + row[k : k + 128] for k in range(0, len(row), 128))

    image, records, planes = picture(data), b"", b""
    for name, left, pixels, opacity, flags in (("Base", 0, image, 255, 0), ("Ink", 3, dot(9, 8, 7, 6), 128, 2)):
        height, width = pixels.shape[:2]
        bodies = []
        for c in (3, 0, 1, 2):
            rows = [runs(r.tobytes()) for r in pixels[..., c]]
            bodies.append(struct.pack(">H", 1) + struct.pack(f">{height}H", *map(len, rows)) + b"".join(rows) if name == "Base" else struct.pack(">H", 0) + pixels[..., c].tobytes())
        extra = bytes(8) + (bytes([len(name)]) + name.encode()).ljust(-(-(len(name) + 1) // 4) * 4, b"\0")
        records += struct.pack(">4iH", 0, left, height, left + width, 4) + b"".join(struct.pack(">hI", k, len(b)) for k, b in zip((-1, 0, 1, 2), bodies))
        records += b"8BIMnorm" + struct.pack(">4BI", opacity, 0, flags, 0, len(extra)) + extra
        planes += b"".join(bodies)
    info = struct.pack(">h", 2) + records + planes
    info += bytes(len(info) % 2)
    mask = struct.pack(">I", len(info)) + info
    return b"8BPS" + struct.pack(">H6xHIIHH", 1, 4, len(image), SIDE, 8, 3) + struct.pack(">III", 0, 0, len(mask)) + mask


def piskel(data: bytes) -> bytes:
    """Two frames of one layer on a sheet, side by side, at 10 frames a second."""
    image = picture(data)
    chunk = {"layout": [[0], [1]], "base64PNG": _url(np.concatenate((image, np.zeros_like(image)), axis=1))}
    layer = {"name": "Ink", "opacity": 1, "frameCount": 2, "chunks": [chunk]}
    return json.dumps({"modelVersion": 2, "piskel": {"name": "p", "fps": 10, "height": len(image), "width": SIDE, "layers": [json.dumps(layer)]}}).encode()


def pixil(data: bytes) -> bytes:
    """One frame of 90 ms with two layers."""
    image = picture(data)
    layer = lambda unqid, name, opacity, pixels: dict(id=0, unqid=unqid, name=name, opacity=opacity, src=_url(pixels), options={"blend": "source-over"}, active=True)
    frame = dict(width=str(SIDE), height=len(image), speed=90, layers=[layer("a", "Base", "0.5", image), layer("b", "Ink", "1", np.zeros_like(image))])
    return json.dumps(dict(application="pixil", type=".pixil", website="pixilart.com", version="2.7.0", width=SIDE, height=str(len(image)), frames=[frame])).encode()


def atlas(data: bytes) -> tuple[bytes, bytes]:
    """A sheet and its table: the picture turned with the clock at (3, 2), 80 ms, and a pixel of a trimmed frame, 125 ms."""
    image = picture(data)
    sheet = np.zeros((SIDE + 2, len(image) + 3, 4), np.uint8)
    sheet[2:, 3:] = np.rot90(image, -1)
    sheet[0, 0] = (1, 2, 3, 4)
    turned = {"frame": dict(x=3, y=2, w=len(image), h=SIDE), "rotated": True, "trimmed": False, "duration": 80}
    trimmed = {"frame": dict(x=0, y=0, w=1, h=1), "rotated": False, "trimmed": True, "sourceSize": dict(w=SIDE, h=len(image)), "spriteSourceSize": dict(x=5, y=0, w=1, h=1)}
    return png(sheet), json.dumps({"frames": [turned, trimmed]}).encode()


#: Kind of file to its writer.
WRITERS = {"png": lambda data: png(picture(data)), "apng": apng, "gif": gif, "ora": ora, "pxo": pxo, "kra": kra, "psd": psd, "piskel": piskel, "pixil": pixil}
