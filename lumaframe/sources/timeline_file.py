"""The binary layered timeline document: written from a document in memory, and read back for checks."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from .document import Cel, Document, Layer, Tag

#: Fixed values of the format: magic numbers, kinds of chunks, directions.
FILE_MAGIC, FRAME_MAGIC, LAYER, CEL, TAGS = 0xA5E0, 0xF1FA, 0x2004, 0x2005, 0x2018
DIRECTIONS = ("forward", "reverse", "ping-pong")
HEADER, FRAME = struct.Struct("<IHHHHHIHIIB3xHBBHHHH84x"), struct.Struct("<IHHHHI")
U16 = 65535


class ExportError(ValueError):
    """A document that the format can't hold."""


def _check(holds: bool, what: str) -> None:
    if not holds:
        raise ExportError(what)


def _text(name: str) -> bytes:
    data = name.encode()
    _check(len(data) <= U16, "a name is too long")
    return struct.pack("<H", len(data)) + data


def validate(doc: Document) -> None:
    """What the format can hold. Cels may lie beyond the canvas; ids and blank layer names don't matter here."""
    _check(1 <= doc.width <= U16 and 1 <= doc.height <= U16, "the canvas must have 1 to 65535 pixels a side")
    _check(1 <= len(doc.durations) <= U16 and all(1 <= d <= U16 for d in doc.durations), "frames and durations must number 1 to 65535")
    _check(1 <= len(doc.layers) <= U16 + 1, "layers must number 1 to 65536")
    for layer in doc.layers:
        _check(0 <= layer.opacity <= 255, "an opacity must be from 0 to 255")
        _check(len({c.frame for c in layer.cels}) == len(layer.cels), "a layer has two cels in one frame")
        for c in layer.cels:
            _check(0 <= c.frame < len(doc.durations), "a cel's frame does not exist")
            _check(-32768 <= c.x <= 32767 and -32768 <= c.y <= 32767, "a cel's place must fit 16 bits")
            _check(c.pixels.ndim == 3 and c.pixels.shape[2] == 4 and all(1 <= n <= U16 for n in c.pixels.shape[:2]), "a cel has no pixels, or too many")
    _check(len(doc.tags) <= U16 and len({t.name for t in doc.tags}) == len(doc.tags), "tags must have names of their own")
    for t in doc.tags:
        _check(bool(t.name.strip()) and 0 <= t.first <= t.last < len(doc.durations) and t.direction in DIRECTIONS, "a tag is malformed")


def store(data: bytes) -> bytes:
    """A zlib stream of stored blocks of at most 65535 bytes; none for no data."""
    out = [b"\x78\x01"]
    for at in range(0, len(data), U16):
        part = data[at : at + U16]
        out += [struct.pack("<BHH", at + U16 >= len(data), len(part), U16 - len(part)), part]
    return b"".join([*out, struct.pack(">I", zlib.adler32(data))])


def _chunk(kind: int, data: bytes) -> bytes:
    return struct.pack("<IH", 6 + len(data), kind) + data


def write(doc: Document) -> bytes:
    """Layers, then tags, in the first frame; in each frame the cels by layer."""
    validate(doc)
    frames: list[list[bytes]] = [[] for _ in doc.durations]
    for layer in doc.layers:
        frames[0].append(_chunk(LAYER, struct.pack("<HHHHHHB3x", 2 | layer.visible, 0, 0, 0, 0, 0, layer.opacity) + _text(layer.name)))
    if doc.tags:
        tags = (struct.pack("<HHBH6x3xB", t.first, t.last, DIRECTIONS.index(t.direction), 0, 0) + _text(t.name) for t in doc.tags)
        frames[0].append(_chunk(TAGS, struct.pack("<H8x", len(doc.tags)) + b"".join(tags)))
    for i, layer in enumerate(doc.layers):
        for c in layer.cels:
            height, width = c.pixels.shape[:2]
            frames[c.frame].append(_chunk(CEL, struct.pack("<HhhBHH5xHH", i, c.x, c.y, 255, 2, 0, width, height) + store(np.ascontiguousarray(c.pixels).tobytes())))
    sizes = [FRAME.size + sum(map(len, f)) for f in frames]
    _check(HEADER.size + sum(sizes) < 1 << 32, "the file is too large")
    out = [HEADER.pack(HEADER.size + sum(sizes), FILE_MAGIC, len(frames), doc.width, doc.height, 32, 1, 0, 0, 0, 0, 0, 1, 1, 0, 0, 0, 0)]
    for size, duration, chunks in zip(sizes, doc.durations, frames):
        out += [FRAME.pack(size, FRAME_MAGIC, min(len(chunks), U16), duration, 0, len(chunks) if len(chunks) >= U16 else 0), *chunks]
    return b"".join(out)


def read(data: bytes) -> Document:
    """A document from a file that write() made."""
    size, magic, count, width, height, depth, *_ = HEADER.unpack_from(data)
    _check((size, magic, depth) == (len(data), FILE_MAGIC, 32), "not a timeline document")
    doc, at = Document(width, height, [], []), HEADER.size
    for frame in range(count):
        frame_size, magic, few, duration, _, many = FRAME.unpack_from(data, at)
        _check(magic == FRAME_MAGIC, "a frame is malformed")
        doc.durations.append(duration)
        place = at + FRAME.size
        for _ in range(many or few):
            n, kind = struct.unpack_from("<IH", data, place)
            _read_chunk(doc, frame, kind, data[place + 6 : place + n])
            place += n
        at += frame_size
        _check(place == at, "a frame has another size")
    _check(at == len(data), "there is data after the frames")
    return doc


def _read_chunk(doc: Document, frame: int, kind: int, body: bytes) -> None:
    if kind == LAYER:
        flags, opacity = struct.unpack_from("<H10xB", body)
        doc.layers.append(Layer(f"layer-{len(doc.layers)}", body[18:].decode(), bool(flags & 1), opacity))
    elif kind == CEL:
        layer, x, y, width, height = struct.unpack_from("<Hhh10xHH", body)
        doc.layers[layer].cels.append(Cel(frame, np.frombuffer(zlib.decompress(body[20:]), np.uint8).reshape(height, width, 4), x, y))
    elif kind == TAGS:
        at = 10
        for _ in range(struct.unpack_from("<H", body)[0]):
            first, last, direction, n = struct.unpack_from("<HHB12xH", body, at)
            doc.tags.append(Tag(body[at + 19 : at + 19 + n].decode(), first, last, DIRECTIONS[direction]))
            at += 19 + n
