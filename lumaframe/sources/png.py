"""PNG images: chunks, and pixels as RGBA bytes."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from .document import SourceError, need

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel by colour type, and the passes of interlacing: first column and row, steps.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def inflate(data: bytes, size: int, wbits: int = 15) -> bytes:
    """Exactly size bytes from a stream that ends with data; zlib checks codes and sums. ValueError otherwise."""
    stream = zlib.decompressobj(wbits)
    try:
        out = stream.decompress(data, size + 1)
        if len(out) == size and not stream.eof:
            out += stream.decompress(stream.unconsumed_tail, 1)
    except zlib.error as e:
        raise ValueError(str(e)) from None
    if len(out) != size or not stream.eof or stream.unused_data or stream.unconsumed_tail:
        raise ValueError("the stream has another size")
    return out


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def size_of(data: bytes, code: str, most: int | None = None, still: bool = False) -> tuple[int, int]:
    """Width and height, once the chunks prove to be whole: one IHDR first, IEND last. still refuses animations."""
    need(len(data) >= 33 and data.startswith(SIGNATURE), code, "not a PNG image")
    at, size = 8, None
    while True:
        need(len(data) - at >= 12, code, "a PNG chunk is cut off")
        length, kind = struct.unpack_from(">I4s", data, at)
        need(length <= len(data) - at - 12, code, "a PNG chunk is cut off")
        if at == 8:
            need(kind == b"IHDR" and length == 13, code, "a PNG image must start with IHDR")
            size = struct.unpack_from(">II", data, 16)
            if most:
                need(1 <= min(size) and max(size) <= most, "allocation-limit", "a PNG image has too many pixels a side")
            need(min(size) > 0, code, "a PNG image has no pixels")
        else:
            need(kind != b"IHDR", code, "a PNG image has two IHDR chunks")
            need(not (still and kind == b"acTL"), "unsupported-feature", "animated PNG layers are not supported")
        at += 12 + length
        if kind == b"IEND":
            need(length == 0 and at == len(data), code, "a PNG image must end with IEND")
            return size


def unfilter(rows: bytes, width_bytes: int, height: int, step: int) -> np.ndarray:
    """Bytes of a pass from filtered rows. step: bytes of a pixel, 1 at least. ValueError for an unknown filter."""
    data = np.frombuffer(rows, np.uint8).reshape(height, 1 + width_bytes)
    out, above = np.zeros((height, width_bytes), np.uint8), np.zeros(width_bytes, np.uint8)
    for y in range(height):
        kind, line = data[y, 0], data[y, 1:]
        if kind == 0:
            row = line
        elif kind == 1:
            pad = -width_bytes % step
            row = np.cumsum(np.pad(line, (0, pad)).reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)[:width_bytes]
        elif kind == 2:
            row = line + above
        elif kind in (3, 4):
            row = _sequential(int(kind), line.tolist(), above.tolist(), step)
        else:
            raise ValueError(f"unknown filter {kind}")
        out[y] = above = row
    return out


def _sequential(kind: int, line: list[int], above: list[int], step: int) -> np.ndarray:
    """Rows whose bytes depend on those just decoded: mean (3) and Paeth (4)."""
    row = [0] * step + line
    up = [0] * step + above
    for i in range(step, len(row)):
        left, over, corner = row[i - step], up[i], up[i - step]
        if kind == 3:
            guess = (left + over) >> 1
        else:
            p, q, r = abs(over - corner), abs(left - corner), abs(left + over - 2 * corner)
            guess = left if p <= q and p <= r else over if q <= r else corner
        row[i] = (row[i] + guess) & 255
    return np.array(row[step:], np.uint8)


def _samples(rows: bytes, width: int, height: int, samples: int, depth: int) -> np.ndarray:
    """height x width x samples values of a pass."""
    line = (width * samples * depth + 7) // 8
    data = unfilter(rows, line, height, max(1, samples * depth // 8))
    if depth == 16:
        return data.reshape(height, width, samples, 2).astype(np.uint16) @ np.array([256, 1], np.uint16)
    if depth < 8:
        bits = np.unpackbits(data, axis=1).reshape(height, -1, depth)
        data = (bits @ (1 << np.arange(depth - 1, -1, -1))).astype(np.uint8)[:, : width * samples]
    return data.reshape(height, width, samples)


def decode(data: bytes) -> np.ndarray:
    """Height x width x 4 bytes of RGBA. Colour profiles are not applied. ValueError for what is no PNG image."""
    parts, at = [], 8
    if not data.startswith(SIGNATURE):
        raise ValueError("not a PNG image")
    while at + 12 <= len(data):
        length, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + length]
        if len(body) < length or zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + length)[0]:
            raise ValueError("a PNG chunk is damaged")
        parts.append((kind, body))
        at += 12 + length
    found = dict(reversed(parts))
    if not parts or parts[0][0] != b"IHDR" or b"IEND" not in found:
        raise ValueError("a PNG image is cut off")
    width, height, depth, kind, packing, filters, interlaced = struct.unpack(">IIBBBBB", found[b"IHDR"])
    if kind not in SAMPLES or depth not in (1, 2, 4, 8, 16) or packing or filters or interlaced > 1 or not width or not height:
        raise ValueError("not a kind of PNG image that there is")
    n = SAMPLES[kind]
    passes = [((width - x + dx - 1) // dx, (height - y + dy - 1) // dy, x, y, dx, dy) for x, y, dx, dy in (PASSES if interlaced else ((0, 0, 1, 1),))]
    sizes = [h * (1 + (w * n * depth + 7) // 8) if w and h else 0 for w, h, *_ in passes]
    rows = inflate(b"".join(b for k, b in parts if k == b"IDAT"), sum(sizes))
    values, start = np.zeros((height, width, n), np.uint16), 0
    for (w, h, x, y, dx, dy), size in zip(passes, sizes):
        if size:
            values[y::dy, x::dx] = _samples(rows[start : start + size], w, h, n, depth)
        start += size
    return _rgba(values, kind, depth, found)


def _rgba(values: np.ndarray, kind: int, depth: int, found: dict[bytes, bytes]) -> np.ndarray:
    out = np.full((*values.shape[:2], 4), 255, np.uint8)
    clear = found.get(b"tRNS")
    if kind == 3:
        palette = np.frombuffer(found.get(b"PLTE", b""), np.uint8).reshape(-1, 3)
        if values.max(initial=0) >= len(palette):
            raise ValueError("a colour is not in the palette")
        alpha = np.full(len(palette), 255, np.uint8)
        alpha[: len(clear or b"")] = np.frombuffer(clear or b"", np.uint8)[: len(palette)]
        out[..., :3], out[..., 3] = palette[values[..., 0]], alpha[values[..., 0]]
        return out
    colours = 1 if kind in (0, 4) else 3
    scaled = values >> 8 if depth == 16 else values * (255 // ((1 << depth) - 1))
    out[..., :3] = scaled[..., :colours]
    if kind in (4, 6):
        out[..., 3] = scaled[..., -1]
    elif clear:
        key = np.frombuffer(clear, ">u2")[:colours]
        out[..., 3] = np.where((values == key).all(-1), 0, 255)
    return out


def image(data: bytes, code: str) -> np.ndarray:
    try:
        return decode(data)
    except ValueError as e:
        raise SourceError(code, f"a PNG image can't be decoded: {e}") from None


def encode(pixels: np.ndarray) -> bytes:
    """A PNG image of RGBA bytes."""
    height, width = pixels.shape[:2]
    rows = b"".join(b"\x00" + pixels[y].tobytes() for y in range(height))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
