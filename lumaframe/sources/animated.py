"""GIF and APNG animations: grammar, frame data, and the fold that composes frames on one canvas."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

from .document import Document, SourceError, main_layer, need
from .png import SIGNATURE, inflate, unfilter

#: Limits of both formats: bytes of a file, pixels of a side, of the canvas and of all frames, and frames.
FILE, SIDE, CANVAS, FRAMES, OUTPUT = 16 << 20, 4096, 16_777_216, 1000, 67_108_864


@dataclass
class Frame:
    """A rectangle to draw. drawn is filled in when the frame is decoded: height x width x 4 bytes, and where to draw."""

    left: int
    top: int
    width: int
    height: int
    duration: int
    dispose: str  # keep, clear, previous, or background, which clears to a colour
    blend: bool = False
    background: tuple[int, int, int, int] = (0, 0, 0, 0)
    data: bytes = b""
    palette: np.ndarray | None = None
    transparent: int | None = None
    code_size: int = 0

    @property
    def area(self) -> tuple[slice, slice]:
        return slice(self.top, self.top + self.height), slice(self.left, self.left + self.width)


def over(below: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Straight alpha: above over below, halves rounded up."""
    a, b = above[..., 3:].astype(np.int64), below[..., 3:].astype(np.int64)
    total = a * 255 + b * (255 - a)
    mixed = above[..., :3].astype(np.int64) * a * 255 + below[..., :3].astype(np.int64) * b * (255 - a)
    safe = np.maximum(total, 1)
    out = np.concatenate(((2 * mixed + safe) // (2 * safe), (2 * total + 255) // 510), axis=-1)
    return np.where(total == 0, 0, out).astype(np.uint8)


def compose(width: int, height: int, drawn: Iterable[tuple[Frame, np.ndarray, np.ndarray | None]]) -> Iterator[np.ndarray]:
    """The canvas after each frame is drawn and before it is disposed of.

    drawn: frames in order, each with its pixels and a mask of those to draw (None: all)."""
    canvas = np.zeros((height, width, 4), np.uint8)
    for frame, pixels, mask in drawn:
        kept = canvas[frame.area].copy() if frame.dispose == "previous" else None
        spot = canvas[frame.area]
        new = over(spot, pixels) if frame.blend else pixels
        spot[...] = new if mask is None else np.where(mask[..., None], new, spot)
        yield canvas.copy()
        if frame.dispose in ("clear", "background"):
            canvas[frame.area] = frame.background if frame.dispose == "background" else 0
        elif kept is not None:
            canvas[frame.area] = kept


class Reader:
    """Takes bytes from the front; what is missing is truncated data."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        need(self.at + n <= len(self.data), "truncated-data", "the file is cut off")
        self.at += n
        return self.data[self.at - n : self.at]

    def unpack(self, form: str) -> tuple:
        return struct.unpack(form, self.take(struct.calcsize(form)))

    def blocks(self) -> list[bytes]:
        out = []
        while n := self.take(1)[0]:
            out.append(self.take(n))
        return out

    def colours(self, bits: int) -> np.ndarray:
        return np.frombuffer(self.take(3 << (bits + 1)), np.uint8).reshape(-1, 3)


def gif_delay(centiseconds: int) -> int:
    return max(20, min(65535, centiseconds * 10)) if centiseconds else 100


def parse_gif(data: bytes) -> tuple[int, int, list[Frame]]:
    """Width, height and frames that are not decoded yet; all limits hold before a pixel is."""
    need(len(data) <= FILE, "file-too-large", f"the file has more than {FILE} bytes")
    r = Reader(data)
    need(r.take(6) == b"GIF89a", "unsupported-version", "not a GIF89a file")
    width, height, packed, back, aspect = r.unpack("<2H3B")
    need(1 <= width <= SIDE and 1 <= height <= SIDE and width * height <= CANVAS, "allocation-limit", "the canvas is empty or too large")
    need(aspect == 0, "unsupported-pixel-aspect-ratio", "pixels that aren't square are not supported")
    shared = r.colours(packed & 7) if packed & 0x80 else None
    frames, control, loops = [], None, 0
    while True:
        need(r.at < len(data), "missing-trailer", "the file has no trailer")
        kind = r.take(1)[0]
        if kind == 0x3B:
            need(control is None, "ambiguous-stream", "a graphic control has no image")
            need(not data[r.at :].strip(b"\0"), "trailing-data", "there is data after the trailer")
            break
        if kind == 0x21:
            control, loops = _gif_extension(r, control, loops)
            continue
        need(kind == 0x2C, "invalid-block", f"a block of kind {kind:#04x} is not known")
        need(len(frames) < FRAMES, "frame-limit", f"there are more than {FRAMES} frames")
        need(width * height * (len(frames) + 1) <= OUTPUT, "allocation-limit", "all frames together are too large")
        frames.append(_gif_image(r, width, height, not frames, shared, back, control))
        control = None
    need(frames, "invalid-frame", "there is no frame")
    return width, height, frames


def _gif_extension(r: Reader, control: tuple | None, loops: int) -> tuple[tuple | None, int]:
    """The pending graphic control (delay, disposal, transparent index or None), and the loop extensions so far."""
    label = r.take(1)[0]
    if label == 0xF9:
        need(control is None, "ambiguous-stream", "a frame has two graphic controls")
        need(r.take(1)[0] == 4, "invalid-block", "a graphic control has another size than 4")
        packed, delay, clear, end = r.unpack("<BHBB")
        need(end == 0 and not packed & 0xE0, "invalid-block", "a graphic control is malformed")
        need(not packed & 2, "unsupported-user-input", "waiting for input is not supported")
        need((packed >> 2) & 7 < 4, "unsupported-disposal", "a disposal method is not known")
        return (delay, (packed >> 2) & 7, clear if packed & 1 else None), loops
    if label == 0xFF:
        need(r.take(1)[0] == 11, "invalid-block", "an application extension has another size than 11")
        name, blocks = r.take(11), r.blocks()
        if name in (b"NETSCAPE2.0", b"ANIMEXTS1.0"):
            need(loops == 0, "ambiguous-stream", "there are two loop extensions")
            need([len(b) for b in blocks] == [3] and blocks[0][0] == 1, "invalid-block", "a loop extension is malformed")
            loops += 1
        return control, loops
    need(label == 0xFE, "unsupported-extension", f"extension {label:#04x} is not supported")
    r.blocks()
    return control, loops


def _gif_image(r: Reader, width: int, height: int, first: bool, shared: np.ndarray | None, back: int, control: tuple | None) -> Frame:
    left, top, w, h, packed = r.unpack("<4HB")
    need(w and h and left + w <= width and top + h <= height, "invalid-frame", "a frame is empty or reaches beyond the canvas")
    need(not first or (w, h) == (width, height), "invalid-frame", "the first frame must cover the canvas")
    need(not packed & 0x18, "invalid-block", "an image descriptor has reserved bits")
    need(not packed & 0x40, "unsupported-interlacing", "interlacing is not supported")
    palette = r.colours(packed & 7) if packed & 0x80 else shared
    need(palette is not None, "invalid-color-table", "a frame has no colours")
    delay, disposal, clear = control or (0, 0, None)
    need(clear is None or clear < len(palette), "invalid-palette-index", "the transparent index is not in the palette")
    solid = disposal == 2 and clear is None
    need(not solid or (shared is not None and back < len(shared)), "invalid-palette-index", "the background is not in the palette")
    size = r.take(1)[0]
    need(2 <= size <= 8, "invalid-lzw", "the code size must be from 2 to 8")
    dispose = ("keep", "keep", "background" if solid else "clear", "previous")[disposal]
    colour = (*shared[back].tolist(), 255) if solid else (0, 0, 0, 0)
    return Frame(left, top, w, h, gif_delay(delay), dispose, background=colour, data=b"".join(r.blocks()), palette=palette, transparent=clear, code_size=size)


def lzw_decode(data: bytes, code_size: int, size: int) -> bytes:
    """Exactly size indexes. The stream starts with a clear code and stops with an end code and at most 7 zero bits."""
    bad = lambda what: SourceError("invalid-lzw", what)
    clear, end = 1 << code_size, (1 << code_size) + 1
    roots = [bytes([i]) for i in range(clear)] + [b"", b""]
    table, width, last, out, total = list(roots), code_size + 1, None, [], 0
    buffer = bits = at = 0
    started = False
    while True:
        while bits < width and at < len(data):
            buffer |= data[at] << bits
            bits, at = bits + 8, at + 1
        if bits < width:
            raise bad("the data stops before its end code")
        code, buffer, bits = buffer & ((1 << width) - 1), buffer >> width, bits - width
        if code == clear:
            table, width, last, started = list(roots), code_size + 1, None, True
            continue
        if not started:
            raise bad("the data must start with a clear code")
        if code == end:
            break
        if code > len(table) or code > 4095 or (last is None and code >= clear) or (code == len(table) and last is None):
            raise bad(f"code {code} is not known")
        word = table[code] if code < len(table) else last + last[:1]
        out.append(word)
        total += len(word)
        if total > size:
            raise bad("there are too many pixels")
        if last is not None and len(table) < 4096:
            table.append(last + word[:1])
            if len(table) == 1 << width and width < 12:
                width += 1
        last = word
    if total != size:
        raise bad("there are too few pixels")
    if bits + 8 * (len(data) - at) > 7 or buffer:
        raise bad("there is data after the end code")
    return b"".join(out)


def lzw_encode(indexes: bytes, code_size: int) -> bytes:
    clear, end = 1 << code_size, (1 << code_size) + 1
    codes, table, width, word = [(clear, code_size + 1)], {bytes([i]): i for i in range(clear)}, code_size + 1, b""
    following = end + 1
    for i in indexes:
        if (longer := word + bytes([i])) in table:
            word = longer
            continue
        codes.append((table[word], width))
        if following < 4096:
            table[longer] = following
            if following == 1 << width and width < 12:
                width += 1
            following += 1
        word = bytes([i])
    if word:
        codes.append((table[word], width))
        if following < 4096 and following == 1 << width and width < 12:
            width += 1
    codes.append((end, width))
    value = shift = 0
    for code, n in codes:
        value |= code << shift
        shift += n
    return value.to_bytes((shift + 7) // 8, "little")


def draw_gif(frame: Frame) -> tuple[Frame, np.ndarray, np.ndarray | None]:
    indexes = np.frombuffer(lzw_decode(frame.data, frame.code_size, frame.width * frame.height), np.uint8).reshape(frame.height, frame.width)
    need(indexes.max() < len(frame.palette), "invalid-palette-index", "a colour is not in the palette")
    pixels = np.full((frame.height, frame.width, 4), 255, np.uint8)
    pixels[..., :3] = frame.palette[indexes]
    return frame, pixels, None if frame.transparent is None else indexes != frame.transparent


def import_gif(data: bytes) -> Document:
    width, height, frames = parse_gif(data)
    return main_layer(width, height, [f.duration for f in frames], list(compose(width, height, map(draw_gif, frames))), "gif-layer-0", "GIF frames")


#: The chunks that an animation may have.
APNG_CHUNKS = (b"IHDR", b"acTL", b"fcTL", b"IDAT", b"fdAT", b"IEND")


def apng_delay(numerator: int, denominator: int) -> int:
    d = denominator or 100
    return max(1, min(65535, (2 * numerator * 1000 + d) // (2 * d)))


def _apng_chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    need(len(data) <= FILE, "file-too-large", f"the file has more than {FILE} bytes")
    need(len(data) >= 8, "truncated-data", "the signature is cut off")
    need(data.startswith(SIGNATURE), "invalid-png", "not a PNG file")
    out, r = [], Reader(data)
    r.take(8)
    while r.at < len(data):
        need(not out or out[-1][0] != b"IEND", "trailing-data", "there is data after the last chunk")
        size, kind = r.unpack(">I4s")
        body = r.take(size)
        (crc,) = r.unpack(">I")
        need(kind.isalpha() and kind[2:3].isupper(), "invalid-chunk", "a chunk has an invalid type")
        need(zlib.crc32(kind + body) == crc, "invalid-crc", "a chunk is damaged")
        out.append((kind, body))
    need(out and out[-1][0] == b"IEND", "truncated-data", "the last chunk is missing")
    return out


def parse_apng(data: bytes) -> tuple[int, int, list[Frame]]:
    """Width, height and frames whose data is still compressed."""
    chunks = _apng_chunks(data)
    kinds = [k for k, _ in chunks]
    need(kinds[0] == b"IHDR" and len(chunks[0][1]) == 13 and not chunks[-1][1], "invalid-chunk", "the first or last chunk is malformed")
    need(b"acTL" in kinds or not {b"fcTL", b"fdAT"} & set(kinds), "invalid-chunk", "frames need an animation control")
    need(b"acTL" in kinds, "not-animated", "the image is not animated")
    need(kinds.count(b"acTL") == 1, "invalid-chunk", "there are two animation controls")
    extra = [k for k in kinds if k not in APNG_CHUNKS]
    need(not extra, "unsupported-chunk", f"chunk {extra[0].decode() if extra else ''} is not supported")
    width, height, *form = struct.unpack(">2I5B", chunks[0][1])
    need(1 <= width <= SIDE and 1 <= height <= SIDE and width * height <= CANVAS, "allocation-limit", "the canvas is empty or too large")
    need(form == [8, 6, 0, 0, 0], "unsupported-format", "only RGBA of 8 bits without interlacing is supported")
    need(kinds[1] == b"acTL" and len(chunks[1][1]) == 8, "invalid-chunk", "the animation control must come second")
    count, _ = struct.unpack(">2I", chunks[1][1])
    need(1 <= count <= FRAMES and width * height * count <= OUTPUT, "allocation-limit", "there are no frames, or too many")
    need(kinds[2] == b"fcTL", "invalid-chunk", "a frame control must come third")
    frames, at, number = [], 2, 0
    while at < len(chunks) - 1:
        need(kinds[at] == b"fcTL", "invalid-chunk", f"chunk {kinds[at].decode()} is out of place")
        need(len(frames) < count, "invalid-frame", "there are more frames than announced")
        need(len(chunks[at][1]) == 26, "invalid-chunk", "a frame control is malformed")
        sequence, frame = _apng_control(chunks[at][1], not frames, width, height)
        need(sequence == number, "invalid-sequence", f"number {number} is missing")
        number, at, parts, own = number + 1, at + 1, [], b"fdAT" if frames else b"IDAT"
        while kinds[at] == own:
            body = chunks[at][1]
            if frames:
                need(len(body) >= 4, "invalid-chunk", "frame data is too short")
                need(struct.unpack_from(">I", body)[0] == number, "invalid-sequence", f"number {number} is missing")
                number, body = number + 1, body[4:]
            parts.append(body)
            at += 1
        need(parts, "invalid-frame", "a frame has no data")
        need(kinds[at] in (b"fcTL", b"IEND"), "invalid-chunk", f"chunk {kinds[at].decode()} is out of place")
        frame.data = b"".join(parts)
        frames.append(frame)
    need(len(frames) == count, "invalid-frame", "there are fewer frames than announced")
    return width, height, frames


def _apng_control(body: bytes, first: bool, width: int, height: int) -> tuple[int, Frame]:
    sequence, w, h, left, top, numerator, denominator, dispose, blend = struct.unpack(">5I2H2B", body)
    need(w and h and left + w <= width and top + h <= height, "invalid-frame", "a frame is empty or reaches beyond the canvas")
    need(not first or (w, h) == (width, height), "invalid-frame", "the first frame must cover the canvas")
    need(dispose <= (1 if first else 2), "unsupported-operation", "a disposal is not known, or not for the first frame")
    need(blend <= 1, "unsupported-operation", "a blend operation is not known")
    return sequence, Frame(left, top, w, h, apng_delay(numerator, denominator), ("keep", "clear", "previous")[dispose], bool(blend))


def draw_apng(frame: Frame) -> tuple[Frame, np.ndarray, None]:
    try:
        rows = inflate(frame.data, frame.height * (1 + 4 * frame.width))
    except ValueError as e:
        raise SourceError("invalid-zlib", f"frame data can't be inflated: {e}") from None
    try:
        return frame, unfilter(rows, 4 * frame.width, frame.height, 4).reshape(frame.height, frame.width, 4), None
    except ValueError as e:
        raise SourceError("invalid-zlib", str(e)) from None


def import_apng(data: bytes) -> Document:
    width, height, frames = parse_apng(data)
    return main_layer(width, height, [f.duration for f in frames], list(compose(width, height, map(draw_apng, frames))), "apng-layer-0", "APNG frames")
