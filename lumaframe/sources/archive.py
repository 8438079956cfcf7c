"""ZIP archives and the little XML that layered formats keep in them, read strictly."""

from __future__ import annotations

import re
import struct
import zlib
from dataclasses import dataclass, field

from .document import SourceError, need
from .png import inflate

LOCAL, CENTRAL, END, BIG = 0x04034B50, 0x02014B50, 0x06054B50, 0xFFFFFFFF
STORED, DEFLATED, UTF8_NAMES, ENCRYPTED = 0, 8, 0x0800, 1
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")


@dataclass(frozen=True)
class Limits:
    """What a format allows: entries, bytes of one and of all, the length of a path, flags besides those of names."""

    entries: int
    total: int
    path: int
    entry: int | None = None
    any_flags: bool = False
    file: int = 0


@dataclass
class Entry:
    name: str
    method: int
    content: bytes


def unsafe(path: str, most: int, directory: bool = True) -> bool:
    """Whether a path could leave its folder, or is no path at all."""
    bare = path.removesuffix("/")
    return not bare or len(path) > most or "\0" in path or "\\" in path or path[0] == "/" or bool(_SCHEME.match(path)) or (not directory and path != bare) or not {"", ".", ".."}.isdisjoint(bare.split("/"))


def text(data: bytes, code: str) -> str:
    try:
        return data.decode("utf-8-sig" if data.startswith(b"\xef\xbb\xbf") else "utf-8")
    except UnicodeDecodeError:
        raise SourceError(code, "text is not valid UTF-8") from None


def _fields(data: bytes, form: str, at: int, what: str) -> tuple:
    need(0 <= at <= len(data) - struct.calcsize(form), "invalid-container", f"the ZIP {what} is cut off")
    return struct.unpack_from(form, data, at)


def _end(data: bytes) -> int:
    """Where the end record is whose comment reaches the end of the archive."""
    at = len(data) - 22
    while at >= max(0, len(data) - 22 - 0xFFFF):
        at = data.rfind(struct.pack("<I", END), 0, at + 4)
        if at < 0:
            break
        if at + 22 + struct.unpack_from("<H", data, at + 20)[0] == len(data):
            return at
        at -= 1
    raise SourceError("invalid-container", "the ZIP archive has no end record")


def read(data: bytes, limits: Limits) -> list[Entry]:
    """The entries in the order of their place. Sizes, sums, names and places must agree."""
    need(len(data) <= limits.file, "file-too-large", f"the file has more than {limits.file} bytes")
    end = _end(data) if len(data) >= 22 else -1
    need(end >= 0, "invalid-container", "the ZIP archive has no end record")
    disk, start_disk, here, count, size, start = struct.unpack_from("<4H2I", data, end + 4)
    need(not disk and not start_disk and here == count, "unsupported-zip", "archives on several disks are not supported")
    need(count != 0xFFFF and size != BIG, "unsupported-zip", "ZIP64 is not supported")
    need(0 < count <= limits.entries, "allocation-limit", f"an archive must have 1 to {limits.entries} entries")
    need(start + size <= end, "invalid-container", "the ZIP directory lies outside of the archive")
    listed, at, total, names = [], start, 0, set()
    for _ in range(count):
        magic, _, _, flags, method, _, _, crc, packed, plain, n, extra, comment, _, _, _, offset = _fields(data, "<I6H3I5H2I", at, "directory")
        need(magic == CENTRAL, "invalid-container", "the ZIP directory is malformed")
        need(at + 46 + n + extra + comment <= len(data), "invalid-container", "the ZIP directory is cut off")
        need(BIG not in (packed, plain, offset), "unsupported-zip", "ZIP64 is not supported")
        need(not flags & ENCRYPTED, "unsupported-zip", "encrypted entries are not supported")
        need(limits.any_flags or not flags & ~UTF8_NAMES, "unsupported-zip", "an entry has flags that are not supported")
        need(method in (STORED, DEFLATED), "unsupported-zip", f"compression method {method} is not supported")
        total += plain
        need(total <= limits.total and plain <= (limits.entry or plain), "allocation-limit", "the archive's content is too large")
        name = text(data[at + 46 : at + 46 + n], "invalid-container")
        need(not unsafe(name, limits.path), "unsafe-path", "an entry has an unsafe path")
        key = name if limits.any_flags else name.removesuffix("/")
        need(key not in names, "invalid-container", "two entries have one name")
        names.add(key)
        listed.append((offset, name, flags, method, crc, packed, plain))
        at += 46 + n + extra + comment
    need(at == start + size, "invalid-container", "the ZIP directory has another size")
    listed.sort(key=lambda x: x[0])
    return [_entry(data, x, after) for x, after in zip(listed, [*(y[0] for y in listed[1:]), start])]


def _entry(data: bytes, listed: tuple, after: int) -> Entry:
    offset, name, flags, method, crc, packed, plain = listed
    magic, _, own_flags, own_method, _, _, _, _, _, n, extra = _fields(data, "<I5H3I2H", offset, "entry")
    begin = offset + 30 + n + extra
    need(magic == LOCAL, "invalid-container", "a ZIP entry is malformed")
    need(begin + packed <= len(data), "invalid-container", "a ZIP entry is cut off")
    need(begin + packed <= after, "invalid-container", "ZIP entries overlap")
    need((own_flags, own_method) == (flags, method) and data[offset + 30 : offset + 30 + n] == name.encode(), "invalid-container", "a ZIP entry and the directory differ")
    content = data[begin : begin + packed]
    if method == DEFLATED:
        try:
            content = inflate(content, plain, -15)
        except ValueError:
            raise SourceError("invalid-container", "a ZIP entry can't be inflated") from None
    need(len(content) == plain and zlib.crc32(content) == crc, "invalid-container", "a ZIP entry is damaged")
    return Entry(name, method, content)


def by_name(entries: list[Entry]) -> dict[str, Entry]:
    return {e.name: e for e in entries}


def require(entries: dict[str, Entry], name: str) -> bytes:
    need(name in entries and not name.endswith("/"), "missing-entry", f"the archive has no {name}")
    return entries[name].content


@dataclass
class Element:
    name: str
    attributes: dict[str, str]
    self_closing: bool = False
    children: list[Element] = field(default_factory=list)


#: The entities of XML.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
_TOKEN = re.compile(
    r"(?P<space>\s+)|<!--(?P<comment>.*?)-->|<\?.*?\?>|(?P<declaration><!)|</\s*(?P<close>[^\s<>]+)\s*>"
    r"|<(?P<open>[A-Za-z_:][A-Za-z0-9_.:-]*)(?P<attributes>(?:\s*[A-Za-z_:][A-Za-z0-9_.:-]*\s*=\s*(?:\"[^\"<]*\"|'[^'<]*'))*)\s*(?P<self>/)?\s*>",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([A-Za-z_:][A-Za-z0-9_.:-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
_ENTITY = re.compile(r"&(?:#x([0-9A-Fa-f]+)|#([0-9A-Fa-f]+)|([a-z]+));|&")


def parse_xml(source: str, code: str) -> Element:
    """The root of a document of elements alone: no text, no declarations, ASCII names."""
    bad = SourceError(code, "the XML is malformed")

    def decode(m: re.Match) -> str:
        if m[3]:
            if m[3] not in ENTITIES:
                raise bad
            return ENTITIES[m[3]]
        digits, base = (m[1], 16) if m[1] else (m[2], 10)
        value = int(digits, base) if digits and (base == 16 or digits.isdigit()) else 0
        if not 0 < value <= 0x10FFFF or 0xD800 <= value <= 0xDFFF:
            raise bad
        return chr(value)

    root, stack, at = None, [], 0
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise bad
        at = m.end()
        need(not m["declaration"], code, "XML declarations are not allowed")
        if m["close"]:
            if not stack or stack.pop().name != m["close"]:
                raise bad
        elif m["open"]:
            pairs = [(k, _ENTITY.sub(decode, a if a is not None else b)) for k, a, b in ((x[1], x[2], x[3]) for x in _ATTRIBUTE.finditer(m["attributes"]))]
            element = Element(m["open"], dict(pairs), bool(m["self"]))
            if len(element.attributes) != len(pairs) or not stack and root:
                raise bad
            if stack:
                stack[-1].children.append(element)
            else:
                root = element
            if not m["self"]:
                stack.append(element)
    if stack or root is None:
        raise bad
    return root


#: Names that tell of animation.
ANIMATION = {"animation", "animations", "frame", "frames", "keyframe", "timeline"}


def is_animation(name: str) -> bool:
    return name.lower() in ANIMATION


def only(element: Element, *allowed: str) -> None:
    extra = [a for a in element.attributes if a not in allowed]
    need(not extra, "unsupported-feature", f"<{element.name}> has the attribute {extra[0] if extra else ''}, which is not supported")


def whole(value: str | None, code: str, low: int, high: int, range_code: str | None = None, default: str | None = None) -> int:
    """A canonical whole number from low to high."""
    value = default if value is None else value
    need(value is not None and re.fullmatch(r"-?(?:0|[1-9][0-9]*)" if low < 0 else r"0|[1-9][0-9]*", value), code, "a number is malformed")
    need(low <= int(value) <= high, range_code or code, f"a number must be from {low} to {high}")
    return int(value)
