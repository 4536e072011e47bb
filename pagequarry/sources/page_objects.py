"""Objects of a page description file: values, streams and the pages that they make.

Objects are found by looking for them, never by the file's own table of places: files whose
table is broken or cut read like all others. Of an object that is there twice the later one counts,
as files are changed by appending.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np


class PageFileError(ValueError):
    """What is wrong with a file: ``format``, ``password`` or ``page``."""

    def __init__(self, kind: str, message: str) -> None:
        super().__init__(f"{kind}: {message}")
        self.kind = kind


class Name(str):
    """A name, other than a string."""


class Operator(str):
    """A bare word of a content stream."""


@dataclass(frozen=True)
class Ref:
    number: int


@dataclass
class Stream:
    entries: dict
    raw: bytes


#: Blanks, delimiters and escapes of the format.
_BLANK, _PLAIN = rb"\0\t\n\f\r ", rb"[^\0\t\n\f\r ()<>\[\]{}/%]"
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_TOKEN = re.compile(rb"(?:[" + _BLANK + rb"]|%[^\r\n]*)*(<<|>>|[\[\]{}()]|/" + _PLAIN + rb"*|<[0-9A-Fa-f" + _BLANK + rb"]*>|" + _PLAIN + rb"+)?")
_FIRST, _AROUND = frozenset(b"0123456789+-."), b"<>\0\t\n\f\r "
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)$")
_REFERENCE = re.compile(rb"[" + _BLANK + rb"]+\d+[" + _BLANK + rb"]+R(?!" + _PLAIN + rb")")
_STRING_PART = re.compile(rb"[()\\]")
_HEAD = re.compile(rb"(?<!\d)(\d{1,10})[" + _BLANK + rb"]+\d{1,5}[" + _BLANK + rb"]+obj\b|\bstream(?=\r?\n)")
#: Nested arrays and dictionaries, references that lead to references, and pages of pages: more than any sound file has.
DEPTH = 64


def _literal(data: bytes, at: int) -> tuple[bytes, int]:
    """A string in brackets that starts before ``at``."""
    out, depth = [], 1
    while True:
        m = _STRING_PART.search(data, at)
        if not m:
            return b"".join(out) + data[at:], len(data)
        out.append(data[at : m.start()])
        at = m.end()
        if m[0] == b"\\":
            octal = re.compile(rb"[0-7]{1,3}").match(data, at)
            if octal:
                out.append(bytes([int(octal[0], 8) & 255]))
                at = octal.end()
            elif data[at : at + 2] == b"\r\n":
                at += 2
            else:
                out.append(b"" if data[at : at + 1] in (b"\n", b"\r") else _ESCAPES.get(data[at : at + 1], data[at : at + 1]))
                at += 1
            continue
        depth += 1 if m[0] == b"(" else -1
        if not depth:
            return b"".join(out), at
        out.append(m[0])


def value(data: bytes, at: int, depth: int = 0) -> tuple[object, int]:
    """The value at a place and the place after it; ``Operator`` for a bare word, also for what closes a list, "" at the end."""
    m = _TOKEN.match(data, at)
    token, at = m[1], m.end()
    if token is None:
        return Operator(""), max(at, len(data))
    if token == b"(":
        return _literal(data, at)
    if token in (b"[", b"<<"):
        if depth > DEPTH:
            raise PageFileError("format", "lists within lists")
        items, close = [], "]" if token == b"[" else ">>"
        while True:
            one, at = value(data, at, depth + 1)
            if isinstance(one, Operator) and one in (close, ""):
                break
            items.append(one)
        return (items if close == "]" else {str(k): v for k, v in zip(items[::2], items[1::2], strict=False)}), at
    if token[0] in _FIRST and _NUMBER.match(token):
        if token.isdigit() and (r := _REFERENCE.match(data, at)):
            return Ref(int(token)), r.end()
        return (float(token) if b"." in token else int(token)), at
    if token[:1] == b"/":
        return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes.fromhex(x[1].decode()), token[1:]).decode("latin-1")), at
    if token[:1] == b"<":
        digits = token.translate(None, _AROUND).decode()
        return bytes.fromhex(digits + "0" * (len(digits) % 2)), at
    return {b"true": True, b"false": False, b"null": None}.get(token, Operator(token.decode("latin-1"))), at


def _unpredicted(data: bytes, how: dict) -> bytes:
    """Rows of bytes told from those above or left of them, as sums."""
    if how.get("Predictor", 1) < 10:
        return data
    step = max(1, how.get("Colors", 1) * how.get("BitsPerComponent", 8) // 8)
    wide = (how.get("Columns", 1) * how.get("Colors", 1) * how.get("BitsPerComponent", 8) + 7) // 8
    rows = np.frombuffer(data[: len(data) // (wide + 1) * (wide + 1)], np.uint8).reshape(-1, wide + 1).astype(np.int64)
    above, out = np.zeros(wide, np.int64), []
    for kind, line in zip(rows[:, 0].tolist(), rows[:, 1:], strict=True):
        if kind == 2:
            line = line + above
        elif kind in (1, 3, 4):
            line = line.copy()
            for i in range(wide):
                a, b, c = (line[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
                p = [abs(b - c), abs(a - c), abs(a + b - 2 * c)]
                line[i] = (line[i] + (a if kind == 1 else (a + b) // 2 if kind == 3 else (a, b, c)[p.index(min(p))])) & 255
        above = line & 255
        out.append(above.astype(np.uint8).tobytes())
    return b"".join(out)


@dataclass
class Page:
    """A page with what it inherits: sides in points, quarter turns, resources and content."""

    box: tuple[float, float, float, float]
    turn: int
    resources: dict
    entries: dict


@dataclass
class PageFile:
    data: bytes
    places: dict[int, int] = field(default_factory=dict)
    packed: dict[int, tuple[int, int]] = field(default_factory=dict)
    known: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if b"%PDF-" not in self.data[:1024]:
            raise PageFileError("format", "not a page description file")
        at, heads, streams = 0, [], []
        while m := _HEAD.search(self.data, at):
            at = m.end()
            if m[1]:
                self.places[int(m[1])] = m.end()
                heads.append((m.end(), int(m[1])))
            elif (end := self.data.find(b"endstream", at)) >= 0:  # what looks like an object in a stream is none
                streams.append((m.start(), heads[-1][0] if heads else 0))
                at = end
        if re.search(rb"/Encrypt\b", self.data):
            raise PageFileError("password", "the file is encrypted")
        starts = [h[0] for h in heads]
        for m in re.finditer(rb"/ObjStm\b", self.data):
            k = bisect_right(starts, m.start()) - 1
            if k >= 0 and self.places.get(heads[k][1]) == heads[k][0]:
                self._unpack(heads[k][1])

    def _unpack(self, holder: int) -> None:
        stream = self.get(Ref(holder))
        if isinstance(stream, Stream) and stream.entries.get("Type") == "ObjStm":
            body, first = self.bytes_of(stream), self.get(stream.entries.get("First"))
            numbers = [int(x) for x in body[:first].split()[: 2 * self.get(stream.entries.get("N"))]]
            for number, offset in zip(numbers[::2], numbers[1::2], strict=False):
                if number not in self.places:
                    self.packed[number] = (holder, first + offset)

    def get(self, one: object) -> object:
        """``one`` itself, or what it refers to; null for what is not there."""
        for _ in range(DEPTH):
            if not isinstance(one, Ref):
                return one
            if one.number not in self.known:
                self.known[one.number] = self._read(one.number)
            one = self.known[one.number]
        return None

    def _read(self, number: int) -> object:
        if number in self.places:
            found, at = value(self.data, self.places[number])
            m = re.compile(rb"[" + _BLANK + rb"]*stream\r?\n").match(self.data, at)
            if not (m and isinstance(found, dict)):
                return None if isinstance(found, Operator) else found
            length = self.get(found.get("Length")) if not isinstance(found.get("Length"), Ref) or found["Length"].number != number else None
            end = m.end() + length if isinstance(length, int) else -1
            if not re.compile(rb"[" + _BLANK + rb"]*endstream").match(self.data, max(end, 0)):
                end = self.data.find(b"endstream", m.end())
                end = len(self.data) if end < 0 else end
            return Stream(found, self.data[m.end() : end])
        if number in self.packed:
            holder, at = self.packed[number]
            return value(self.bytes_of(self.get(Ref(holder))), at)[0]
        return None

    def bytes_of(self, stream: Stream) -> bytes:
        """A stream's bytes, unpacked as far as they are sound."""
        data = stream.raw
        filters, how = self.get(stream.entries.get("Filter")), self.get(stream.entries.get("DecodeParms"))
        filters = [self.get(f) for f in (filters if isinstance(filters, list) else [filters] if filters else [])]
        how = [self.get(x) for x in (how if isinstance(how, list) else [how])] + [None] * len(filters)
        for kind, parameters in zip(filters, how, strict=False):
            if kind in ("FlateDecode", "Fl"):
                unpacker, out = zlib.decompressobj(), b""
                try:
                    out = unpacker.decompress(data)
                except zlib.error:
                    for i in range(0, len(data), 256):  # what comes before the damage
                        try:
                            out += (unpacker := unpacker if i else zlib.decompressobj()).decompress(data[i : i + 256])
                        except zlib.error:
                            break
                data = _unpredicted(out, parameters or {})
            elif kind in ("ASCIIHexDecode", "AHx"):
                data = value(b"<" + data.split(b">")[0] + b">", 0)[0]
            else:
                raise PageFileError("page", f"a stream packed as {kind}")
        return data

    def pages(self) -> Iterator[Page]:
        """The pages in order, by the tree from the catalogue, or as they lie in a file without one."""
        roots = [Ref(int(x)) for x in re.findall(rb"/Root[" + _BLANK + rb"]+(\d+)", self.data)]
        catalogues = [c for c in map(self.get, reversed(roots)) if isinstance(c, dict)] or [c for c in (self.get(Ref(n)) for n in [*self.places, *self.packed]) if isinstance(c, dict) and c.get("Type") == "Catalog"]
        tree = catalogues[0].get("Pages") if catalogues else None
        if isinstance(self.get(tree), dict):
            yield from self._under(tree, {}, set(), 0)
        else:
            loose = [p for p in (self.get(Ref(n)) for n in sorted([*self.places, *self.packed])) if isinstance(p, dict) and p.get("Type") == "Page"]
            if not loose:
                raise PageFileError("format", "no pages")
            yield from map(self._page, loose)

    def _under(self, node: object, inherited: dict, seen: set, depth: int) -> Iterator[Page]:
        if isinstance(node, Ref):
            if node.number in seen:
                return
            seen.add(node.number)
        entries = self.get(node)
        if not isinstance(entries, dict) or depth > DEPTH:
            return
        entries = inherited | entries
        if isinstance(self.get(entries.get("Kids")), list) and entries.get("Type") != "Page":
            passed = {k: entries[k] for k in ("Resources", "MediaBox", "CropBox", "Rotate") if k in entries}
            for kid in self.get(entries["Kids"]):
                yield from self._under(kid, passed, seen, depth + 1)
        else:
            yield self._page(entries)

    def _page(self, entries: dict) -> Page:
        def box(name: str) -> tuple | None:
            sides = self.get(entries.get(name))
            sides = [self.get(x) for x in sides] if isinstance(sides, list) else []
            if len(sides) == 4 and all(isinstance(x, int | float) for x in sides):
                a, b, c, d = sides
                if a != c and b != d:
                    return min(a, c), min(b, d), max(a, c), max(b, d)
            return None

        turn = self.get(entries.get("Rotate")) or 0
        resources = self.get(entries.get("Resources"))
        return Page(box("CropBox") or box("MediaBox") or (0.0, 0.0, 612.0, 792.0), int(turn) // 90 % 4 if isinstance(turn, int | float) else 0, resources if isinstance(resources, dict) else {}, entries)

    def content(self, page: Page) -> bytes:
        parts = self.get(page.entries.get("Contents"))
        parts = [self.get(x) for x in parts] if isinstance(parts, list) else [parts]
        return b"\n".join(self.bytes_of(p) for p in parts if isinstance(p, Stream))
