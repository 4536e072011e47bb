"""Content of a page as glyphs and objects: a stack machine over its operators.

Text is placed a shown string at a time, as arrays: codes, advances, places and boxes. Forms are
run in place, eight deep. Boxes are in points from the page's upper left corner as it is seen.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import cached_property

import numpy as np

from pagequarry.sources.page_objects import Name, Operator, Page, PageFile, PageFileError, Stream, value

Matrix = tuple[float, float, float, float, float, float]
UNIT: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
#: Forms within forms, sizes that are believed and the one taken otherwise, bold from this weight on.
FORMS, MOST_SIZE, USUAL_SIZE, BOLD = 8, 1600, 11.0, 600
#: Text that is not shown, flags of a font (slanted, bold by force).
INVISIBLE, ITALIC, FORCED_BOLD = 3, 1 << 6, 1 << 18
#: Of a glyph's size: a gap that is a blank, a step down that is a new line, and the height where a font says none.
BLANK, LINE, ABOVE, BELOW = 0.2, 0.5, 0.75, -0.25
_HYPHENS, _CONTROLS = "\ufffe\x02", frozenset("\0\r\ufffe\x02")
USUAL_WIDTH = 500
#: The two commonest operators together: a text matrix and a string in digits.
_PLACED = re.compile(rb"\s*((?:[+-]?(?:\d+\.?\d*|\.\d+)\s+){6})Tm\s*<([0-9A-Fa-f]*)>\s*Tj(?=[\s/<\[(]|$)")
#: Straight parts of a curve.
FLAT = 8


def times(a: Matrix, b: Matrix) -> Matrix:
    return a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5]


def placed(m: Matrix, x, y):
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


@dataclass(frozen=True)
class Font:
    """What a font says of its codes: bytes a code, widths in thousandths, letters."""

    name: str = ""
    bold: bool = False
    italic: bool = False
    wide: int = 1
    widths: dict = field(default_factory=dict)
    usual: float = USUAL_WIDTH
    letters: dict = field(default_factory=dict)
    above: float = ABOVE
    below: float = BELOW

    def codes(self, text: bytes) -> np.ndarray:
        return np.frombuffer(text, np.uint8).astype(np.int64) if self.wide == 1 else np.frombuffer(text[: len(text) // 2 * 2], ">u2").astype(np.int64)

    @cached_property
    def points(self) -> np.ndarray:
        """Code points of codes that are one letter each, 0 of others."""
        out = np.zeros(1 << 16, "<u4")
        for code, letter in self.letters.items():
            if isinstance(code, int) and 0 <= code < len(out) and len(letter) == 1 and not 0xD800 <= ord(letter) < 0xE000:
                out[code] = ord(letter)
        return out

    def text(self, codes: np.ndarray) -> str | list[str]:
        """Letters of codes, as a string where each is one letter."""
        points = self.points[codes]
        return points.tobytes().decode("utf-32-le") if points.all() else [self.letter(c) for c in codes.tolist()]

    def letter(self, code: int) -> str:
        if code in self.letters:
            return self.letters[code]
        return bytes([code]).decode("cp1252", "replace") if self.wide == 1 else chr(code) if code < 0xD800 else "\ufffd"


def _to_letters(data: bytes) -> dict[int, str]:
    """A font's table of codes and letters: single ones and ranges."""
    out: dict[int, str] = {}
    number = lambda x: int.from_bytes(x, "big")
    shown = lambda x: x.decode("utf-16-be", "replace")
    for kind, body in re.findall(rb"begin(bfchar|bfrange)(.*?)end\1", data, re.S):
        at, row = 0, []
        while True:
            one, at = value(body, at)
            if isinstance(one, Operator):
                break
            row.append(one)
            if kind == b"bfchar" and len(row) == 2:
                if all(isinstance(x, bytes) for x in row):
                    out[number(row[0])] = shown(row[1])
                row = []
            elif kind == b"bfrange" and len(row) == 3:
                low, high, to = row
                if isinstance(low, bytes) and isinstance(high, bytes):
                    for i in range(min(number(high) - number(low) + 1, 1 << 16)):
                        if isinstance(to, list):
                            letter = shown(to[i]) if i < len(to) and isinstance(to[i], bytes) else None
                        else:
                            letter = shown(to[:-2] + struct.pack(">H", (number(to[-2:]) + i) & 0xFFFF)) if isinstance(to, bytes) and len(to) > 1 else None
                        if letter is not None:
                            out[number(low) + i] = letter
                row = []
    return out


def _font(file: PageFile, entries: dict) -> Font:
    get = file.get
    below = get(entries.get("DescendantFonts"))
    inner = get(below[0]) if isinstance(below, list) and below else None
    composite = isinstance(inner, dict)
    about = get((inner if composite else entries).get("FontDescriptor"))
    about = about if isinstance(about, dict) else {}
    name = str(get(entries.get("BaseFont")) or "").split("+")[-1]
    flags, weight = get(about.get("Flags")) or 0, get(about.get("FontWeight")) or 0
    widths, letters = {}, {}
    if composite:
        row = [get(x) for x in get(inner.get("W")) or []]
        at = 0
        while at + 1 < len(row):
            if isinstance(row[at + 1], list):
                widths |= {row[at] + i: get(w) for i, w in enumerate(row[at + 1])}
                at += 2
            else:
                widths |= dict.fromkeys(range(row[at], min(row[at + 1], row[at] + (1 << 16)) + 1), row[at + 2] if at + 2 < len(row) else USUAL_WIDTH)
                at += 3
        usual = get(inner.get("DW"))
        usual = 1000 if usual is None else usual
    else:
        first = get(entries.get("FirstChar")) or 0
        widths = {first + i: get(w) for i, w in enumerate(get(entries.get("Widths")) or [])}
        usual = get(about.get("MissingWidth")) or USUAL_WIDTH
        coding = get(entries.get("Encoding"))
        code = 0
        for one in (get(coding.get("Differences")) or []) if isinstance(coding, dict) else []:
            if isinstance(one, Name):
                if len(one) == 1 or (m := re.match(r"u(?:ni)?([0-9A-F]{4,6})$", one)):
                    letters[code] = one if len(one) == 1 else chr(min(int(m[1], 16), 0x10FFFF))
                code += 1
            elif isinstance(one, int):
                code = one
    table = get(entries.get("ToUnicode"))
    if isinstance(table, Stream):
        letters |= _to_letters(file.bytes_of(table))
    high, low = get(about.get("Ascent")) or 1000 * ABOVE, get(about.get("Descent")) or 1000 * BELOW
    said = name.lower()
    return Font(name, weight >= BOLD or bool(flags & FORCED_BOLD) or "bold" in said, bool(flags & ITALIC) or "italic" in said or "oblique" in said, 2 if composite else 1, widths, usual, letters, high / 1000, -abs(low) / 1000)


@dataclass(frozen=True)
class State:
    """What is saved and restored: matrix, colours, line width and text settings."""

    matrix: Matrix = UNIT
    fill: int = 0
    line: int = 0
    width: float = 1.0
    font: Font = Font()
    size: float = 0.0
    apart: float = 0.0
    apart_words: float = 0.0
    scale: float = 1.0
    leading: float = 0.0
    rise: float = 0.0
    mode: int = 0


def _rgb(numbers: list) -> int:
    """A colour of one, three or four parts as red, green and blue."""
    if len(numbers) == 4:
        c, m, y, k = numbers
        numbers = [(1 - c) * (1 - k), (1 - m) * (1 - k), (1 - y) * (1 - k)]
    elif len(numbers) == 1:
        numbers = numbers * 3
    if len(numbers) != 3:
        return 0
    r, g, b = (round(255 * min(max(x, 0), 1)) for x in numbers)
    return r << 16 | g << 8 | b


class Reading:
    """A page's glyphs and objects, as its operators are run."""

    def __init__(self, file: PageFile, page: Page, text: bool = True) -> None:
        self.file, self.page, self.text = file, page, text
        self.glyphs: list[tuple] = []  # letters, boxes, then what all letters of a string share
        self.objects: list[tuple] = []
        self.fonts: dict[int, Font] = {}
        left, low, right, high = page.box
        frames = {0: (1, 0, 0, -1, -left, high), 1: (0, 1, 1, 0, -low, -left), 2: (-1, 0, 0, 1, right, -low), 3: (0, -1, -1, 0, high, right)}
        self.frame: Matrix = tuple(map(float, frames[page.turn]))
        wide, tall = right - left, high - low
        self.width, self.height = (tall, wide) if page.turn % 2 else (wide, tall)
        self.marks: list[int] = []
        self.run(file.content(page), page.resources, State(), 0, set())

    def run(self, data: bytes, resources: dict, state: State, depth: int, within: set) -> None:
        get = self.file.get
        at, row, saved = 0, [], []
        text_matrix = line_matrix = UNIT
        path: list[tuple[float, float]] = []  # corners, in the page's own units
        pieces: list[int] = []  # corners of each part of the path
        straight = True
        while True:
            if not row and (m := _PLACED.match(data, at)):
                at, text_matrix = m.end(), tuple(map(float, m[1].split()))
                line_matrix, text_matrix = text_matrix, self._show(state, text_matrix, [bytes.fromhex((m[2] + b"0" * (len(m[2]) % 2)).decode())])
                continue
            one, at = value(data, at)
            if not isinstance(one, Operator):
                row.append(one)
                continue
            if one == "":
                return
            numbers = [x for x in row if isinstance(x, int | float) and not isinstance(x, bool)]
            if one == "q":
                saved.append(state)
            elif one == "Q":
                state = saved.pop() if saved else state
            elif one == "cm" and len(numbers) == 6:
                state = replace(state, matrix=times(tuple(map(float, numbers)), state.matrix))
            elif one == "w" and numbers:
                state = replace(state, width=float(numbers[0]))
            elif one in ("g", "rg", "k", "sc", "scn"):
                state = replace(state, fill=_rgb(numbers))
            elif one in ("G", "RG", "K", "SC", "SCN"):
                state = replace(state, line=_rgb(numbers))
            elif one == "BT":
                text_matrix = line_matrix = UNIT
            elif one == "Tf" and len(row) >= 2:
                state = replace(state, font=self._font_of(resources, row[-2]), size=float(numbers[-1]) if numbers else 0.0)
            elif one in ("Tc", "Tw", "TL", "Ts") and numbers:
                state = replace(state, **{{"Tc": "apart", "Tw": "apart_words", "TL": "leading", "Ts": "rise"}[one]: float(numbers[0])})
            elif one == "Tz" and numbers:
                state = replace(state, scale=numbers[0] / 100)
            elif one == "Tr" and numbers:
                state = replace(state, mode=int(numbers[0]))
            elif one == "Tm" and len(numbers) == 6:
                text_matrix = line_matrix = tuple(map(float, numbers))
            elif one in ("Td", "TD", "T*") or one in ("'", '"'):
                if one == "TD" and len(numbers) >= 2:
                    state = replace(state, leading=-float(numbers[1]))
                if one == '"' and len(numbers) >= 2:
                    state = replace(state, apart_words=float(numbers[0]), apart=float(numbers[1]))
                step = (numbers[0], numbers[1]) if one in ("Td", "TD") and len(numbers) >= 2 else (0, -state.leading)
                text_matrix = line_matrix = times((1, 0, 0, 1, *step), line_matrix)
                if one in ("'", '"') and row and isinstance(row[-1], bytes):
                    text_matrix = self._show(state, text_matrix, [row[-1]])
            elif one in ("Tj", "TJ") and row:
                text_matrix = self._show(state, text_matrix, row[-1] if isinstance(row[-1], list) else [row[-1]])
            elif one in ("BMC", "BDC"):
                about = get(row[-1]) if row else None
                if isinstance(about, Name) and one == "BDC":
                    about = get((get(resources.get("Properties")) or {}).get(about))
                number = get(about.get("MCID")) if isinstance(about, dict) else None
                self.marks.append(number if isinstance(number, int) else self.marks[-1] if self.marks else -1)
            elif one == "EMC":
                self.marks = self.marks[:-1]
            elif one == "re" and len(numbers) >= 4:
                x, y, w, h = numbers[:4]
                pieces.append(len(path))
                path += [placed(state.matrix, a, b) for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]
            elif one in ("m", "l") and len(numbers) >= 2:
                if one == "m":
                    pieces.append(len(path))
                path.append(placed(state.matrix, *numbers[:2]))
            elif one in ("c", "v", "y") and len(numbers) >= 4:
                straight = False
                path += self._curve(path, [placed(state.matrix, a, b) for a, b in zip(numbers[::2], numbers[1::2], strict=False)], one)
            elif one in ("f", "F", "f*", "S", "s", "B", "B*", "b", "b*", "n"):
                if path and one != "n":
                    self._path(state, path, pieces, straight, one)
                path, pieces, straight = [], [], True
            elif one == "sh":
                self._object("shading", [(0.0, 0.0), (self.width, self.height)], state.fill, None, 0.0, depth)
            elif one == "BI":
                at = self._inline(data, at, state, depth)
            elif one == "Do" and row:
                self._do(resources, row[-1], state, depth, within)
            row = []

    @staticmethod
    def _curve(path: list, corners: list, operator: str) -> list:
        """A curve's corners as ``FLAT`` points on it."""
        start = path[-1] if path else corners[0]
        if operator == "v":
            corners = [start, *corners]
        elif operator == "y":
            corners = [*corners, corners[-1]]
        if len(corners) != 3:
            return corners
        t = np.arange(1, FLAT + 1)[:, None] / FLAT
        a, b, c, d = (np.array(x) for x in (start, *corners))
        return [tuple(x) for x in ((1 - t) ** 3 * a + 3 * t * (1 - t) ** 2 * b + 3 * t**2 * (1 - t) * c + t**3 * d).tolist()]

    def _font_of(self, resources: dict, name: object) -> Font:
        fonts = self.file.get(resources.get("Font"))
        entries = self.file.get(fonts.get(str(name))) if isinstance(fonts, dict) else None
        if not isinstance(entries, dict):
            return Font()
        if id(entries) not in self.fonts:
            self.fonts[id(entries)] = _font(self.file, entries)
        return self.fonts[id(entries)]

    def _show(self, state: State, matrix: Matrix, parts: list) -> Matrix:
        """Place the strings of ``parts``, moved by the numbers between them; the text matrix after them."""
        for part in parts:
            if isinstance(part, int | float):
                matrix = times((1, 0, 0, 1, -part / 1000 * state.size * state.scale, 0), matrix)
                continue
            if not isinstance(part, bytes):
                continue
            font, codes = state.font, state.font.codes(part)
            widths = (np.array([font.widths.get(c, font.usual) for c in codes.tolist()], np.float64) if font.widths else np.full(len(codes), font.usual, np.float64)) / 1000 * state.size
            steps = widths + state.apart
            if font.wide == 1:
                steps += (codes == 32) * state.apart_words
            steps *= state.scale
            ends = np.cumsum(steps)
            starts = ends - steps
            if self.text and len(codes):
                whole = times(times(matrix, state.matrix), self.frame)
                x, y = (starts, starts + widths * state.scale), (state.rise + font.below * state.size, state.rise + font.above * state.size)
                boxes = np.empty((len(codes), 4))
                if whole[1] == 0 == whole[2]:  # upright, as most text is
                    xs, ys = [whole[0] * v + whole[4] for v in x], [whole[3] * v + whole[5] for v in y]
                    np.minimum(*xs, out=boxes[:, 0])
                    np.maximum(*xs, out=boxes[:, 2])
                    boxes[:, 1], boxes[:, 3] = min(ys), max(ys)
                else:
                    corners = [placed(whole, x[i], b) for i in (0, 1) for b in y]
                    xs, ys = (np.stack([c[k] for c in corners]) for k in (0, 1))
                    np.stack([xs.min(axis=0), ys.min(axis=0), xs.max(axis=0), ys.max(axis=0)], axis=1, out=boxes)
                size = state.size * abs(whole[0] * whole[3] - whole[1] * whole[2]) ** 0.5
                size = size if 0 < size <= MOST_SIZE else USUAL_SIZE
                down = (whole[2] ** 2 + whole[3] ** 2) ** 0.5 or 1.0
                along = placed(whole, 0, state.rise)
                base = (along[0] * whole[2] + along[1] * whole[3]) / down  # place of the line across the writing
                self.glyphs.append((font.text(codes), boxes, base, size, font.name, font.bold, font.italic, state.fill, state.mode == INVISIBLE, self.marks[-1] if self.marks else -1))
            matrix = times((1, 0, 0, 1, float(ends[-1]) if len(ends) else 0.0, 0), matrix)
        return matrix

    def _object(self, kind: str, corners: list, fill: int | None, line: int | None, width: float, depth: int, pieces: list[int] | None = None, rule: str | None = None) -> None:
        placed_ = [placed(self.frame, *c) if kind != "shading" else c for c in corners]
        x, y = zip(*placed_, strict=True)
        starts = {i for i in pieces or [] if i}
        shape = None if pieces is None else [v for i, c in enumerate(placed_) for v in ((math.nan, math.nan, *c) if i in starts else c)]
        self.objects.append((kind, min(x), min(y), max(x), max(y), fill, line, width, depth, self.marks[-1] if self.marks else -1, rule, shape))

    def _path(self, state: State, path: list, pieces: list[int], straight: bool, operator: str) -> None:
        fills, strokes = operator[0] in "fFBb", operator[0] in "SsBb"
        corners = {(round(x, 6), round(y, 6)) for x, y in path}
        square = straight and len(pieces) == 1 and len(corners) == 4 and len({x for x, _ in corners}) == 2 and len({y for _, y in corners}) == 2
        scale = abs(state.matrix[0] * state.matrix[3] - state.matrix[1] * state.matrix[2]) ** 0.5
        self._object("rectangle" if square and fills else "path", path, state.fill if fills else None, state.line if strokes else None, state.width * scale if strokes else 0.0, 0, pieces, "even-odd" if operator.endswith("*") else "non-zero")

    def _inline(self, data: bytes, at: int, state: State, depth: int) -> int:
        """A picture within the operators: its box, and the place after it."""
        start = re.compile(rb"\bID[\s]").search(data, at)
        end = re.compile(rb"[\s]EI(?=[\s]|$)").search(data, start.end() if start else at)
        self._object("image", [placed(state.matrix, x, y) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))], None, None, 0.0, depth)
        return end.end() if end else len(data)

    def _do(self, resources: dict, name: object, state: State, depth: int, within: set) -> None:
        named = self.file.get(resources.get("XObject"))
        thing = self.file.get(named.get(str(name))) if isinstance(named, dict) else None
        if not isinstance(thing, Stream):
            return
        if self.file.get(thing.entries.get("Subtype")) == "Image":
            self._object("image", [placed(state.matrix, x, y) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))], None, None, 0.0, depth)
        elif self.file.get(thing.entries.get("Subtype")) == "Form" and depth < FORMS and id(thing) not in within:
            own = self.file.get(thing.entries.get("Matrix"))
            own = tuple(float(self.file.get(x)) for x in own) if isinstance(own, list) and len(own) == 6 else UNIT
            inner = self.file.get(thing.entries.get("Resources"))
            self.run(self.file.bytes_of(thing), inner if isinstance(inner, dict) else resources, replace(state, matrix=times(own, state.matrix)), depth + 1, within | {id(thing)})

    def _stretches(self):
        """Yield what stands before a stretch of letters ("", a blank or a new line), the letters, their boxes and style, in the order shown.

        Controls go but for hyphens. Text that is not shown counts only where no other is, as under a scan.
        """
        shown = any(not hidden and not "".join(letters).isspace() for letters, *_, hidden, _ in self.glyphs)
        last, blank = None, True  # the box, line and size before, and whether a blank was there
        for letters, boxes, base, size, *style in self.glyphs:
            if style[-2] == shown:
                continue
            wide = BLANK * size
            cuts = [0, *(np.flatnonzero(boxes[1:, 0] - boxes[:-1, 2] > wide) + 1).tolist(), len(letters)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                before = ""
                if last is not None:
                    box, base0, size0 = last
                    far = max(size, size0)
                    if abs(base - base0) > LINE * far:
                        before = "\n"
                    elif letters[a] != " " and not blank and boxes[a, 0] - box[2] > BLANK * far:
                        before = " "
                part, places = letters[a:b], boxes[a:b]
                text = "".join(part)
                last, blank = (boxes[b - 1], base, size), text.endswith((" ", "\n"))
                if len(text) != len(part) or not _CONTROLS.isdisjoint(text):  # ligatures, controls and letters beyond the table
                    kept = [("-" if c in _HYPHENS else c, i) for i, letter in enumerate(part) for c in letter if c not in "\0\r"]
                    part, places = [c for c, _ in kept], places[[i for _, i in kept]]
                yield before, part, places, (size, *style)

    def text_of(self) -> str:
        return "".join(before + "".join(part) for before, part, _, _ in self._stretches())

    def parts(self) -> Iterator[tuple[str | list[str], np.ndarray | None, tuple]]:
        """Letters, boxes and ``size, font, bold, italic, colour, hidden, mark``, a stretch at a time.

        Where a gap is wide a blank is put in, where the line changes a new line; they have no box, and the style of what is before them.
        """
        last = None
        for before, part, places, style in self._stretches():
            if before:
                yield before, None, last or style
            if before or len(part):
                last = style if len(part) else last or style
            if len(part):
                yield part, places, style


def read(file: PageFile, page: Page, text: bool = True) -> Reading:
    """A page's content; what cannot be read is a ``PageFileError``."""
    try:
        return Reading(file, page, text)
    except PageFileError:
        raise
    except (ValueError, TypeError, KeyError, IndexError, OverflowError, RecursionError, AttributeError, struct.error) as e:
        raise PageFileError("page", f"{type(e).__name__}: {e}") from e
