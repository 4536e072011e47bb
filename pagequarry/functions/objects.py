"""Rules for what lies on a page: paths, glyph styles, links, annotations, ink. Rectangles are structs ``l, t, r, b``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagequarry.functions.geometry import height, intersection, is_empty, rect, width

#: Page size in points when none is sound, a rule's most thickness and least length, how pale a
#: background is, what part of a page it covers (all in thousandths of a page where they are lengths).
PAGE_SIZE, THIN, LONG, PALE, BACKGROUND = (612, 792), 4, 12, 0xF0, 600
#: First four bytes of font files, kinds of annotations kept, kinds that mark text, image file endings.
SFNT = ["00010000", "74727565", "4F54544F", "74746366"]
KINDS, MARKUP = ["highlight", "underline", "strikeout", "squiggly", "note"], ["highlight", "underline", "strikeout", "squiggly"]
IMAGE_ENDINGS = ["png", "jpg", "jpeg", "bmp", "gif", "tif", "tiff", "webp", "ico"]


def page_size(w: Column, h: Column) -> Column:
    """The size in points, or that of a Letter page where either side is missing or not positive."""
    sound = F.coalesce((w > 0) & (h > 0), F.lit(False))
    return F.struct(F.when(sound, w).otherwise(PAGE_SIZE[0]).alias("w"), F.when(sound, h).otherwise(PAGE_SIZE[1]).alias("h"))


def scanned_text(text: Column) -> Column:
    """Text as a page gives it: no carriage returns and nulls, both hyphen marks as hyphens."""
    return F.translate(F.translate(text, "\r\0", ""), "￾\x02", "--")


def glyph_size(size: Column, determinant: Column) -> Column:
    """Text size by the matrix it is drawn under; 11 where it is not over 0 or beyond 1600."""
    scaled = F.when(F.abs(determinant) > 0, size * F.sqrt(F.abs(determinant))).otherwise(size)
    return F.round(F.when((scaled <= 0) | (scaled > 1600), F.lit(11.0)).otherwise(scaled), 2)


def is_bold(weight: Column, forced: Column, name: Column) -> Column:
    return (weight >= 600) | forced | F.lower(name).rlike("bold|black|heavy|semibold|demi")


def rule_direction(x: Column) -> Column:
    """``across`` or ``down`` for a thin long box, else null."""
    return F.when((height(x) <= THIN) & (width(x) >= LONG), "across").when((width(x) <= THIN) & (height(x) >= LONG), "down")


def channel(rgb: Column, shift: int) -> Column:
    return F.shiftright(rgb, shift).bitwiseAND(F.lit(255))


def is_pale(rgb: Column) -> Column:
    return (channel(rgb, 16) >= PALE) & (channel(rgb, 8) >= PALE) & (channel(rgb, 0) >= PALE)


def is_box(corners: Column) -> Column:
    """Whether corners (``x, y``; a fifth may repeat the first) are those of an upright rectangle."""
    closed = (F.size(corners) == 5) & (corners[0]["x"] == F.get(corners, F.lit(4))["x"]) & (corners[0]["y"] == F.get(corners, F.lit(4))["y"])
    n = F.when(closed, 4).otherwise(F.size(corners))
    along = lambda i: (corners[i]["x"] == corners[(i + 1) % 4]["x"]) | (corners[i]["y"] == corners[(i + 1) % 4]["y"])
    return F.coalesce((n == 4) & F.forall(F.array(*map(F.lit, range(4))), lambda i: along(i)), F.lit(False))


def path_class(x: Column, filled: Column, box: Column, rgb: Column, texts: Column) -> Column:
    """``rule``, ``fill``, ``background`` (a fill that is no drawing) or ``drawing``."""
    behind = is_pale(rgb) | (width(x) * height(x) > BACKGROUND * 1000) | (texts > 0)
    return F.when(rule_direction(x).isNotNull(), "rule").when(filled & box & behind, "background").when(filled & box, "fill").otherwise("drawing")


def rule_thickness(across: Column, stroked_only: Column, stroke: Column) -> Column:
    """A filled rule is as thick as it is across, a stroked one half of that; else the stroke's width (tenths of points)."""
    return F.when(stroked_only & (across >= 2), across / 2.0).when(~stroked_only & (across >= 1), across.cast("double")).otherwise(F.greatest(stroke, F.lit(0)).cast("double"))


def worth_drawing(x: Column, texts: Column) -> Column:
    """Whether a region is a drawing: no speck, not the whole page, and no frame around text."""
    area = width(x) * height(x)
    return (width(x) >= 4) & (height(x) >= 4) & (area >= 800) & (area <= 920_000) & ((area <= 450_000) | (texts < 25))


def to_shown(x: Column, y: Column, w: Column, h: Column, turns: Column) -> Column:
    """A point of a page ``w`` by ``h`` (y upwards) on the page as shown (y downwards), in whole units of the frame."""
    k, down = F.pmod(turns, F.lit(4)), h - y
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    return F.when(k == 1, point(h - down, x)).when(k == 2, point(w - x, h - down)).when(k == 3, point(down, w - x)).otherwise(point(x, down))


def from_shown(x: Column, y: Column, w: Column, h: Column, turns: Column) -> Column:
    """The inverse of ``to_shown``."""
    k = F.pmod(turns, F.lit(4))
    a = F.when(k == 1, y).when(k == 2, w - x).when(k == 3, w - y).otherwise(x)
    b = F.when(k == 1, h - x).when(k == 2, h - y).when(k == 3, x).otherwise(y)
    return F.struct(a.alias("x"), (h - b).alias("y"))


def annotation_hit(bounds: Column, quads: Column, x: Column, y: Column) -> Column:
    """Whether a point is on an annotation: in any of its quads, or in its bounds if it has none."""
    within = lambda q: x.between(q["l"], q["r"]) & y.between(q["t"], q["b"])
    return F.when(F.size(quads) > 0, F.exists(quads, within)).otherwise(within(bounds))


def around(quads: Column) -> Column:
    """The rectangle around quads; null without any."""
    of = lambda f, c: f(F.transform(quads, lambda q: q[c]))
    return F.when(F.size(quads) > 0, rect(of(F.array_min, "l"), of(F.array_min, "t"), of(F.array_max, "r"), of(F.array_max, "b")))


def off_page(x: Column, side: int = 1000) -> Column:
    return (x["b"] <= 0) | (x["t"] >= side) | (x["r"] <= 0) | (x["l"] >= side)


def is_page_scan(x: Column, drawing: Column) -> Column:
    return ~drawing & (width(x) * height(x) >= 600_000)


def ink_rule(w: Column, h: Column, pixels: Column, glyph: Column) -> Column:
    """Ink that is a thin bar: low, long, and mostly filled."""
    return (h <= F.greatest(F.lit(3.0), glyph * 0.35)) & (w >= F.greatest(F.lit(6.0), glyph * 0.5)) & (w >= h * 3) & (100 * pixels >= 55 * w * h)


def ink_drawing(w: Column, h: Column, pixels: Column, glyph: Column) -> Column:
    """Ink that cannot be a glyph: too tall, too wide, or a large sparse outline."""
    sparse = (100 * pixels < 22 * w * h) & (10 * h > 13 * glyph) & (10 * w > 13 * glyph)
    return (10 * h > 26 * glyph) | (w > 9 * glyph) | sparse


def centred_on_bar(part: Column, bar: Column) -> Column:
    """Whether a half of a fraction lines up with its bar."""
    shared = F.least(part["r"], bar["r"]) - F.greatest(part["l"], bar["l"])
    return (shared > 0) & (10 * shared >= 6 * F.least(width(part), width(bar))) & (10 * width(part) <= 16 * width(bar))


def same_place(x: Column, y: Column, most: int = 50) -> Column:
    """Whether all sides are within a twentieth of a page."""
    return F.forall(F.array(*[F.abs(x[c] - y[c]) for c in "ltrb"]), lambda d: d <= most)


def side_distance(x: Column, y: Column) -> Column:
    return sum((F.abs(x[c] - y[c]) for c in "trb"), F.abs(x["l"] - y["l"]))


def covered_share(x: Column, y: Column) -> Column:
    """What part of ``x``, in percent and rounded down, ``y`` covers."""
    i = intersection(x, y)
    return F.when(is_empty(i) | is_empty(x), F.lit(0)).otherwise(F.floor(100 * width(i) * height(i) / (width(x) * height(x)))).cast("long")
