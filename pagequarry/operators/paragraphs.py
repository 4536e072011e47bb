"""Paragraphs out of a page's lines: a fold over the lines in order, in the JVM, with the paragraph so far as its state."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What ends a paragraph. Shares of the column's width or of the line's height, in thousandths or hundredths.
SHORT_LINE, PARAGRAPH_GAP, CODE_GAP = 55, 145, 260
#: List markers, those that a dash or star may only seem to be, and numbers.
BULLET, MAYBE_BULLET = r"^[•◦‣▪●○·⁃∙]\s+", r"^[-–—*o]\s+"
NUMBER = r"^\(?(\d{1,3}|[a-zA-Z]|[ivxlcdmIVXLCDM]{1,6})[.)]\s+"
LINE = "struct<line:bigint,row:int,text:string,l:int,r:int,t:int,b:int,size:int,bold:boolean,mono:boolean,parted:boolean,leader:boolean,fw:int,item:boolean,hang:int>"


def list_kind(text: Column) -> Column:
    return F.when(text.rlike(BULLET), "bullet").when(text.rlike(MAYBE_BULLET), "maybe").when(text.rlike(NUMBER), "number").otherwise("text")


def median_gap(lines: Column) -> Column:
    """The lower median of gaps over 0 between lines that share some width; 0 without any."""
    n = F.size(lines)

    def gap(i):
        a, b = lines[i - 1], lines[i]
        shared = F.least(a["r"], b["r"]) > F.greatest(a["l"], b["l"])
        return F.when((b["t"] > a["b"]) & shared, b["t"] - a["b"])

    gaps = F.when(n > 1, F.array_sort(F.filter(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), gap), lambda g: g.isNotNull())))
    return F.coalesce(F.get(gaps, F.floor((F.size(gaps) - 1) / 2).cast("int")), F.lit(0))


def starts(lines: Column, gap: Column, width: int, char: int) -> Column:
    """For every line of a page whether a paragraph starts there; ``width`` is the column's, ``char`` a letter's.

    The rules, in order: code goes by itself and ends at wide gaps only; markers, lines in parts and
    what follows a leader start anew; so do a clear gap and another style. Then the line before is
    judged by whether the next word would have fitted: against the column where it is flush, its own
    block where it is indented, the column again under a list item, the whole measure where it is
    centred. Last, a line indented from its block starts anew unless it hangs under an item's text.
    """

    def step(acc, x):
        p = acc["last"]
        height = p["b"] - p["t"]
        away, flush = x["t"] - p["b"], F.lit(max(width * SHORT_LINE // 1000, 2 * char))
        next_word, room = x["fw"] * 10 + 6 * char, width - p["r"]  # tenths
        alone = (100 * room > 35 * width) & (10 * x["fw"] >= 9 * (x["r"] - x["l"])) & (10 * (x["r"] - x["l"]) >= 9 * width)
        near = lambda a, b, by: F.abs(a - b) * 10 <= by
        block = F.greatest(3 * height, F.lit(20))
        hangs = acc["hang"].isNotNull() & near(x["l"], acc["hang"], F.greatest(5 * height, F.lit(10 * char)))
        centred = (25 * p["l"] > width) & (25 * room > width) & (50 * F.abs(p["l"] - room) <= width)
        threshold = F.when(acc["gap"] > 0, F.greatest(PARAGRAPH_GAP * acc["gap"], 100 * acc["gap"] + 35 * height)).otherwise(50 * height)
        restyled = (25 * F.abs(p["size"] - x["size"]) > 2 * p["size"]) | (p["bold"] != x["bold"])
        even = lambda y: 50 * F.abs(y["l"] - (width - y["r"])) <= width
        centred_block = acc["even"] & even(x) & (F.greatest(acc["inset"], x["l"]) * 200 > 3 * width)
        indented = (10 * x["l"] > 10 * acc["low"] + 7 * height) & ~centred_block & ~hangs
        fresh = (
            F.when(p["mono"] != x["mono"], True)
            .when(x["mono"], (100 * away > CODE_GAP * height) | (2 * F.abs(p["size"] - x["size"]) > 1))
            .when(x["item"] | x["parted"] | p["leader"] | (100 * away > threshold) | restyled, True)
            .when(p["l"] <= flush, F.when((10 * room > next_word) | alone, True).otherwise(indented))
            .when(near(p["l"], x["l"], block) & near(p["l"], acc["first"], block), F.when(10 * (F.greatest(acc["high"], x["r"]) - p["r"]) > next_word, True).otherwise(indented))
            .when(hangs, F.when((10 * room > next_word) | alone, True).otherwise(indented))
            .when(centred, F.when(10 * (width - (p["r"] - p["l"])) > next_word, True).otherwise(indented))
            .otherwise(indented)
        )
        new = p.isNull() | fresh
        keep = lambda name, one, both: F.when(new, one).otherwise(both).alias(name)
        return F.struct(
            F.concat(acc["done"], F.array(new)).alias("done"), x.alias("last"), acc["gap"].alias("gap"),
            keep("low", x["l"], F.least(acc["low"], x["l"])), keep("high", x["r"], F.greatest(acc["high"], x["r"])), keep("first", x["l"], acc["first"]),
            keep("hang", x["hang"], acc["hang"]), keep("even", even(x), acc["even"] & even(x)), keep("inset", x["l"], F.greatest(acc["inset"], x["l"])),
        )

    none = lambda kind: F.lit(None).cast(kind)
    begin = F.struct(F.expr("cast(array() as array<boolean>)").alias("done"), none(LINE).alias("last"), gap.cast("int").alias("gap"), *[none("int").alias(c) for c in ("low", "high", "first", "hang")], none("boolean").alias("even"), none("int").alias("inset"))
    return F.aggregate(lines, begin, step, lambda acc: acc["done"])


def alignment(lines: Column, width: int) -> Column:
    """``justify``, ``left``, ``center`` or ``right`` for one paragraph's lines."""
    slack, symmetry, n = width * 15 // 1000, width * 2 // 100, F.size(lines)
    left = lambda x: F.abs(x["l"]) <= slack
    right = lambda x: F.abs(width - x["r"]) <= slack
    flush = lambda x: left(x) & right(x)
    inset = F.transform(F.filter(lines, lambda x: (x["l"] > slack) & (width - x["r"] > slack)), lambda x: x["l"])
    spread = F.array_max(F.transform(lines, lambda x: x["l"])) - F.array_min(F.transform(lines, lambda x: x["l"]))
    even = F.forall(lines, lambda x: F.abs(x["l"] - (width - x["r"])) <= symmetry) & (F.size(inset) > 0)
    far = F.array_min(inset) * 100 > F.when(n > 1, 8).otherwise(4) * width
    listed = (list_kind(lines[0]["text"]) != "text") | F.exists(lines, lambda x: x["leader"])
    return (
        F.when(F.forall(lines, flush) & (n > 1), "justify").when((n > 2) & F.forall(F.slice(lines, F.lit(1), n - 1), flush), "justify")
        .when(F.forall(lines, left) | listed, "left").when(even & (((n > 1) & (spread > slack)) | far), "center").when(F.forall(lines, right), "right").otherwise("left")
    )
