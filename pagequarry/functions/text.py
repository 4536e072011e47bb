"""Text rules of the document model as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_'’]+"
MIN_VISIBLE = 8


def visible_chars(text: Column) -> Column:
    """Code points that are no white space."""
    return F.char_length(F.regexp_replace(text, r"(?U)\s", ""))


def folded(text: Column) -> Column:
    """Runs of white space as one space, no space in front, no soft hyphens."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "­", ""), r"(?U)\s+", " "), "^ ", "")


def running_head_key(text: Column) -> Column:
    """Digits as ``#``, pairs of blanks as one, trimmed."""
    return F.replace(F.regexp_replace(F.trim(text), r"\d+", "#"), F.lit("  "), F.lit(" "))


def heading_key(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{Nd}]", ""))


def matches(text: Column, query: str) -> Column:
    """How many times ``query`` occurs without overlap."""
    return ((F.char_length(text) - F.char_length(F.replace(text, F.lit(query), F.lit("")))) / len(query)).cast("long")


def hex_colour(rgb: Column) -> Column:
    return F.concat(F.lit("#"), F.lpad(F.hex(rgb), 6, "0"))


def roman_value(text: Column) -> Column:
    """The value of a Roman numeral; null when it has other letters."""
    values = F.create_map(*[F.lit(x) for pair in (("i", 1), ("v", 5), ("x", 10), ("l", 50), ("c", 100), ("d", 500), ("m", 1000)) for x in pair])
    digits = F.transform(F.filter(F.split(F.lower(text), ""), lambda c: c != ""), lambda c: values[c])
    total = F.aggregate(
        F.reverse(digits),
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")),
        lambda a, d: F.struct(F.when(d < a["last"], a["sum"] - d).otherwise(a["sum"] + d).alias("sum"), d.alias("last")),
        lambda a: a["sum"],
    )
    return F.when(text.rlike("^[ivxlcdmIVXLCDM]+$"), total)


def file_size(n: Column) -> Column:
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024 * 1024, F.concat(F.floor(n / 1024).cast("string"), F.lit(" KB")))
        .otherwise(F.concat(F.floor(n / (1024 * 1024)).cast("string"), F.lit(" MB")))
    )
