"""Dates, keys, labels and names that document files carry, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagequarry.functions.text import roman_value

#: Font name prefixes with their families, in order, and style suffixes.
FAMILIES = {
    "Times": "Times New Roman", "TimesNewRoman": "Times New Roman", "Helvetica": "Arial", "Arial": "Arial",
    "Courier": "Courier New", "CourierNew": "Courier New", "Symbol": "Symbol", "ZapfDingbats": "Wingdings",
    "Calibri": "Calibri", "Cambria": "Cambria", "Georgia": "Georgia", "Verdana": "Verdana", "Tahoma": "Tahoma",
    "Garamond": "Garamond", "BookAntiqua": "Book Antiqua", "Palatino": "Palatino Linotype",
    "CenturySchoolbook": "Century Schoolbook", "Consolas": "Consolas", "SegoeUI": "Segoe UI",
    "Minion": "Minion Pro", "Myriad": "Myriad Pro",
}
SUFFIXES = [
    "-BoldItalic", "-BoldOblique", "-SemiBoldItalic", "-LightItalic", "-Bold", "-Italic", "-Oblique", "-Roman", "-Regular", "-Light",
    "-SemiBold", "-Medium", "-Black", "BoldItalic", "BoldMT", "ItalicMT", "PSMT", "MT", "PS",
]
UNSTYLED = "(?i)^(.+?)(?:" + "|".join(SUFFIXES) + ")$"


def pdf_date(text: Column) -> Column:
    """``D:YYYYMMDDHHmmSS+HH'mm'`` as UTC without zone; parts after the year may be missing, and are clamped.

    Null without a year, for days that a month does not have, and for offsets over 14 hours.
    """
    s = F.regexp_replace(text, "^D:", "")

    def part(at: int, n: int, otherwise: int) -> Column:
        digits = F.substring(s, at + 1, n)
        return F.when(digits.rlike(rf"^\d{{{n}}}$"), digits.cast("int")).otherwise(otherwise)

    def within(value: Column, low: int, high: int) -> Column:
        return F.least(F.greatest(value, F.lit(low)), F.lit(high))

    sign = F.when(F.substring(s, 15, 1) == "-", -1).when(F.substring(s, 15, 1) == "+", 1).otherwise(0)
    offset = sign * (part(15, 2, 0) * 60 + part(18, 2, 0))
    parts = (within(part(4, 2, 1), 1, 12), within(part(6, 2, 1), 1, 31), within(part(8, 2, 0), 0, 23), within(part(10, 2, 0), 0, 59), within(part(12, 2, 0), 0, 59))
    local = F.try_make_timestamp_ntz(part(0, 4, 0), *parts)
    return F.when((part(0, 4, 0) >= 1) & (F.abs(offset) <= 14 * 60), F.timestamp_add("MINUTE", -offset, local))


def little_endian(n: Column, size: int) -> Column:
    return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(n.cast("long"), 8 * k).bitwiseAND(255)), 2, "0") for k in range(size)]))


def file_key(pages: Column, identifier: Column, data: Column) -> Column:
    """Half a SHA-256 of the page count and the identifier, else of size, beginning and end of the file."""
    edge, size = 1 << 16, F.octet_length(data)
    tail = F.when(size > edge, F.substring(data, -edge, edge)).otherwise(F.lit(b""))
    body = F.concat(little_endian(size, 8), F.substring(data, 1, edge), tail)
    named = F.concat(F.lit("id:"), identifier).cast("binary")
    content = F.when(F.coalesce(identifier, F.lit("")) != "", named).otherwise(body)
    return F.substring(F.sha2(F.concat(little_endian(pages, 4), content), 256), 1, 32)


def number_label(marker: Column, level: int = 0) -> Column:
    """A list marker as ``format, start, label``; with leading zeros or unknown letters it is a literal."""
    token = F.regexp_replace(marker, r"^[().]+|[().]+$", "")
    upper = F.substring(token, 1, 1) == F.upper(F.substring(token, 1, 1))
    zero = token.rlike("^0.")
    decimal = token.rlike(r"^\d{1,9}$")
    roman = token.rlike("^([ivxlcdmIVXLCDM]{2,}|[iI])$")
    letter = token.rlike("^[a-zA-Z]$")
    style = (
        F.when(zero, "none").when(decimal, "decimal").when(roman, F.when(upper, "upperRoman").otherwise("lowerRoman"))
        .when(letter, F.when(upper, "upperLetter").otherwise("lowerLetter")).otherwise("none")
    )
    start = F.when(zero, 1).when(decimal, token.cast("int")).when(roman, F.greatest(roman_value(token), F.lit(0))).when(letter, F.ascii(F.upper(token)) - 64).otherwise(1)
    label = F.when(style == "none", marker).otherwise(F.replace(marker, token, F.lit(f"%{min(max(level, 0), 4) + 1}")))
    return F.struct(style.alias("format"), start.alias("start"), label.alias("label"))


def xml_text(text: Column) -> Column:
    """Text that XML may hold: breaks as newlines, tabs kept, other control characters dropped."""
    breaks = F.regexp_replace(text, "[\\u2028\\u2029]", "\n")
    return F.regexp_replace(breaks, "[\\x00-\\x08\\x0B-\\x1F\\x7F\\uFFFE\\uFFFF]", "")


def font_family(name: Column, serif: Column) -> Column:
    """The family that a font's name tells, without subset prefix and style."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), "^[A-Z]{6}\\+(?=.)", ""), "^([^,]+),.*$", "$1")
    clean = F.regexp_replace(F.regexp_replace(bare, UNSTYLED, "$1"), "[- ]+$", "")
    found = F.when(clean == "", F.when(serif, "Times New Roman").otherwise("Calibri"))
    for prefix, family in FAMILIES.items():
        found = found.when(F.startswith(F.lower(F.replace(clean, F.lit(" "), F.lit(""))), F.lit(prefix.lower())), family)
    return found.otherwise(clean)


def initials(author: Column) -> Column:
    """Up to three capitals of a name's parts; ``PDF`` without any."""
    parts = F.filter(F.split(author, "[ ._-]+"), lambda p: p.rlike(r"^\p{L}"))
    text = F.array_join(F.slice(F.transform(parts, lambda p: F.upper(F.substring(p, 1, 1))), 1, 3), "")
    return F.when(text != "", text).otherwise("PDF")


def age(ts: Column, now: Column) -> Column:
    """How long ago, as people say it."""
    seconds = F.timestamp_diff("SECOND", ts, now)
    whole = lambda unit: F.floor(seconds / unit).cast("string")
    return (
        F.when(seconds < 60, "just now").when(seconds < 3600, F.concat(whole(60), F.lit(" min ago"))).when(seconds < 86400, F.concat(whole(3600), F.lit(" h ago")))
        .when(seconds < 2 * 86400, "yesterday").otherwise(F.date_format(ts, "d MMM yyyy"))
    )
