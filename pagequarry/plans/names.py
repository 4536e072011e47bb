"""Dates, keys, labels, names and cleaned text of document files (S18, S19, K7, K8, scalar families of fonts, initials, ages)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.functions import names as n
from pagequarry.plans.registry import query
from pagequarry.sources.views import table

_PAD = "lpad(CAST(event_id % {} AS STRING), 2, '0')"
_STAMP = "substring(concat('D:', CAST(2000 + event_id % 30 AS STRING), " + ", ".join(_PAD.format(k) for k in (15, 33, 26, 61, 62)) + ", CASE WHEN event_id % 3 = 0 THEN '+' ELSE '-' END, " + _PAD.format(16) + ", '''', " + _PAD.format(60) + ", ''''), 1, CAST(event_id % 25 AS INT))"


def _part(at: int, size: int, otherwise: int) -> str:
    return f"coalesce(TRY_CAST(nullif(regexp_extract(substring(s, {at + 1}, {size}), '^\\d{{{size}}}$'), '') AS INTEGER), {otherwise})"


def _within(at: int, low: int, high: int) -> str:
    return f"lpad(CAST(least(greatest({_part(at, 2, low)}, {low}), {high}) AS VARCHAR), 2, '0')"


@query(f"WITH t AS (SELECT event_id, regexp_replace({_STAMP}, '^D:', '') AS s FROM events), o AS (SELECT *, CASE substring(s, 15, 1) WHEN '-' THEN -1 WHEN '+' THEN 1 ELSE 0 END * ({_part(15, 2, 0)} * 60 + {_part(18, 2, 0)}) AS off FROM t) SELECT event_id, CASE WHEN {_part(0, 4, 0)} >= 1 AND abs(off) <= 840 THEN strftime(TRY_CAST(concat({_part(0, 4, 0)}, '-', {_within(4, 1, 12)}, '-', {_within(6, 1, 31)}, ' ', {_within(8, 0, 23)}, ':', {_within(10, 0, 59)}, ':', {_within(12, 0, 59)}) AS TIMESTAMP) - off * INTERVAL 1 MINUTE, '%Y-%m-%d %H:%M:%S') END AS utc FROM o")
def pdf_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File dates as UTC; parts are missing, out of range or beyond a month's end in many of them."""
    e = table(spark, sf_dir, "events").select("event_id", F.expr(_STAMP).alias("stamp"))
    return e.select("event_id", F.date_format(n.pdf_date(F.col("stamp")), "yyyy-MM-dd HH:mm:ss").alias("utc"))


def _little_endian(value: str, size: int) -> str:
    return "concat(" + ", ".join(f"lpad(to_hex(({value} >> {8 * k}) & 255), 2, '0')" for k in range(size)) + ")"


@query(f"WITH d AS (SELECT doc_id, hex(encode(text)) AS h, strlen(text) AS size FROM documents) SELECT doc_id, substring(sha256(unhex(concat({_little_endian('doc_id', 4)}, CASE WHEN doc_id % 3 = 0 THEN hex(encode('id:f' || doc_id)) ELSE concat({_little_endian('size', 8)}, substring(h, 1, 131072), CASE WHEN size > 65536 THEN right(h, 131072) ELSE '' END) END))), 1, 32) AS key FROM d")
def file_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache keys of files: by identifier where there is one, else by size, beginning and end."""
    d = table(spark, sf_dir, "documents")
    identifier = F.when(d.doc_id % 3 == 0, F.concat(F.lit("f"), d.doc_id.cast("string")))
    return d.select("doc_id", n.file_key(d.doc_id, identifier, d.text.cast("binary")).alias("key"))


_MARKERS = ["(12)", "iv.", "XIX)", "vix.", "c)", "B.", "007.", "i.", "I)", "q1.", "(mm)", "3.", "l)"]
_MARKER_SQL = "[" + ", ".join(f"'{m}'" for m in _MARKERS) + "][event_id % " + f"{len(_MARKERS)} + 1]"
_ROMAN_SQL = "(SELECT sum(CASE WHEN v[i] < coalesce(v[i + 1], 0) THEN -v[i] ELSE v[i] END) FROM (SELECT list_transform(string_split(lower(token), ''), lambda c: map {'i': 1, 'v': 5, 'x': 10, 'l': 50, 'c': 100, 'd': 500, 'm': 1000}[c]) AS v), LATERAL (SELECT unnest(range(1, len(v) + 1)) AS i))"


@query(f"WITH m AS (SELECT event_id, {_MARKER_SQL} AS marker FROM events), d AS (SELECT DISTINCT marker, trim(marker, '().') AS token FROM m), k AS (SELECT *, CASE WHEN regexp_matches(token, '^0.') THEN 'none' WHEN regexp_matches(token, '^\\d+$') THEN 'decimal' WHEN regexp_matches(token, '^([ivxlcdmIVXLCDM]{{2,}}|[iI])$') THEN CASE WHEN token = upper(token) THEN 'upperRoman' ELSE 'lowerRoman' END WHEN regexp_matches(token, '^[a-zA-Z]$') THEN CASE WHEN token = upper(token) THEN 'upperLetter' ELSE 'lowerLetter' END ELSE 'none' END AS format FROM d), r AS (SELECT marker, token, {_ROMAN_SQL} AS roman FROM k WHERE format LIKE '%Roman') SELECT m.event_id, k.format, CAST(CASE WHEN k.format = 'decimal' THEN TRY_CAST(k.token AS INTEGER) WHEN k.format LIKE '%Roman' THEN greatest(r.roman, 0) WHEN k.format LIKE '%Letter' THEN ascii(upper(k.token)) - 64 ELSE 1 END AS INTEGER) AS start, CASE WHEN k.format = 'none' THEN k.marker ELSE replace(k.marker, k.token, '%1') END AS label FROM m JOIN k USING (marker) LEFT JOIN r USING (marker)")
def list_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List markers as number format, first number and label."""
    marker = F.array(*map(F.lit, _MARKERS))[(F.col("event_id") % len(_MARKERS)).cast("int")]
    return table(spark, sf_dir, "events").select("event_id", n.number_label(marker).alias("x")).select("event_id", "x.format", "x.start", "x.label")


_DIRTY = "concat(text, chr(1), CAST(doc_id AS STRING), chr(9), 'x', chr(13), chr(10), chr(127), 'y')"


@query(f"SELECT doc_id, CAST(length(c) - length(replace(c, chr(10), '')) AS INTEGER) AS breaks, CAST(length(c) - length(replace(c, chr(9), '')) AS INTEGER) AS tabs, md5(c) AS digest FROM (SELECT doc_id, regexp_replace({_DIRTY}, '[\\x00-\\x08\\x0B-\\x1F\\x7F\\x{{FFFE}}\\x{{FFFF}}]', '', 'g') AS c FROM documents)")
def clean_xml_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with what XML cannot hold left out (control characters are added to see it)."""
    c = F.col("c")
    count = lambda ch: F.char_length(c) - F.char_length(F.replace(c, F.lit(ch), F.lit("")))
    d = table(spark, sf_dir, "documents").select("doc_id", n.xml_text(F.expr(_DIRTY)).alias("c"))
    return d.select("doc_id", count("\n").alias("breaks"), count("\t").alias("tabs"), F.md5(c.cast("binary")).alias("digest"))


_FONTS = ["ABCDEF+Times-Roman", "Arial,Bold", "Helvetica-BoldOblique", "CourierNewPSMT", "MT", "", "segoe ui-Light", "Lucida Sans-Medium", "XYZ+Calibri", "GeorgiaBoldItalic", "Minion Pro-SemiBold", "Inter-Regular"]
_FONT_SQL = "[" + ", ".join(f"'{m}'" for m in _FONTS) + f"][event_id % {len(_FONTS)} + 1]"
_FAMILY_SQL = " ".join(f"WHEN starts_with(lower(replace(clean, ' ', '')), '{p.lower()}') THEN '{f}'" for p, f in n.FAMILIES.items())


@query(f"WITH f AS (SELECT event_id, {_FONT_SQL} AS name FROM events), b AS (SELECT *, regexp_replace(regexp_replace(trim(name), '^[A-Z]{{6}}\\+(.+)$', '\\1'), '^([^,]+),.*$', '\\1') AS bare FROM f), c AS (SELECT *, regexp_replace(regexp_replace(bare, '{n.UNSTYLED}', '\\1'), '[- ]+$', '') AS clean FROM b) SELECT event_id, CASE WHEN clean = '' THEN CASE WHEN event_id % 2 = 0 THEN 'Times New Roman' ELSE 'Calibri' END {_FAMILY_SQL} ELSE clean END AS family, regexp_matches(lower(replace(replace(name, ' ', ''), '-', '')), 'bold|black|heavy') AS bold FROM c")
def font_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families and weights as the names of fonts tell them."""
    name = F.array(*map(F.lit, _FONTS))[(F.col("event_id") % len(_FONTS)).cast("int")]
    e = table(spark, sf_dir, "events").select("event_id", name.alias("name"))
    bold = F.lower(F.regexp_replace("name", "[ -]", "")).rlike("bold|black|heavy")
    return e.select("event_id", n.font_family(F.col("name"), F.col("event_id") % 2 == 0).alias("family"), bold.alias("bold"))


@query("SELECT p_partkey, CASE WHEN i = '' THEN 'PDF' ELSE i END AS initials FROM (SELECT p_partkey, array_to_string(list_transform(list_filter(string_split_regex(p_name, '[ ._-]+'), lambda p: regexp_matches(p, '^\\p{L}')), lambda p: upper(p[1]))[1:3], '') AS i FROM part)")
def author_initials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Initials of names."""
    return table(spark, sf_dir, "part").select("p_partkey", n.initials(F.col("p_name")).alias("initials"))


@query("SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || ' min ago' WHEN s < 86400 THEN (s // 3600) || ' h ago' WHEN s < 172800 THEN 'yesterday' ELSE strftime(ts, '%-d %b %Y') END AS age FROM (SELECT event_id, ts, date_sub('second', date_trunc('second', ts), TIMESTAMP '2024-01-20 00:00:00') AS s FROM events)")
def ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long before a given time each event was; later ones are just now."""
    e = table(spark, sf_dir, "events").select("event_id", F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts"))
    return e.select("event_id", n.age(F.col("ts"), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).alias("age"))
