"""Annotations, histories and recents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagequarry.functions.text import hex_colour
from pagequarry.plans.joins import mark_ranges
from pagequarry.plans.layout import _MARKS_SQL, marks
from pagequarry.plans.registry import query
from pagequarry.sources.views import LINES_SQL, PITCH, ROW, WIDE, lines, table

#: The sixteen highlight names and their colours.
HIGHLIGHTS = [
    ("yellow", 0xFFFF00), ("green", 0x00FF00), ("cyan", 0x00FFFF), ("magenta", 0xFF00FF), ("blue", 0x0000FF), ("red", 0xFF0000), ("darkBlue", 0x000080), ("darkCyan", 0x008080),
    ("darkGreen", 0x008000), ("darkMagenta", 0x800080), ("darkRed", 0x800000), ("darkYellow", 0x808000), ("darkGray", 0x808080), ("lightGray", 0xC0C0C0), ("black", 0x000000), ("white", 0xFFFFFF),
]


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits: ``doc_id, annotation, seq, op, rgb, value``, made from events."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 9).alias("annotation"), F.col("event_id").alias("seq"), F.col("event_type").alias("op"), (F.col("event_id") * 7919 % 16777216).alias("rgb"), "value")


@query("SELECT user_id AS doc_id, event_id % 9 AS annotation, max(event_id) AS seq, arg_max(event_type, event_id) AS op, count(*) AS edits FROM events GROUP BY 1, 2")
def annotation_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest state of every annotation."""
    return log(spark, sf_dir).groupBy("doc_id", "annotation").agg(F.max("seq").alias("seq"), F.max_by("op", "seq").alias("op"), F.count("*").alias("edits"))


@query("SELECT user_id AS doc_id, event_id AS seq, count(*) OVER (PARTITION BY user_id, event_id % 3 ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS generation FROM events")
def page_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a page has changed, at each edit."""
    over = Window.partitionBy("doc_id", F.col("seq") % 3).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return log(spark, sf_dir).select("doc_id", "seq", F.count("*").over(over).alias("generation"))


_UNDER_SQL = f"""{LINES_SQL}, u AS (SELECT m.event_id, m.doc_id, m.kind, trim(regexp_replace(substring(substring(text, t // {PITCH} * {ROW} + 1, {ROW}), greatest(CAST(ceil((2 * l - {WIDE}) / {2 * WIDE}.0) AS BIGINT), 0) + 1, greatest(least(CAST(floor((2 * r - {WIDE}) / {2 * WIDE}.0) AS BIGINT), {ROW - 1}) - greatest(CAST(ceil((2 * l - {WIDE}) / {2 * WIDE}.0) AS BIGINT), 0) + 1, 0)), '\\s+', ' ', 'g')) AS marked FROM marks m JOIN lines USING (doc_id, line))"""


def under_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, doc_id, kind, marked``: the text whose letters' centres a mark holds."""
    ranges = mark_ranges(marks(spark, sf_dir)).select("event_id", "a", "z")
    every = marks(spark, sf_dir).select("event_id", "doc_id", "line", "kind").join(ranges, "event_id", "left")
    text = F.substring(F.col("text"), (F.col("a") + 1).cast("int"), (F.col("z") - F.col("a") + 1).cast("int"))
    j = every.join(lines(table(spark, sf_dir, "documents")).select("doc_id", "line", "text"), ["doc_id", "line"])
    return j.select("event_id", "doc_id", "kind", F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")).alias("marked"))


@query(f"WITH {_MARKS_SQL}, {_UNDER_SQL} SELECT event_id, doc_id, CASE WHEN event_id % 3 = 1 OR marked = '' THEN kind WHEN event_id % 3 = 0 THEN marked ELSE marked || ' — ' || kind END AS listing FROM u")
def annotation_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each annotation as the text under it, its note, or both; a mark over nothing shows its note."""
    i, marked, note = F.col("event_id"), F.col("marked"), F.col("kind")
    line = F.when((i % 3 == 1) | (marked == ""), note).when(i % 3 == 0, marked).otherwise(F.concat(marked, F.lit(" — "), note))
    return under_marks(spark, sf_dir).select(i, "doc_id", line.alias("listing"))


#: The names of the colours that annotations are made with.
_NAMED = {0xFFFF00: "Yellow", 0x00FF00: "Green", 0x00FFFF: "Cyan", 0xFF00FF: "Magenta"}
_COLOUR_SQL = "CASE rgb " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _NAMED.items()) + " ELSE '#' || lpad(upper(to_hex(rgb)), 6, '0') END"


@query(f"WITH e AS (SELECT user_id AS doc_id, event_id % 3 AS page, event_id, event_type, CASE WHEN event_id % 4 = 0 THEN [16776960, 65280, 65535, 16711935][event_id // 4 % 4 + 1] ELSE event_id * 7919 % 16777216 END::BIGINT AS rgb FROM events) SELECT doc_id, page, '## Page ' || (page + 1) || chr(10) || string_agg('- **' || upper(substring(event_type, 1, 1)) || substring(event_type, 2) || '** (' || {_COLOUR_SQL} || '): ' || event_id, chr(10) ORDER BY event_id) AS report FROM e GROUP BY doc_id, page")
def annotation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of every page's annotations in order: kind, colour by name or in hexadecimal, and what they say."""
    i = F.col("seq")
    rgb = F.when(i % 4 == 0, F.element_at(F.array(*map(F.lit, _NAMED)), (F.floor(i / 4) % 4 + 1).cast("int")).cast("long")).otherwise(F.col("rgb"))
    colour = F.coalesce(*[F.when(rgb == k, v) for k, v in _NAMED.items()], hex_colour(rgb))
    kind = F.concat(F.upper(F.substring("op", 1, 1)), F.expr("substring(op, 2)"))
    each = log(spark, sf_dir).select("doc_id", (i % 3).alias("page"), "seq", F.concat(F.lit("- **"), kind, F.lit("** ("), colour, F.lit("): "), i.cast("string")).alias("row"))
    body = F.array_join(F.expr("transform(array_sort(collect_list(struct(seq, row))), x -> x.row)"), "\n")
    return each.groupBy("doc_id", "page").agg(body.alias("body")).select("doc_id", "page", F.concat(F.lit("## Page "), (F.col("page") + 1).cast("string"), F.lit("\n"), "body").alias("report"))


@query("SELECT key, ts_last, id_last FROM (SELECT lower(p_name) AS key, max(p_retailprice) AS ts_last, max(p_partkey) AS id_last FROM part GROUP BY 1) ORDER BY ts_last DESC, id_last DESC LIMIT 30")
def recents_top30(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirty newest names, case aside; the limit is the feature's."""
    by = table(spark, sf_dir, "part").groupBy(F.lower("p_name").alias("key")).agg(F.max("p_retailprice").alias("ts_last"), F.max("p_partkey").alias("id_last"))
    return by.orderBy(F.desc("ts_last"), F.desc("id_last")).limit(30)


@query("SELECT sha256(text) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def media_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a distinct content, with the first document that has it."""
    return table(spark, sf_dir, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def nearest_highlight(rgb):
    """The name of the nearest highlight colour; the first wins ties."""
    def part(v, k):
        return F.shiftright(v, k).bitwiseAND(F.lit(255))

    options = []
    for i, (name, value) in enumerate(HIGHLIGHTS):
        d = sum((part(rgb, k) - ((value >> k) & 255)) * (part(rgb, k) - ((value >> k) & 255)) for k in (16, 8, 0))
        options.append(F.struct(d.cast("long").alias("d"), F.lit(i).alias("i"), F.lit(name).alias("name")))
    return F.array_min(F.array(*options))["name"]


_NEAREST_SQL = "list_min([" + ", ".join("{'d': " + " + ".join(f"(((rgb >> {k}) & 255) - {(v >> k) & 255}) * (((rgb >> {k}) & 255) - {(v >> k) & 255})" for k in (16, 8, 0)) + f", 'i': {i}, 'name': '{n}'}}" for i, (n, v) in enumerate(HIGHLIGHTS)) + "]).name"


@query(f"SELECT event_id, '#' || lpad(upper(to_hex(rgb)), 6, '0') AS colour, {_NEAREST_SQL} AS name FROM (SELECT event_id, event_id * 7919 % 16777216 AS rgb FROM events)")
def palette_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours as hexadecimal text and by the nearest name."""
    e = log(spark, sf_dir)
    return e.select(F.col("seq").alias("event_id"), hex_colour(F.col("rgb")).alias("colour"), nearest_highlight(F.col("rgb")).alias("name"))


@query("SELECT d.doc_id, length(d.text) AS n FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def supported_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are left when unsupported ones are skipped."""
    bad = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id")
    return table(spark, sf_dir, "documents").join(bad, "doc_id", "left_anti").select("doc_id", F.char_length("text").cast("long").alias("n"))


@query("SELECT d.doc_id, length(d.text) AS n FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def unsupported_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id")
    return table(spark, sf_dir, "documents").join(bad, "doc_id", "left_semi").select("doc_id", F.char_length("text").cast("long").alias("n"))


_PLACED = "SELECT event_id, user_id AS doc, event_id % 2 = 0 AS saved, row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY event_id) AS idx, event_id * 37 % 5 AS kind, event_id * 13 % 30 * 10 AS l, event_id * 29 % 31 * 10 AS t FROM events"


@query(f"WITH p AS ({_PLACED}), s AS (SELECT * FROM p WHERE saved), n AS (SELECT * FROM p WHERE NOT saved), m AS (SELECT s.event_id, n.event_id AS found, n.idx = s.idx AS same_index, abs(n.l - s.l) + abs(n.t - s.t) AS d, n.idx FROM s JOIN n ON n.doc = s.doc AND n.kind = s.kind AND abs(n.l - s.l) <= 50 AND abs(n.t - s.t) <= 50) SELECT event_id, arg_min(found, CASE WHEN same_index THEN -1 ELSE d END * 1000000 + idx) AS found, bool_or(same_index) AS same_index, count(*) AS candidates FROM m GROUP BY event_id")
def annotation_refind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved annotation among those of the file: the one of its number if it is alike, else the nearest alike.

    Alike: of one kind and within 50 units on both axes; they meet by document, kind and squares
    of 50 units, a saved one in its own and the eight around it.
    """
    i = F.col("event_id")
    idx = F.row_number().over(Window.partitionBy("user_id", i % 2).orderBy("event_id"))
    p = table(spark, sf_dir, "events").select(i, F.col("user_id").alias("doc"), (i % 2 == 0).alias("saved"), idx.alias("idx"), (i * 37 % 5).alias("kind"), (i * 13 % 30 * 10).alias("l"), (i * 29 % 31 * 10).alias("t"))
    p = p.withColumn("column", F.floor(F.col("l") / 50)).withColumn("row", F.floor(F.col("t") / 50))
    around = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1))
    s = p.where("saved").select("event_id", "doc", "kind", "l", "t", F.col("idx").alias("own"), "column", around("row").alias("row")).withColumn("column", around("column"))
    n = p.where("not saved").select(i.alias("found"), "doc", "kind", F.col("l").alias("nl"), F.col("t").alias("nt"), "idx", "column", "row")
    m = s.join(n, ["doc", "kind", "column", "row"]).where("abs(nl - l) <= 50 and abs(nt - t) <= 50").withColumn("same", F.col("idx") == F.col("own"))
    order = F.struct(~F.col("same"), F.abs(F.col("nl") - F.col("l")) + F.abs(F.col("nt") - F.col("t")), "idx")
    return m.groupBy("event_id").agg(F.min_by("found", order).alias("found"), F.bool_or("same").alias("same_index"), F.count("*").alias("candidates"))
