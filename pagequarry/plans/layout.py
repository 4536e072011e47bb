"""Glyphs, lines, hit tests, page layout and structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagequarry.operators.glyphs import placed_lines
from pagequarry.operators.shapes import as_of, islands
from pagequarry.plans.registry import query
from pagequarry.sources.views import GLYPHS_SQL, LINES_SQL, PITCH, ROW, WIDE, lines, table

_RECT = "CAST(floor(value * 10) AS BIGINT) % 600 AS l, event_id % 5 * 16 AS t, CAST(floor(value * 10) AS BIGINT) % 600 + 10 * (5 + event_id % 40) AS r, event_id % 5 * 16 + 12 AS b"
_MARKS_SQL = f"marks AS (SELECT event_id, user_id AS doc_id, event_id % 3 AS line, event_type AS kind, {_RECT} FROM events WHERE value IS NOT NULL)"


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles on documents' lines, made from events: ``event_id, doc_id, line, kind, l, t, r, b``."""
    rect = _RECT.split(", CAST")[0]
    e = table(spark, sf_dir, "events").where("value is not null")
    left = F.expr(rect.split(" AS l")[0])
    return e.select("event_id", F.col("user_id").alias("doc_id"), (F.col("event_id") % 3).alias("line"), F.col("event_type").alias("kind"), left.alias("l"), (F.col("event_id") % 5 * 16).alias("t"), (left + 10 * (5 + F.col("event_id") % 40)).alias("r"), (F.col("event_id") % 5 * 16 + 12).alias("b"))


_VISUAL_SQL = (
    GLYPHS_SQL
    + """, back AS (SELECT *, last_value(l IGNORE NULLS) OVER w AS pl, last_value(t IGNORE NULLS) OVER w AS pt, last_value(r IGNORE NULLS) OVER w AS pr, last_value(b IGNORE NULLS) OVER w AS pb FROM glyphs WINDOW w AS (PARTITION BY doc_id, page, line ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 flags AS (SELECT *, CASE WHEN l IS NOT NULL AND pl IS NOT NULL AND NOT 10 * (least(pb, b) - greatest(pt, t)) >= 3 * least(pb - pt, b - t) AND NOT (2 * (least(pr, r) - greatest(pl, l)) >= least(pr - pl, r - l) AND greatest(t - pb, pt - b) < greatest(pb - pt, b - t)) THEN 1 ELSE 0 END AS s FROM back),
 runs AS (SELECT *, CAST(sum(s) OVER (PARTITION BY doc_id, page, line ORDER BY idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS visual_line FROM flags),
 visual AS (SELECT doc_id, page, line, visual_line, min(idx) AS start, count(*) AS n, min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b FROM runs GROUP BY doc_id, page, line, visual_line)"""
)


@query(f"WITH {_VISUAL_SQL} SELECT doc_id, page, line, visual_line, start, n, l, t, r, b FROM visual")
def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visual lines of all glyphs, with bounds."""
    return placed_lines(lines(table(spark, sf_dir, "documents"))).select("doc_id", "page", "line", "visual_line", "start", "n", "l", "t", "r", "b")


@query(f"WITH {GLYPHS_SQL}, {_MARKS_SQL}, hit AS (SELECT DISTINCT g.doc_id, g.line, g.idx, g.ch FROM glyphs g JOIN marks m ON g.doc_id = m.doc_id AND g.line = m.line AND g.l + g.r BETWEEN 2 * m.l AND 2 * m.r AND g.t + g.b BETWEEN 2 * m.t AND 2 * m.b), gap AS (SELECT *, CASE WHEN idx - lag(idx) OVER (PARTITION BY doc_id, line ORDER BY idx) > 1 THEN ' ' ELSE '' END AS s FROM hit) SELECT doc_id, line, count(*) AS n, string_agg(s || ch, '' ORDER BY idx) AS text FROM gap GROUP BY doc_id, line")
def text_in_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glyphs whose centre is in any rectangle of their line, joined with a blank at gaps.

    A rectangle on a row holds glyphs that follow one another: rectangles become ranges of places
    before they meet a line, and a line's ranges are read off its text once.
    """
    first, last = (F.col("l") * 2 - WIDE) / (2 * WIDE), (F.col("r") * 2 - WIDE) / (2 * WIDE)
    row = F.floor(F.col("t") / PITCH)  # a mark is as high as a row and stands on one
    m = marks(spark, sf_dir).select("doc_id", "line", (row * ROW + F.greatest(F.ceil(first), F.lit(0))).alias("a"), (row * ROW + F.least(F.floor(last), F.lit(ROW - 1))).alias("z")).where("a <= z")
    ranges = m.groupBy("doc_id", "line").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence("a", "z"))))).alias("places"))  # places of one line, each once
    j = lines(table(spark, sf_dir, "documents")).join(ranges, ["doc_id", "line"])
    chars = F.transform("places", lambda i: F.struct(i.alias("i"), F.substring(F.col("text"), (i + 1).cast("int"), F.lit(1)).alias("ch")))
    seen = j.select("doc_id", "line", F.filter(chars, lambda c: ~c["ch"].isin("", " ")).alias("cs")).where("size(cs) > 0")
    text = F.array_join(F.expr("transform(cs, (c, k) -> concat(if(k > 0 and c.i - cs[greatest(k - 1, 0)].i > 1, ' ', ''), c.ch))"), "")
    return seen.select("doc_id", "line", F.size("cs").cast("long").alias("n"), text.alias("text"))


@query(f"WITH {_VISUAL_SQL}, {_MARKS_SQL}, c AS (SELECT m.event_id, v.doc_id, v.line, v.visual_line, 4 * greatest(v.t - m.t, m.t - v.b, 0) + greatest(v.l - m.l, m.l - v.r, 0) AS score FROM marks m JOIN visual v ON m.doc_id = v.doc_id AND m.line = v.line WHERE v.l IS NOT NULL) SELECT event_id, min(doc_id) AS doc_id, min(line) AS line, arg_min(visual_line, score * 1000000 + visual_line) AS visual_line, min(score) AS score FROM c GROUP BY event_id")
def caret_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line nearest to a point, the vertical distance counting four times; the first one wins ties."""
    m = marks(spark, sf_dir).select("event_id", "doc_id", "line", F.col("l").alias("x"), F.col("t").alias("y"))
    every = lines(table(spark, sf_dir, "documents")).join(m.select("doc_id", "line").distinct(), ["doc_id", "line"], "left_semi")
    v = placed_lines(every).where("l is not null")
    scored = m.join(v, ["doc_id", "line"]).withColumn("score", 4 * F.greatest(F.col("t") - F.col("y"), F.col("y") - F.col("b"), F.lit(0)) + F.greatest(F.col("l") - F.col("x"), F.col("x") - F.col("r"), F.lit(0)))
    best = F.min(F.struct("score", "visual_line"))
    return scored.groupBy("event_id").agg(F.min("doc_id").alias("doc_id"), F.min("line").alias("line"), best.alias("x")).select("event_id", "doc_id", "line", F.col("x.visual_line").alias("visual_line"), F.col("x.score").alias("score"))


@query(f"WITH {_MARKS_SQL}, p AS (SELECT doc_id, 100 * (doc_id % 6) AS x, 6 + 16 * (doc_id % 5) AS y, doc_id % 3 AS line FROM documents) SELECT p.doc_id, max(m.event_id) AS event_id, arg_max(m.kind, m.event_id) AS kind, count(*) AS under FROM p JOIN marks m ON p.doc_id = m.doc_id AND p.line = m.line AND p.x BETWEEN m.l AND m.r AND p.y BETWEEN m.t AND m.b GROUP BY p.doc_id")
def link_hit_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last rectangle that holds a document's point."""
    d = table(spark, sf_dir, "documents")
    p = d.select("doc_id", (100 * (F.col("doc_id") % 6)).alias("x"), (6 + 16 * (F.col("doc_id") % 5)).alias("y"), (F.col("doc_id") % 3).alias("line"))
    hit = p.join(marks(spark, sf_dir), ["doc_id", "line"]).where("x between l and r and y between t and b")
    return hit.groupBy("doc_id").agg(F.max("event_id").alias("event_id"), F.max_by("kind", "event_id").alias("kind"), F.count("*").alias("under"))


@query(f"WITH {LINES_SQL}, heads AS (SELECT doc_id, line AS at, text FROM lines WHERE line % 40 = 0 OR length(text) < 20), asked AS (SELECT event_id, user_id AS doc_id, event_id % 60 AS at FROM events) SELECT a.event_id, a.doc_id, a.at, h.at AS chapter_line, h.text AS chapter FROM asked a ASOF LEFT JOIN heads h ON a.doc_id = h.doc_id AND a.at >= h.at")
def current_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last heading at or before a line; short lines and page starts are headings."""
    heads = lines(table(spark, sf_dir, "documents")).where("line % 40 = 0 or char_length(text) < 20").select("doc_id", F.col("line").alias("at"), F.col("line").alias("chapter_line"), F.col("text").alias("chapter"))
    asked = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("doc_id"), (F.col("event_id") % 60).alias("at"))
    return as_of(asked, heads, ["doc_id"], "at", ["chapter_line"], ["chapter_line", "chapter"]).select("event_id", "doc_id", "at", "chapter_line", "chapter")


@query("SELECT a.event_id, a.doc_id, a.at, CASE WHEN s.stop > a.at THEN s.style ELSE 'default' END AS style FROM (SELECT event_id, user_id AS doc_id, event_id % 997 AS at FROM events) a ASOF LEFT JOIN (SELECT user_id AS doc_id, event_id % 991 AS at, event_id % 991 + 5 + event_id % 50 AS stop, event_type AS style FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_id % 991 ORDER BY event_id DESC) AS k FROM events) WHERE k = 1) s ON a.doc_id = s.doc_id AND a.at >= s.at")
def style_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The style span that an index is in, else the default."""
    e = table(spark, sf_dir, "events")
    at = F.col("event_id") % 991
    spans = e.select(F.col("user_id").alias("doc_id"), at.alias("at"), (at + 5 + F.col("event_id") % 50).alias("stop"), F.col("event_type").alias("style"), "event_id")
    asked = e.select("event_id", F.col("user_id").alias("doc_id"), (F.col("event_id") % 997).alias("at"))
    found = as_of(asked, spans.withColumnRenamed("event_id", "ord"), ["doc_id"], "at", ["ord"], ["stop", "style"])
    return found.select("event_id", "doc_id", "at", F.when(F.col("stop") > F.col("at"), F.col("style")).otherwise("default").alias("style"))


_CELLS = "l_orderkey * 8 + l_linenumber AS cell, l_orderkey % 50 AS sheet, l_partkey % 40 * 10 AS l, l_suppkey % 40 * 10 AS t, l_partkey % 40 * 10 + 10 AS r, l_suppkey % 40 * 10 + 10 AS b"
_FILLS = "s_suppkey AS fill, s_suppkey % 50 AS sheet, s_suppkey * 7 % 400 AS l, s_suppkey * 13 % 400 AS t, s_suppkey * 7 % 400 + 10 + s_suppkey % 9 * 10 AS r, s_suppkey * 13 % 400 + 10 + s_suppkey % 7 * 10 AS b"


def covering_fills(c: DataFrame, f: DataFrame) -> DataFrame:
    """``cell, fills, x``: how many fills cover seven tenths of a cell, and ``area`` and ``fill`` of the smallest.

    Cells at one place share the answer, equal fills count together: what meets are places and
    rectangles, however many cells and fills there are. A fill that covers so much of a place holds its centre: places
    stand in the bucket of their centre, fills in all that they touch, and both meet by sheet and bucket.
    """
    at = ["sheet", "l", "t", "r", "b"]
    f = f.groupBy("sheet", *[F.col(x).alias("f" + x) for x in "ltrb"]).agg(F.count("*").alias("many"), F.min("fill").alias("fill"))
    f = f.withColumn("column", F.explode(F.expr("sequence(fl div 40, fr div 40)"))).withColumn("row", F.explode(F.expr("sequence(ft div 40, fb div 40)")))
    places = c.select(*at).distinct().withColumn("column", F.expr("(l + r) div 80")).withColumn("row", F.expr("(t + b) div 80"))
    covered = F.expr("10 * greatest(least(r, fr) - greatest(l, fl), 0) * greatest(least(b, fb) - greatest(t, ft), 0) >= 7 * (r - l) * (b - t)")
    over = places.join(f, ["sheet", "column", "row"]).where(covered)
    best = over.groupBy(*at).agg(F.sum("many").alias("fills"), F.min(F.struct(F.expr("(fr - fl) * (fb - ft)").alias("area"), "fill")).alias("x"))
    # ``_CELLS`` has 50 sheets of 40 times 40 places: 80,000 rows at most, whatever the tables' size.
    return c.join(F.broadcast(best), at).groupBy("cell").agg(F.sum("fills").alias("fills"), F.min("x").alias("x"))


@query(f"WITH c AS (SELECT {_CELLS} FROM lineitem), f AS (SELECT {_FILLS} FROM supplier), o AS (SELECT cell, fill, (f.r - f.l) * (f.b - f.t) AS area FROM c JOIN f ON c.sheet = f.sheet AND 10 * greatest(least(c.r, f.r) - greatest(c.l, f.l), 0) * greatest(least(c.b, f.b) - greatest(c.t, f.t), 0) >= 7 * (c.r - c.l) * (c.b - c.t)) SELECT cell, count(*) AS fills, min(area) AS area, arg_min(fill, area * 1000000 + fill) AS fill FROM o GROUP BY cell")
def cell_shading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest fill that covers seven tenths of a cell; cells and fills are made from tables."""
    c, f = table(spark, sf_dir, "lineitem").selectExpr(*_CELLS.split(", ")), table(spark, sf_dir, "supplier").selectExpr(*_FILLS.split(", "))
    return covering_fills(c, f).select("cell", "fills", F.col("x.area").alias("area"), F.col("x.fill").alias("fill"))


@query(f"WITH c AS (SELECT {_CELLS} FROM lineitem), f AS (SELECT {_FILLS} FROM supplier) SELECT cell FROM c WHERE EXISTS (SELECT 1 FROM f WHERE f.sheet = c.sheet AND abs(f.t - c.t) <= 4 AND 10 * (least(c.r, f.r) - greatest(c.l, f.l)) >= 6 * (c.r - c.l))")
def edge_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells whose upper edge a rule covers by six tenths: they meet by sheet and by bands of 8 units, a rule in its own and the next ones."""
    c = table(spark, sf_dir, "lineitem").selectExpr(*_CELLS.split(", ")).withColumn("band", F.expr("t div 8"))
    f = table(spark, sf_dir, "supplier").selectExpr(*_FILLS.split(", ")).select("sheet", F.col("l").alias("fl"), F.col("t").alias("ft"), F.col("r").alias("fr")).withColumn("band", F.explode(F.expr("sequence((ft - 4) div 8, (ft + 4) div 8)")))
    near = (c.sheet == f.sheet) & (c.band == f.band) & (F.abs(f.ft - c.t) <= 4) & (10 * (F.least(c.r, f.fr) - F.greatest(c.l, f.fl)) >= 6 * (c.r - c.l))
    return c.join(f, near, "left_semi").select("cell")


@query(f"WITH {LINES_SQL}, spans AS (SELECT doc_id, page, line, length(text) - length(ltrim(text)) + CASE WHEN line % 2 = 1 THEN 100 ELSE 0 END AS l, least(length(text), 60) + CASE WHEN line % 2 = 1 THEN 100 ELSE 0 END AS r FROM lines WHERE length(trim(text)) > 0), m AS (SELECT *, max(r) OVER (PARTITION BY doc_id, page ORDER BY l, r, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans), g AS (SELECT *, sum(CASE WHEN reach IS NULL OR l > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY l, r, line ROWS UNBOUNDED PRECEDING) AS band FROM m) SELECT doc_id, page, CAST(band AS BIGINT) AS band, min(l) AS l, max(r) AS r, count(*) AS n_lines FROM g GROUP BY doc_id, page, band HAVING count(*) >= 4")
def column_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns as merged spans of lines (every other line stands in a second column), four lines at least."""
    shift = "if(line % 2 = 1, 100, 0)"
    spans = lines(table(spark, sf_dir, "documents")).where("char_length(trim(text)) > 0").selectExpr("doc_id", "page", "line", f"cast(char_length(text) - char_length(ltrim(text)) + {shift} as long) as l", f"cast(least(char_length(text), 60) + {shift} as long) as r")
    reach = F.max("r").over(Window.partitionBy("doc_id", "page").orderBy("l", "r", "line").rowsBetween(Window.unboundedPreceding, -1))
    merged = islands(spans.withColumn("reach", reach), ["doc_id", "page"], ["l", "r", "line"], F.col("reach").isNull() | (F.col("l") > F.col("reach")), "band")
    return merged.groupBy("doc_id", "page", "band").agg(F.min("l").alias("l"), F.max("r").alias("r"), F.count("*").alias("n_lines")).where("n_lines >= 4")


@query("WITH x AS (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) AS x FROM events WHERE value IS NOT NULL), f AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY user_id ORDER BY x, event_id) <= 2 THEN 0 ELSE 1 END AS s FROM x), g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY x, event_id ROWS UNBOUNDED PRECEDING) AS k FROM f) SELECT user_id, CAST(k AS BIGINT) AS stop, min(x) AS low, max(x) AS high, count(DISTINCT event_id % 7) AS n_lines FROM g GROUP BY user_id, k HAVING count(DISTINCT event_id % 7) >= 2")
def shared_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions that chain within two units, on two lines at least."""
    x = table(spark, sf_dir, "events").where("value is not null").select("user_id", "event_id", F.floor("value").alias("x"))
    step = F.col("x") - F.lag("x").over(Window.partitionBy("user_id").orderBy("x", "event_id"))
    run = islands(x.withColumn("step", step), ["user_id"], ["x", "event_id"], F.col("step").isNull() | (F.col("step") > 2), "stop")
    return run.groupBy("user_id", "stop").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count_distinct(F.col("event_id") % 7).alias("n_lines")).where("n_lines >= 2")


_PAGES_SQL = f"{LINES_SQL}, sizes AS (SELECT doc_id, page, CAST(count(*) * 16 AS BIGINT) AS height, CAST(max(length(text)) AS BIGINT) AS width FROM lines GROUP BY doc_id, page), placed AS (SELECT *, CAST(sum(height + 10) OVER (PARTITION BY doc_id ORDER BY page) AS BIGINT) - height - 10 AS top, max(width) OVER (PARTITION BY doc_id) AS widest FROM sizes)"


def placed_pages(docs: DataFrame) -> DataFrame:
    """Pages one below the other, 10 apart, centred on the widest."""
    sizes = lines(docs).groupBy("doc_id", "page").agg((F.count("*") * 16).alias("height"), F.max(F.char_length("text")).cast("long").alias("width"))
    over = Window.partitionBy("doc_id")
    top = F.sum(F.col("height") + 10).over(over.orderBy("page")) - F.col("height") - 10
    return sizes.withColumn("top", top).withColumn("widest", F.max("width").over(over))


@query(f"WITH {_PAGES_SQL} SELECT doc_id, page, top, height, width, (widest - width) // 2 AS l FROM placed")
def page_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every page of a document stands when they follow one another."""
    return placed_pages(table(spark, sf_dir, "documents")).select("doc_id", "page", "top", "height", "width", F.floor((F.col("widest") - F.col("width")) / 2).alias("l"))


@query(f"WITH {_PAGES_SQL}, v AS (SELECT user_id AS doc_id, min(event_id) % 3000 AS at FROM events GROUP BY user_id) SELECT p.doc_id, min(page) AS first_page, max(page) AS last_page, count(*) AS n_pages FROM placed p JOIN v ON p.doc_id = v.doc_id AND p.top < v.at + 800 AND p.top + p.height > v.at GROUP BY p.doc_id")
def pages_in_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that a window of 800 units shows, from where each document's events say."""
    v = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc_id")).agg((F.min("event_id") % 3000).alias("at"))
    seen = placed_pages(table(spark, sf_dir, "documents")).join(v, "doc_id").where("top < at + 800 and top + height > at")
    return seen.groupBy("doc_id").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count("*").alias("n_pages"))


@query("WITH t AS (SELECT page_id, lower(unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS tag FROM pages) SELECT page_id, tag, count(*) AS n FROM t GROUP BY page_id, tag")
def page_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of every page by name."""
    tags = F.explode(F.regexp_extract_all("html", F.lit("<([a-zA-Z][a-zA-Z0-9]*)"), 1))
    return table(spark, sf_dir, "pages").select("page_id", tags.alias("tag")).groupBy("page_id", F.lower("tag").alias("tag")).agg(F.count("*").alias("n"))


@query("WITH s AS (SELECT user_id, event_id, event_type FROM events), f AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS s FROM s), g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS span FROM f) SELECT user_id, CAST(span AS BIGINT) AS span, min(event_type) AS style, min(event_id) AS start, max(event_id) AS stop, count(*) AS n FROM g GROUP BY user_id, span")
def style_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one style (event type) in order."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    run = islands(e.withColumn("before", before), ["user_id"], ["event_id"], F.col("before").isNull() | (F.col("before") != F.col("event_type")), "span")
    return run.groupBy("user_id", "span").agg(F.min("event_type").alias("style"), F.min("event_id").alias("start"), F.max("event_id").alias("stop"), F.count("*").alias("n"))


@query("WITH o AS (SELECT event_id, user_id, event_type, event_id % 11 AS para FROM events), c AS (SELECT user_id, para, event_type AS owner, count(*) AS n, min(event_id) AS first_seen FROM o GROUP BY ALL) SELECT user_id, para, owner, n FROM c QUALIFY row_number() OVER (PARTITION BY user_id, para ORDER BY n DESC, first_seen) = 1")
def tag_dominant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The owner of most of a paragraph's parts; the first seen wins ties."""
    o = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("owner"), (F.col("event_id") % 11).alias("para"))
    c = o.groupBy("user_id", "para", "owner").agg(F.count("*").alias("n"), F.min("event_id").alias("first_seen"))
    best = F.max_by(F.struct("owner", "n"), F.struct(F.col("n"), -F.col("first_seen")))
    return c.groupBy("user_id", "para").agg(best.alias("x")).select("user_id", "para", F.col("x.owner").alias("owner"), F.col("x.n").alias("n"))
