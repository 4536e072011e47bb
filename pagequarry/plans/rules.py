"""Scalar rules and text structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagequarry.functions import geometry as g
from pagequarry.functions.text import file_size, heading_key
from pagequarry.operators.paragraphs import BULLET, MAYBE_BULLET, NUMBER, list_kind
from pagequarry.plans.registry import query
from pagequarry.sources.views import LINES_SQL, lines, table

#: Zoom stops (per cent), border widths in eighths of a point, link schemes.
ZOOM_STOPS = [10, 25, 33, 50, 67, 75, 80, 90, 100, 110, 125, 150, 175, 200, 250, 300, 400, 500, 600, 800, 1000, 1200, 1600]
BORDER_WIDTHS = [2, 4, 6, 8, 12, 18, 24, 36, 48]
SCHEMES = ["http", "https", "mailto"]

_A = "event_id % 50 AS al, event_id % 40 AS ao, event_id % 50 + event_id % 7 AS ar, event_id % 40 + event_id % 5 AS ab, event_id % 45 AS bl, event_id % 35 AS bt, event_id % 45 + event_id % 11 AS br, event_id % 35 + event_id % 13 AS bb"


@query(f"SELECT event_id, ar <= al OR ab <= ao AS is_empty, ar > al AND ab > ao AND br > bl AND bb > bt AND al < br AND bl < ar AND ao < bb AND bt < ab AS meets, CASE WHEN ar <= al OR ab <= ao THEN bl WHEN br <= bl OR bb <= bt THEN al ELSE least(al, bl) END AS ul, CASE WHEN ar <= al OR ab <= ao THEN bb WHEN br <= bl OR bb <= bt THEN ab ELSE greatest(ab, bb) END AS ub, greatest(al - 30, 30 - ar, 0) * greatest(al - 30, 30 - ar, 0) + greatest(ao - 20, 20 - ab, 0) * greatest(ao - 20, 20 - ab, 0) AS distance2, CASE event_id % 4 WHEN 1 THEN 100 - ab WHEN 2 THEN 100 - ar WHEN 3 THEN ao ELSE al END AS turned_l FROM (SELECT event_id, {_A} FROM events)")
def rect_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emptiness, meeting, union, distance and rotation of rectangles made from events."""
    e = table(spark, sf_dir, "events").selectExpr("event_id", *_A.split(", "))
    pair = e.select("event_id", g.rect(e.al, e.ao, e.ar, e.ab).alias("a"), g.rect(e.bl, e.bt, e.br, e.bb).alias("b"))
    x, y, u = F.col("a"), F.col("b"), g.union(F.col("a"), F.col("b"))
    return pair.select("event_id", g.is_empty(x).alias("is_empty"), g.intersects(x, y).alias("meets"), u["l"].alias("ul"), u["b"].alias("ub"), g.distance2(x, F.lit(30), F.lit(20)).alias("distance2"), g.rotated(x, F.col("event_id"), F.lit(100), F.lit(100))["l"].alias("turned_l"))


_STOPS = ", ".join(map(str, ZOOM_STOPS))


@query(f"SELECT event_id, zoom, coalesce(list_min(list_filter([{_STOPS}], lambda s: 1000 * s > 1001 * zoom)), 1600) AS zoom_in, coalesce(list_max(list_filter([{_STOPS}], lambda s: 1000 * s < 999 * zoom)), 10) AS zoom_out, least(greatest(zoom, 10), 1600) AS clamped FROM (SELECT event_id, event_id % 1800 AS zoom FROM events)")
def zoom_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stops above and below a zoom."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 1800).alias("zoom"))
    stops = f"array({_STOPS})"
    return e.selectExpr("event_id", "zoom", f"coalesce(array_min(filter({stops}, s -> 1000 * s > 1001 * zoom)), 1600) as zoom_in", f"coalesce(array_max(filter({stops}, s -> 1000 * s < 999 * zoom)), 10) as zoom_out", "least(greatest(zoom, 10), 1600) as clamped")


@query("SELECT event_id, list_min([" + ", ".join(f"{{'d': abs({s} - event_id % 60), 's': {s}}}" for s in BORDER_WIDTHS) + "]).s AS width FROM events")
def border_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest legal width; the first wins ties."""
    options = F.array(*[F.struct(F.abs(F.lit(s) - F.col("event_id") % 60).alias("d"), F.lit(s).alias("s")) for s in BORDER_WIDTHS])
    return table(spark, sf_dir, "events").select("event_id", F.array_min(options)["s"].alias("width"))


@query("SELECT page_id, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1) IN ('http', 'https', 'mailto') AS allowed, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages")
def uri_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a link's scheme is allowed, and its host."""
    scheme = F.regexp_extract("url", "^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)
    return table(spark, sf_dir, "pages").select("page_id", scheme.isin(*SCHEMES).alias("allowed"), F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"))


@query("SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN (n // 1024) || ' KB' ELSE (n // 1048576) || ' MB' END AS size FROM (SELECT doc_id, strlen(text) AS n FROM documents)")
def size_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of texts in bytes, as people read them."""
    return table(spark, sf_dir, "documents").select("doc_id", file_size(F.octet_length("text")).alias("size"))


@query("SELECT event_id, json_valid(props) AS valid, json_keys(props)[1] AS first_key FROM events")
def json_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored JSON, read leniently: broken text is null, not an error."""
    keys = F.json_object_keys("props")
    return table(spark, sf_dir, "events").select("event_id", keys.isNotNull().alias("valid"), keys[0].alias("first_key"))


@query(f"WITH {LINES_SQL}, k AS (SELECT doc_id, line, CASE WHEN regexp_matches(text, '{BULLET}') THEN 'bullet' WHEN regexp_matches(text, '{MAYBE_BULLET}') THEN 'maybe' WHEN regexp_matches(text, '{NUMBER}') THEN 'number' ELSE 'text' END AS kind FROM lines), n AS (SELECT *, lag(kind) OVER w AS p, lead(kind) OVER w AS q FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY line)) SELECT doc_id, line, kind, coalesce(kind = p OR kind = q, kind = p, kind = q, false) AS corroborated FROM n WHERE kind <> 'text'")
def list_corroborated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a list marker, and whether a neighbour has the same kind."""
    over = Window.partitionBy("doc_id").orderBy("line")
    k = lines(table(spark, sf_dir, "documents")).select("doc_id", "line", list_kind(F.col("text")).alias("kind"))
    n = k.select("*", F.lag("kind").over(over).alias("p"), F.lead("kind").over(over).alias("q"))
    same = F.coalesce((F.col("kind") == F.col("p")) | (F.col("kind") == F.col("q")), F.col("kind") == F.col("p"), F.col("kind") == F.col("q"), F.lit(False))
    return n.where("kind <> 'text'").select("doc_id", "line", "kind", same.alias("corroborated"))


@query(f"WITH {LINES_SQL} SELECT doc_id, line, lower(regexp_replace(text, '[^\\p{{L}}\\p{{Nd}}]', '', 'g')) AS key, length(text) < 40 AND NOT ends_with(text, ',') AS short FROM lines WHERE length(text) BETWEEN 1 AND 200")
def heading_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that headings are compared by."""
    text = F.col("text")
    return lines(table(spark, sf_dir, "documents")).where(F.char_length(text).between(1, 200)).select("doc_id", "line", heading_key(text).alias("key"), ((F.char_length(text) < 40) & ~F.endswith(text, F.lit(","))).alias("short"))


@query(f"WITH {LINES_SQL}, n AS (SELECT doc_id, line, text, lead(text) OVER (PARTITION BY doc_id ORDER BY line) AS next FROM lines), f AS (SELECT *, CASE WHEN lag(text) OVER (PARTITION BY doc_id ORDER BY line) IS NULL OR regexp_matches(lag(text) OVER (PARTITION BY doc_id ORDER BY line), '[.!?:]$') OR regexp_matches(text, '^\\s*$') THEN 1 ELSE 0 END AS s FROM n), g AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS para FROM f) SELECT doc_id, CAST(para AS BIGINT) AS para, min(line) AS first_line, count(*) AS n_lines, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM g GROUP BY doc_id, para")
def flowed_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines joined into paragraphs: one ends where a line ends a sentence or the next is blank."""
    over = Window.partitionBy("doc_id").orderBy("line")
    before = F.lag("text").over(over)
    starts = before.isNull() | before.rlike("[.!?:]$") | F.col("text").rlike(r"^\s*$")
    f = lines(table(spark, sf_dir, "documents")).withColumn("s", starts.cast("int"))
    grouped = f.withColumn("para", F.sum("s").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy("doc_id", "para").agg(F.min("line").alias("first_line"), F.count("*").alias("n_lines"), F.sum(F.char_length("text")).cast("long").alias("n_chars"))


@query(f"WITH {LINES_SQL}, p AS (SELECT doc_id, page, count(*) AS n FROM lines GROUP BY doc_id, page), q AS (SELECT *, lag(n) OVER (PARTITION BY doc_id ORDER BY page) AS before FROM p) SELECT doc_id, page, before IS NOT NULL AND 100 * (40 - before) >= 22 * 40 AS page_break FROM q")
def page_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that begin anew since the page before leaves 22 % free."""
    p = lines(table(spark, sf_dir, "documents")).groupBy("doc_id", "page").agg(F.count("*").alias("n"))
    before = F.lag("n").over(Window.partitionBy("doc_id").orderBy("page"))
    return p.withColumn("before", before).select("doc_id", "page", (F.col("before").isNotNull() & F.coalesce(100 * (40 - F.col("before")) >= 22 * 40, F.lit(False))).alias("page_break"))


@query("SELECT event_id, strftime(ts, 'D:%Y%m%d%H%M%S') AS stamp, year(ts) AS y, month(ts) AS m, day(ts) AS d, hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS s FROM events")
def stamp_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time stamps written in the document form and read back from it."""
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("D:"), F.date_format("ts", "yyyyMMddHHmmss")).alias("stamp"))
    part = lambda a, n: F.substring("stamp", a, n).cast("long")
    return e.select("event_id", "stamp", part(3, 4).alias("y"), part(7, 2).alias("m"), part(9, 2).alias("d"), (part(11, 2) * 3600 + part(13, 2) * 60 + part(15, 2)).alias("s"))


@query("SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice / 7 * 20) AS BIGINT) AS twips, round(l_quantity * 2) / 2 AS size_key, CAST(least(greatest(round_even(l_quantity / 3 * 2, 0), 2), 3276) AS BIGINT) AS half_points FROM lineitem")
def rounding_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twips (half away from zero), size keys and half-points (half to even)."""
    p, q = F.col("l_extendedprice"), F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(p / 7 * 20).cast("long").alias("twips"), (F.round(q * 2) / 2).alias("size_key"), F.least(F.greatest(F.bround(q / 3 * 2), F.lit(2)), F.lit(3276)).cast("long").alias("half_points"))
