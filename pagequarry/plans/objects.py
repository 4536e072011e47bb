"""Objects of a page and rules on them.

The tables hold no page objects, so events and lines of orders stand for them: whole numbers of a
page's thousandths, the same in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagequarry.functions import objects as o
from pagequarry.functions.geometry import rect
from pagequarry.plans.registry import query
from pagequarry.sources.views import table

#: Boxes: mostly flat or narrow ones, some large; colours and flags beside.
_BOX = {
    "l": "event_id * 37 % 900 - 20", "t": "event_id * 53 % 950 - 20",
    "r": "event_id * 37 % 900 - 20 + CASE event_id % 4 WHEN 0 THEN 1 + event_id % 6 WHEN 1 THEN 5 + event_id * 7 % 300 WHEN 2 THEN 20 + event_id % 90 ELSE event_id * 11 % 990 END",
    "b": "event_id * 53 % 950 - 20 + CASE event_id % 4 WHEN 0 THEN 5 + event_id * 3 % 200 WHEN 1 THEN 1 + event_id % 5 WHEN 2 THEN 10 + event_id % 50 ELSE event_id * 13 % 980 END",
    "rgb": "event_id * 7919 % 16777216", "filled": "event_id % 3 <> 0", "pale": "event_id % 5 = 0",
}
_BOX_SQL = "box AS (SELECT event_id, user_id AS doc_id, event_type AS kind, " + ", ".join(f"{v} AS {k}" for k, v in _BOX.items()) + " FROM events)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("doc_id"), F.col("event_type").alias("kind"), *[F.expr(v).alias(k) for k, v in _BOX.items()]).withColumn("x", rect(*map(F.col, "ltrb")))


@query("SELECT event_id, CASE WHEN w > 0 AND h > 0 THEN w ELSE 612 END AS w, CASE WHEN w > 0 AND h > 0 THEN h ELSE 792 END AS h FROM (SELECT event_id, CASE WHEN event_id % 11 > 0 THEN event_id % 700 - 30 END AS w, event_id % 900 - 20 AS h FROM events)")
def page_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of pages, a Letter page's where a side is missing or not positive."""
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 11 > 0, F.col("event_id") % 700 - 30).alias("w"), (F.col("event_id") % 900 - 20).alias("h"))
    return e.select("event_id", o.page_size(F.col("w"), F.col("h")).alias("s")).select("event_id", "s.w", "s.h")


@query("SELECT doc_id, length(s) AS n_chars, length(s) - length(replace(s, '-', '')) AS hyphens, md5(s) AS digest FROM (SELECT doc_id, replace(replace(replace(replace(text, ' de ', chr(65534) || ' '), '. ', chr(2) || chr(13)), chr(13), ''), chr(65534), '-').replace(chr(2), '-') AS s FROM documents)")
def text_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as pages give them: marks of hyphens as hyphens, no carriage returns (put in here in place of words and stops)."""
    marked = F.replace(F.replace("text", F.lit(" de "), F.lit("￾ ")), F.lit(". "), F.lit("\x02\r"))
    s = table(spark, sf_dir, "documents").select("doc_id", o.scanned_text(marked).alias("s"))
    return s.select("doc_id", F.char_length("s").cast("long").alias("n_chars"), (F.char_length("s") - F.char_length(F.replace("s", F.lit("-"), F.lit("")))).cast("long").alias("hyphens"), F.md5(F.col("s").cast("binary")).alias("digest"))


@query("SELECT event_id, CASE WHEN z <= 0 OR z > 1600 THEN 11.0 ELSE round(z, 2) END AS size, wt >= 600 OR event_id % 17 = 0 OR contains(lower(name), 'bold') AS bold FROM (SELECT event_id, wt, name, CASE WHEN abs(a * d - b * c) > 0 THEN s * sqrt(CAST(abs(a * d - b * c) AS DOUBLE)) ELSE s END AS z FROM (SELECT event_id, event_id % 900 AS wt, event_type || CASE WHEN event_id % 13 = 0 THEN '-Bold' ELSE '' END AS name, CAST(event_id % 40 AS DOUBLE) AS s, event_id % 7 AS a, event_id % 3 AS b, event_id % 2 AS c, event_id % 5 * CASE WHEN event_id % 31 = 0 THEN 9000 ELSE 1 END AS d FROM events))")
def glyph_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size under a text matrix, and boldness by weight, flag or name."""
    i = F.col("event_id")
    name = F.concat("event_type", F.when(i % 13 == 0, "-Bold").otherwise(""))
    turn = i % 7 * (i % 5 * F.when(i % 31 == 0, 9000).otherwise(1)) - i % 3 * (i % 2)
    return table(spark, sf_dir, "events").select(i, o.glyph_size((i % 40).cast("double"), turn.cast("double")).alias("size"), o.is_bold(i % 900, i % 17 == 0, name).alias("bold"))


@query(f"WITH {_BOX_SQL} SELECT event_id, CASE WHEN b - t <= 4 AND r - l >= 12 OR r - l <= 4 AND b - t >= 12 THEN 'rule' WHEN filled AND event_id % 4 <> 2 AND (pale OR (r - l) * (b - t) > 600000 OR event_id % 6 = 1) THEN 'background' WHEN filled AND event_id % 4 <> 2 THEN 'fill' ELSE 'drawing' END AS class, CASE WHEN b - t <= 4 AND r - l >= 12 THEN 'across' WHEN r - l <= 4 AND b - t >= 12 THEN 'down' END AS direction, r - l >= 4 AND b - t >= 4 AND (r - l) * (b - t) >= 800 AND (r - l) * (b - t) <= 920000 AND ((r - l) * (b - t) <= 450000 OR event_id % 40 < 25) AS worth FROM box")
def path_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths as rules, fills, backgrounds or drawings; corners that are no upright box never fill."""
    x, i = F.col("x"), F.col("event_id")
    corner = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"))
    upright = F.array(corner("l", "t"), corner("r", "t"), corner("r", "b"), corner("l", "b"))
    slanted = F.array(corner("l", "t"), F.struct((F.col("r") + 1).alias("x"), (F.col("t") + 1).alias("y")), corner("r", "b"), corner("l", "b"))
    corners = F.when(i % 4 == 2, slanted).when(i % 4 == 1, F.concat(upright, F.array(corner("l", "t")))).otherwise(upright)
    rgb = F.when(F.col("pale"), F.lit(0xFFF0F5)).otherwise(F.lit(0x20FFFF)).cast("long")
    texts = F.when(i % 6 == 1, 1).otherwise(0)
    return boxes(spark, sf_dir).select(i, o.path_class(x, F.col("filled"), o.is_box(corners), rgb, texts).alias("class"), o.rule_direction(x).alias("direction"), o.worth_drawing(x, i % 40).alias("worth"))


@query("SELECT event_id, CASE WHEN stroked AND a >= 2 THEN a / 2.0 WHEN NOT stroked AND a >= 1 THEN CAST(a AS DOUBLE) ELSE CAST(greatest(w, 0) AS DOUBLE) END AS thickness FROM (SELECT event_id, event_id % 2 = 0 AS stroked, event_id % 23 // 3 AS a, event_id % 7 - 2 AS w FROM events)")
def rule_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thickness of filled and stroked rules."""
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(i, o.rule_thickness(F.floor(i % 23 / 3), i % 2 == 0, i % 7 - 2).alias("thickness"))


@query("SELECT doc_id, substring(hex(encode(text)), 1, 8) AS magic, substring(hex(encode(text)), 1, 8) IN ('00010000', '74727565', '4F54544F', '74746366') AND strlen(text) >= 12 AS sfnt FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'OTTO' ELSE '' END || substring(text, 1, 100) AS text FROM documents)")
def font_magic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether bytes begin as a font file does."""
    data = F.concat(F.when(F.col("doc_id") % 3 == 0, "true").when(F.col("doc_id") % 3 == 1, "OTTO").otherwise(""), F.substring("text", 1, 100)).cast("binary")
    head = F.substring(F.hex(data), 1, 8)
    return table(spark, sf_dir, "documents").select("doc_id", head.alias("magic"), (head.isin(*o.SFNT) & (F.octet_length(data) >= 12)).alias("sfnt"))


@query("SELECT event_id, user_id AS doc_id, target, uri FROM (SELECT *, CASE WHEN event_id % 4 = 0 THEN event_id % 9 - 3 END AS target, CASE event_id % 5 WHEN 1 THEN trim('  ' || event_type || ' ') WHEN 2 THEN trim('   ') END AS uri FROM events) WHERE target >= 0 OR uri <> ''")
def link_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that lead to a page or hold an address; others go."""
    i = F.col("event_id")
    target = F.when(i % 4 == 0, i % 9 - 3)
    uri = F.when(i % 5 == 1, F.trim(F.concat(F.lit("  "), "event_type", F.lit(" ")))).when(i % 5 == 2, F.trim(F.lit("   ")))
    e = table(spark, sf_dir, "events").select(i, F.col("user_id").alias("doc_id"), target.alias("target"), uri.alias("uri"))
    return e.where("target >= 0 or uri <> ''")


_KIND = "['highlight', 'underline', 'strikeout', 'squiggly', 'note', 'stamp', 'widget'][event_id % 7 + 1]"


@query(f"WITH {_BOX_SQL}, k AS (SELECT *, {_KIND} AS sort FROM box) SELECT event_id, sort, sort IN ('highlight', 'underline', 'strikeout', 'squiggly') AS markup, CASE WHEN event_id % 3 = 0 THEN l ELSE l + 1 END AS l, CASE WHEN event_id % 3 = 0 THEN r + 9 ELSE r END AS r, CASE WHEN event_id % 2 = 0 THEN rgb WHEN sort = 'highlight' THEN 16776960 END AS rgb, CASE WHEN event_id % 3 = 0 THEN 100 BETWEEN l AND r AND 100 BETWEEN t AND b OR 100 BETWEEN l + 5 AND r + 9 AND 100 BETWEEN t AND b ELSE 100 BETWEEN l + 1 AND r AND 100 BETWEEN t AND b END AS hit FROM k WHERE sort NOT IN ('stamp', 'widget')")
def annotation_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations of the five kinds: bounds around the quads where there are none, colour, and whether a point is on them."""
    i, x = F.col("event_id"), F.col("x")
    sort = F.element_at(F.array(*map(F.lit, [*o.KINDS, "stamp", "widget"])), (i % 7 + 1).cast("int"))
    quads = F.when(i % 3 == 0, F.array(x, rect(F.col("l") + 5, F.col("t"), F.col("r") + 9, F.col("b")))).otherwise(F.array().cast("array<struct<l:bigint,t:bigint,r:bigint,b:bigint>>"))
    bounds = F.coalesce(o.around(quads), rect(F.col("l") + 1, F.col("t"), F.col("r"), F.col("b")))
    rgb = F.coalesce(F.when(i % 2 == 0, F.col("rgb")), F.when(sort == "highlight", F.lit(0xFFFF00).cast("long")))
    k = boxes(spark, sf_dir).withColumn("sort", sort).where(F.col("sort").isin(*o.KINDS)).withColumn("quads", quads).withColumn("bounds", bounds)
    return k.select(i, "sort", F.col("sort").isin(*o.MARKUP).alias("markup"), F.col("bounds.l").alias("l"), F.col("bounds.r").alias("r"), rgb.alias("rgb"), o.annotation_hit(F.col("bounds"), F.col("quads"), F.lit(100), F.lit(100)).alias("hit"))


@query("SELECT d.doc_id, length(regexp_replace(d.text, '\\s', '', 'g')) < 400 AND EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AND NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = d.doc_id AND e.event_type = 'error') AS scanned FROM documents d")
def scanned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of little text that have pictures (labels) and no recognised text (errors): they wait for recognition."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.char_length(F.regexp_replace("text", r"\s", "")) < 400).alias("few"))
    pictures = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("pictures", F.lit(True))
    known = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("doc_id")).distinct().withColumn("known", F.lit(True))
    both = docs.join(pictures, "doc_id", "left").join(known, "doc_id", "left")
    return both.select("doc_id", (F.col("few") & F.coalesce("pictures", F.lit(False)) & ~F.coalesce("known", F.lit(False))).alias("scanned"))


@query("SELECT event_id, CASE k WHEN 1 THEN 792 - (792 - y) WHEN 2 THEN 612 - x WHEN 3 THEN 792 - y ELSE x END AS sx, CASE k WHEN 1 THEN x WHEN 2 THEN 792 - (792 - y) WHEN 3 THEN 612 - x ELSE 792 - y END AS sy, x AS ux, y AS uy FROM (SELECT event_id, event_id % 4 AS k, event_id % 612 AS x, event_id * 7 % 792 AS y FROM events)")
def shown_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of pages as shown, under each rotation, and back again."""
    i, w, h = F.col("event_id"), F.lit(612), F.lit(792)
    e = table(spark, sf_dir, "events").select(i, o.to_shown(i % 612, i * 7 % 792, w, h, i).alias("s"))
    return e.select(i, "s.x", "s.y", o.from_shown(F.col("s.x"), F.col("s.y"), w, h, i).alias("u")).select(i, F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("u.x").alias("ux"), F.col("u.y").alias("uy"))


@query("SELECT event_id, least(greatest(CAST(w AS DOUBLE) / (p * 4 / 3.0), 0.1), 16.0) AS fit_width, least(greatest(least(CAST(w AS DOUBLE) / (p * 4 / 3.0), CAST(h AS DOUBLE) / (q * 4 / 3.0)), 0.1), 16.0) AS fit_page, CASE WHEN greatest(w, h) <= 1000 THEN w ELSE greatest(1, CAST(trunc(w * (1000.0::DOUBLE / greatest(w, h))) AS BIGINT)) END AS side, cur <= 0 OR 100 * abs(cur - w) > 3 * w AS stale, CASE WHEN w * h <= 500000 THEN w ELSE greatest(1, CAST(trunc(w * sqrt(500000.0::DOUBLE / (w * h))) AS BIGINT)) END AS area_side FROM (SELECT event_id, 1 + event_id % 2000 AS w, 1 + event_id * 3 % 1500 AS h, 300 + event_id % 500 AS p, 400 + event_id % 700 AS q, event_id * 11 % 2100 - 50 AS cur FROM events)")
def zoom_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zoom that fits a page's width or all of it, sizes within a side and an area, and stale pictures."""
    e = table(spark, sf_dir, "events").selectExpr("event_id", "1 + event_id % 2000 as w", "1 + event_id * 3 % 1500 as h", "300 + event_id % 500 as p", "400 + event_id % 700 as q", "event_id * 11 % 2100 - 50 as cur")
    within = lambda z: F.least(F.greatest(z, F.lit(0.1)), F.lit(16.0))
    across, down = F.col("w").cast("double") / (F.col("p") * 4 / F.lit(3.0)), F.col("h").cast("double") / (F.col("q") * 4 / F.lit(3.0))
    scaled = lambda by: F.greatest(F.lit(1), (F.col("w") * by).cast("long"))
    largest = F.greatest("w", "h")
    return e.select(
        "event_id", within(across).alias("fit_width"), within(F.least(across, down)).alias("fit_page"),
        F.when(largest <= 1000, F.col("w")).otherwise(scaled(F.lit(1000.0) / largest)).alias("side"),
        ((F.col("cur") <= 0) | (100 * F.abs(F.col("cur") - F.col("w")) > 3 * F.col("w"))).alias("stale"),
        F.when(F.col("w") * F.col("h") <= 500_000, F.col("w")).otherwise(scaled(F.sqrt(F.lit(500_000.0) / (F.col("w") * F.col("h"))))).alias("area_side"),
    )


@query(f"WITH {_BOX_SQL} SELECT event_id, b <= 0 OR t >= 1000 OR r <= 0 OR l >= 1000 AS off_page, NOT filled AND (r - l) * (b - t) >= 600000 AS page_scan, t + b < 220 AS in_header, t + b > 1780 AS in_footer, abs(l - 300) <= 50 AND abs(t - 300) <= 50 AND abs(r - 340) <= 50 AND abs(b - 330) <= 50 AS same_place, abs(l - 300) + abs(t - 300) + abs(r - 340) + abs(b - 330) AS distance FROM box")
def box_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes beyond the page, scans of whole pages, the bands of running heads, and nearness to a place."""
    x, at = F.col("x"), rect(*map(F.lit, (300, 300, 340, 330)))
    middle = F.col("t") + F.col("b")
    return boxes(spark, sf_dir).select("event_id", o.off_page(x).alias("off_page"), o.is_page_scan(x, F.col("filled")).alias("page_scan"), (middle < 220).alias("in_header"), (middle > 1780).alias("in_footer"), o.same_place(x, at).alias("same_place"), o.side_distance(x, at).alias("distance"))


@query("SELECT event_id, h <= greatest(3.0, g * 0.35) AND w >= greatest(6.0, g * 0.5) AND w >= 3 * h AND 100 * n >= 55 * w * h AS is_rule, 10 * h > 26 * g OR w > 9 * g OR 100 * n < 22 * w * h AND 10 * h > 13 * g AND 10 * w > 13 * g AS is_drawing FROM (SELECT event_id, 1 + event_id % 160 AS w, 1 + event_id * 3 % 47 AS h, 12 + event_id % 9 AS g, (1 + event_id % 160) * (1 + event_id * 3 % 47) * (event_id % 10 + 1) // 10 AS n FROM events)")
def ink_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks of ink that are bars, and those that are drawings."""
    w, h, g, n = (F.col(c) for c in "whgn")
    e = table(spark, sf_dir, "events").selectExpr("event_id", "1 + event_id % 160 as w", "1 + event_id * 3 % 47 as h", "12 + event_id % 9 as g", "(1 + event_id % 160) * (1 + event_id * 3 % 47) * (event_id % 10 + 1) div 10 as n")
    return e.select("event_id", o.ink_rule(w, h, n, g).alias("is_rule"), o.ink_drawing(w, h, n, g).alias("is_drawing"))


_BARS = "SELECT event_id AS bar, user_id AS doc_id, event_id * 37 % 900 AS l, event_id * 53 % 900 AS t, event_id * 37 % 900 + 10 + event_id % 60 AS r, event_id * 53 % 900 + 2 AS b FROM events WHERE event_type = 'purchase'"
_INK = "SELECT event_id AS mark, user_id AS doc_id, event_id * 41 % 900 AS l, event_id * 59 % 900 AS t, event_id * 41 % 900 + 5 + event_id % 30 AS r, event_id * 59 % 900 + 8 + event_id % 9 AS b FROM events WHERE event_type <> 'purchase'"


@query(f"WITH bars AS ({_BARS}), ink AS ({_INK}), m AS (SELECT bar, k.doc_id, k.l, k.t, k.r, k.b, x.t + x.b < k.t + k.b AS above, x.l AS xl, x.t AS xt, x.r AS xr, x.b AS xb FROM bars k JOIN ink x ON k.doc_id = x.doc_id AND x.l + x.r BETWEEN 2 * k.l - 10 AND 2 * k.r + 10 AND (x.t + x.b BETWEEN 2 * k.t - 60 AND 2 * k.t OR x.t + x.b BETWEEN 2 * k.b AND 2 * k.b + 60)), u AS (SELECT bar, doc_id, min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b, min(xl) FILTER (above) AS al, min(xt) FILTER (above) AS a_t, max(xr) FILTER (above) AS ar, max(xb) FILTER (above) AS ab, min(xl) FILTER (NOT above) AS bl, min(xt) FILTER (NOT above) AS bt, max(xr) FILTER (NOT above) AS br, max(xb) FILTER (NOT above) AS bb FROM m GROUP BY bar, doc_id) SELECT bar, doc_id, t - ab AS gap_above, bt - b AS gap_below, least(ar, r) - greatest(al, l) > 0 AND 10 * (least(ar, r) - greatest(al, l)) >= 6 * least(ar - al, r - l) AND 10 * (ar - al) <= 16 * (r - l) AND least(br, r) - greatest(bl, l) > 0 AND 10 * (least(br, r) - greatest(bl, l)) >= 6 * least(br - bl, r - l) AND 10 * (br - bl) <= 16 * (r - l) AND ab - a_t >= 2 * (b - t) AND bb - bt >= 2 * (b - t) AND t - ab <= 14 AND bt - b <= 14 AS fraction FROM u WHERE al IS NOT NULL AND bl IS NOT NULL")
def fraction_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with ink right above and below them, and whether the two make a fraction.

    Bars and ink meet by page and by cells of the sheet, 64 units wide: a bar visits the cells
    that its search box touches, ink lies in the one that holds its centre.
    """
    e = table(spark, sf_dir, "events")
    parts = lambda sql: [x.split(" AS ")[0].replace("SELECT ", "") + " as " + x.split(" AS ")[1] for x in sql.split(" FROM")[0].split(", ")]
    bars = e.where("event_type = 'purchase'").selectExpr(*parts(_BARS))
    ink = e.where("event_type <> 'purchase'").selectExpr(*parts(_INK)).select("doc_id", *[F.col(c).alias("x" + c) for c in "ltrb"], F.expr("(l + r) div 128").alias("column"), F.expr("(t + b) div 128").alias("row"))
    near = bars.withColumn("column", F.explode(F.expr("sequence((2 * l - 10) div 128, (2 * r + 10) div 128)"))).withColumn("row", F.explode(F.expr("sequence(greatest(2 * t - 60, 0) div 128, (2 * b + 60) div 128)")))
    met = near.join(ink, ["doc_id", "column", "row"]).where("xl + xr between 2 * l - 10 and 2 * r + 10 and (xt + xb between 2 * t - 60 and 2 * t or xt + xb between 2 * b and 2 * b + 60)").withColumn("above", F.expr("xt + xb < t + b"))
    of = lambda f, c, above: f(F.when(F.col("above") == above, F.col(c)))
    halves = [rect(of(F.min, "xl", a), of(F.min, "xt", a), of(F.max, "xr", a), of(F.max, "xb", a)).alias(n) for a, n in ((True, "up"), (False, "down"))]
    u = met.groupBy("bar", "doc_id", "l", "t", "r", "b").agg(*halves).where("up.l is not null and down.l is not null")
    bar, up, down = rect(*map(F.col, "ltrb")), F.col("up"), F.col("down")
    thick, gaps = F.col("b") - F.col("t"), (F.col("t") - up["b"], down["t"] - F.col("b"))
    fits = o.centred_on_bar(up, bar) & o.centred_on_bar(down, bar) & (up["b"] - up["t"] >= 2 * thick) & (down["b"] - down["t"] >= 2 * thick) & (gaps[0] <= 14) & (gaps[1] <= 14)
    return u.select("bar", "doc_id", gaps[0].alias("gap_above"), gaps[1].alias("gap_below"), fits.alias("fraction"))


@query("SELECT page_id, lower(regexp_extract(path, '\\.([^./\\\\]+)$', 1)) IN ('png', 'jpg', 'jpeg', 'bmp', 'gif', 'tif', 'tiff', 'webp', 'ico') AS is_image FROM (SELECT page_id, url || ['.PNG', '.html', '.jpeg', '', '.tar.gz', '.TIF'][page_id % 6 + 1] AS path FROM pages)")
def image_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of pictures by their ending, case aside."""
    path = F.concat("url", F.element_at(F.array(*map(F.lit, [".PNG", ".html", ".jpeg", "", ".tar.gz", ".TIF"])), (F.col("page_id") % 6 + 1).cast("int")))
    return table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1)).isin(*o.IMAGE_ENDINGS).alias("is_image"))


@query("SELECT p_partkey, EXISTS (SELECT 1 FROM part q WHERE lower(q.p_name) = upper(p.p_name).lower() AND q.p_partkey <> p.p_partkey) AS open_already FROM part p")
def open_already(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that another row has too, case aside: a semi join by folded names, never by pairs."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.lower(F.upper("p_name")).alias("key"))
    shared = p.groupBy("key").agg((F.count("*") > 1).alias("open_already"))
    return p.join(shared, "key").select("p_partkey", "open_already")


@query("SELECT event_id, (299 * r + 587 * g + 114 * b) // 1000 AS luminance, CASE WHEN greatest(r, g, b) - least(r, g, b) >= 56 THEN greatest(r, g, b) ELSE (299 * r + 587 * g + 114 * b) // 1000 END AS scan_grey, 255 - r AS dark_r FROM (SELECT event_id, event_id * 37 % 256 AS r, event_id * 11 % 256 AS g, event_id * 5 % 256 AS b FROM events)")
def pixel_greys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grey of a pixel: weighed channels, or the brightest one where it has a colour (pens fade, print stays)."""
    c = F.array(*[F.col("event_id") * k % 256 for k in (37, 11, 5)])
    grey = F.floor((299 * c[0] + 587 * c[1] + 114 * c[2]) / 1000)
    coloured = F.array_max(c) - F.array_min(c) >= 56
    return table(spark, sf_dir, "events").select("event_id", grey.alias("luminance"), F.when(coloured, F.array_max(c)).otherwise(grey).alias("scan_grey"), (255 - c[0]).alias("dark_r"))


@query(f"WITH {_BOX_SQL}, c AS (SELECT event_id AS glyph, doc_id, l + r AS x, t + b AS y FROM box WHERE event_id % 4 = 2) SELECT k.event_id, least(count(c.glyph), 25) AS texts FROM box k LEFT JOIN c ON c.doc_id = k.doc_id AND c.x BETWEEN 2 * k.l AND 2 * k.r AND c.y BETWEEN 2 * k.t AND 2 * k.b WHERE k.event_id % 4 = 3 GROUP BY k.event_id")
def texts_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many centres of text a region holds, 25 at most (the feature's stop); regions meet texts by cells of 128 units."""
    every = boxes(spark, sf_dir)
    texts = every.where("event_id % 4 = 2").select("doc_id", F.expr("l + r").alias("cx"), F.expr("t + b").alias("cy"), F.expr("floor((l + r) / 256)").alias("column"), F.expr("floor((t + b) / 256)").alias("row"))
    regions = every.where("event_id % 4 = 3").select("event_id", "doc_id", "l", "t", "r", "b")
    cells = regions.where("r >= l and b >= t").withColumn("column", F.explode(F.expr("sequence(floor(l / 128), floor(r / 128))"))).withColumn("row", F.explode(F.expr("sequence(floor(t / 128), floor(b / 128))")))
    held = cells.join(texts, ["doc_id", "column", "row"]).where("cx between 2 * l and 2 * r and cy between 2 * t and 2 * b").groupBy("event_id").agg(F.count("*").alias("n"))
    return regions.select("event_id").join(held, "event_id", "left").select("event_id", F.least(F.coalesce("n", F.lit(0)), F.lit(25)).cast("long").alias("texts"))
