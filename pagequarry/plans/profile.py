"""Profiles and the parts of a page's composition around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagequarry.functions.stats import ranked_groups
from pagequarry.operators.shapes import as_of, islands
from pagequarry.plans.composition import _ROWS_SQL, WIDTH, composed
from pagequarry.plans.layout import _CELLS, _FILLS, _PAGES_SQL, covering_fills, placed_pages
from pagequarry.plans.registry import query
from pagequarry.sources.views import LINES_SQL, lines, table


@query("WITH b AS (SELECT user_id AS page, event_id, event_id * 37 % 900 AS l, event_id * 37 % 900 + 50 + event_id % 200 AS r, event_id * 16 AS t, event_id * 16 + 4 + event_id % 9 AS b FROM events), g AS (SELECT *, CASE WHEN least(r, lag(r) OVER w) > greatest(l, lag(l) OVER w) AND t > lag(b) OVER w THEN t - lag(b) OVER w END AS gap FROM b WINDOW w AS (PARTITION BY page ORDER BY event_id)) SELECT page, count(gap) AS n, list_sort(list(gap) FILTER (gap IS NOT NULL))[(count(gap) - 1) // 2 + 1] AS gap FROM g GROUP BY page HAVING count(gap) > 0")
def stacked_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lower median of gaps over 0 between blocks that stand below each other."""
    over = Window.partitionBy("page").orderBy("event_id")
    b = table(spark, sf_dir, "events").selectExpr("user_id as page", "event_id", "event_id * 37 % 900 as l", "event_id * 37 % 900 + 50 + event_id % 200 as r", "event_id * 16 as t", "event_id * 16 + 4 + event_id % 9 as b")
    shared = F.least("r", F.lag("r").over(over)) > F.greatest("l", F.lag("l").over(over))
    away = F.col("t") - F.lag("b").over(over)
    g = b.select("page", F.when(shared & (away > 0), away).alias("gap")).where("gap is not null")
    return g.groupBy("page").agg(F.count("*").alias("n")).join(ranked_groups(g, ["page"], "gap", {"gap": F.floor((F.col("n") - 1) / 2)}), "page")


@query("WITH h AS (SELECT event_type AS scan, CAST(floor(value) AS BIGINT) % 256 AS g, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY scan ORDER BY g) AS upto, sum(n) OVER (PARTITION BY scan) AS every FROM h) SELECT scan, min(g) FILTER (100 * upto >= 1 * every) AS p1, min(g) FILTER (100 * upto >= 50 * every) AS p50, min(g) FILTER (100 * upto >= 99 * every) AS p99, CAST(min(every) AS BIGINT) AS pixels FROM c GROUP BY scan")
def grey_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greys below which a share of a scan's pixels lies, off a histogram of 256."""
    h = table(spark, sf_dir, "events").where("value is not null").groupBy(F.col("event_type").alias("scan"), (F.floor("value") % 256).alias("g")).agg(F.count("*").alias("n"))
    over = Window.partitionBy("scan")
    c = h.withColumn("upto", F.sum("n").over(over.orderBy("g"))).withColumn("every", F.sum("n").over(over))
    at = lambda share: F.min(F.when(100 * F.col("upto") >= share * F.col("every"), F.col("g")))
    return c.groupBy("scan").agg(at(1).alias("p1"), at(50).alias("p50"), at(99).alias("p99"), F.min("every").alias("pixels"))


@query(f"WITH {LINES_SQL}, w AS (SELECT doc_id, lower(substring(ltrim(text), 1, 1)) AS family, sum(length(text)) AS w, min(line) AS first FROM lines WHERE text <> '' GROUP BY ALL) SELECT doc_id, family, CAST(w AS BIGINT) AS weight FROM w QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, first) = 1")
def body_font(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The face that most characters of a document have (a line's first letter stands for it); the first seen wins ties."""
    w = lines(table(spark, sf_dir, "documents")).where("text <> ''").groupBy("doc_id", F.lower(F.substring(F.ltrim("text"), 1, 1)).alias("family")).agg(F.sum(F.char_length("text")).alias("w"), F.min("line").alias("first"))
    return w.groupBy("doc_id").agg(F.max_by(F.struct("family", "w"), F.struct(F.col("w"), -F.col("first"))).alias("x")).select("doc_id", F.col("x.family").alias("family"), F.col("x.w").alias("weight"))


_SIDES = "SELECT user_id AS doc, event_id, 40 + event_id % 37 AS l, 500 + event_id % 80 AS r, 50 + event_id % 29 AS t, 600 + event_id % 170 AS b FROM events"


@query(f"WITH p AS ({_SIDES}), m AS (SELECT doc, list_sort(list(l))[count(*) // 2 + 1] AS lm, list_sort(list(t))[CAST(round_even((count(*) - 1) * 0.2, 0) AS BIGINT) + 1] AS tm, 612 - list_sort(list(r))[CAST(round_even((count(*) - 1) * 0.85, 0) AS BIGINT) + 1] AS rm, 792 - list_sort(list(b))[CAST(round_even((count(*) - 1) * 0.85, 0) AS BIGINT) + 1] AS bm FROM p GROUP BY doc) SELECT doc, least(greatest(lm, 18), 214) AS l, least(greatest(tm, 18), 277) AS t, least(greatest(least(rm, lm), 18), 214) AS r, least(greatest(least(bm, tm), 18), 277) AS b FROM m")
def text_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four margins: left by the middle page, top by a low one, right and bottom by a full one but no wider than those facing them."""
    p = table(spark, sf_dir, "events").selectExpr("user_id as doc", "40 + event_id % 37 as l", "500 + event_id % 80 as r", "50 + event_id % 29 as t", "600 + event_id % 170 as b")
    at = lambda c, rank: ranked_groups(p, ["doc"], c, {c: rank})
    n = F.col("n")
    m = at("l", F.floor(n / 2)).join(at("t", F.bround((n - 1) * 0.2)), "doc").join(at("r", F.bround((n - 1) * 0.85)), "doc").join(at("b", F.bround((n - 1) * 0.85)), "doc")
    within = lambda c, most: F.least(F.greatest(c, F.lit(18)), F.lit(most)).cast("long")
    return m.select("doc", within(F.col("l"), 214).alias("l"), within(F.col("t"), 277).alias("t"), within(F.least(612 - F.col("r"), F.col("l")), 214).alias("r"), within(F.least(792 - F.col("b"), F.col("t")), 277).alias("b"))


@query("WITH s AS (SELECT user_id AS doc, event_id % 12 + 8 AS size, count(*) AS w FROM events GROUP BY ALL), b AS (SELECT doc, size AS body FROM s QUALIFY row_number() OVER (PARTITION BY doc ORDER BY w DESC, size) = 1), k AS (SELECT s.doc, size, row_number() OVER (PARTITION BY s.doc ORDER BY size DESC) AS level FROM s JOIN b USING (doc) WHERE 100 * size >= 112 * body AND size <= 6 * body) SELECT doc, size, level FROM k WHERE level <= 4")
def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four largest sizes from 1.12 to 6 times that of the body, which most characters have; the smaller wins ties."""
    s = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc"), (F.col("event_id") % 12 + 8).alias("size")).agg(F.count("*").alias("w"))
    over = Window.partitionBy("doc")
    b = s.withColumn("body", F.max(F.struct("w", -F.col("size"))).over(over)).withColumn("body", -F.col("body.col2")).where("100 * size >= 112 * body and size <= 6 * body")
    return b.withColumn("level", F.row_number().over(over.orderBy(F.desc("size"))).cast("long")).where("level <= 4").select("doc", "size", "level")


@query("WITH g AS (SELECT user_id AS doc, event_id // 40 AS line, event_type AS style, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY doc, line) AS every, sum(CASE WHEN style IN ('click', 'view') THEN n ELSE 0 END) OVER (PARTITION BY doc, line) AS bold, sum(CASE WHEN style = 'click' THEN n ELSE 0 END) OVER (PARTITION BY doc, line) AS mono FROM g) SELECT doc, line, style, 10 * bold >= 8 * every AS all_bold, 10 * mono >= 9 * every AS monospace FROM t QUALIFY row_number() OVER (PARTITION BY doc, line ORDER BY n DESC, first) = 1")
def line_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line's commonest style, whether eight tenths of it are bold, and whether nine are monospaced."""
    g = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc"), F.floor(F.col("event_id") / 40).alias("line"), F.col("event_type").alias("style")).agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
    share = lambda *names: F.sum(F.when(F.col("style").isin(*names), F.col("n")).otherwise(0))
    best = F.max_by("style", F.struct(F.col("n"), -F.col("first")))
    return g.groupBy("doc", "line").agg(best.alias("style"), (10 * share("click", "view") >= 8 * F.sum("n")).alias("all_bold"), (10 * share("click") >= 9 * F.sum("n")).alias("monospace"))


@query("SELECT user_id AS job, event_id, CAST(floor(100 * count(*) OVER w / count(*) OVER (PARTITION BY user_id)) AS BIGINT) AS percent FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a job is done after each of its steps, in percent."""
    over = Window.partitionBy("user_id")
    done = F.count("*").over(over.orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), "event_id", F.floor(100 * done / F.count("*").over(over)).alias("percent"))


@query(f"WITH {LINES_SQL}, c AS (SELECT doc_id, line, substring(text, 31, 40) AS cut FROM lines WHERE line % 40 BETWEEN 3 AND 9) SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, string_agg(cut, chr(10) ORDER BY line) AS text FROM c WHERE trim(cut) <> '' GROUP BY doc_id")
def region_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of one region of every page: rows 3 to 9, letters 31 to 70."""
    c = lines(table(spark, sf_dir, "documents")).where("line % 40 between 3 and 9").select("doc_id", "line", F.substring("text", 31, 40).alias("cut")).where("trim(cut) <> ''")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "cut"))), lambda x: x["cut"]), "\n")
    return c.groupBy("doc_id").agg(F.count("*").alias("n_lines"), text.alias("text"))


_SPANS = "if(line % 2 = 1, 480, 0)"


@query(f"""WITH {LINES_SQL}, s AS (SELECT doc_id, page, line, CASE WHEN line % 2 = 1 THEN 480 ELSE 0 END AS l, CASE WHEN line % 2 = 1 THEN 480 ELSE 0 END + least(length(text), 44) * 10 AS r FROM lines WHERE trim(text) <> ''),
 w AS (SELECT * FROM s WHERE 100 * (r - l) < 62 * 920 AND line % 5 <> 4), n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page) AS narrow, max(r) OVER (PARTITION BY doc_id, page ORDER BY l, r, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w),
 g AS (SELECT *, sum(CASE WHEN reach IS NULL OR l - reach >= 20 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY l, r, line ROWS UNBOUNDED PRECEDING) AS band FROM n WHERE narrow >= 8),
 b AS (SELECT doc_id, page, band, min(l) AS l, max(r) AS r, count(*) AS members FROM g GROUP BY doc_id, page, band), k AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page) AS bands, min(members) OVER (PARTITION BY doc_id, page) AS least_members FROM b)
 SELECT doc_id, page, CAST(band AS BIGINT) AS band, l, r, members FROM k WHERE bands >= 2 AND least_members >= 4""")
def column_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of a page by all their limits: narrow lines, eight of them, gaps of 1.6 glyphs, two columns, four lines in each."""
    s = lines(table(spark, sf_dir, "documents")).where("trim(text) <> ''").selectExpr("doc_id", "page", "line", f"cast({_SPANS} as long) as l", f"cast({_SPANS} + least(char_length(text), 44) * 10 as long) as r")
    page, order = Window.partitionBy("doc_id", "page"), ["l", "r", "line"]
    w = s.where("100 * (r - l) < 62 * 920 and line % 5 <> 4").withColumn("narrow", F.count("*").over(page)).withColumn("reach", F.max("r").over(page.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))).where("narrow >= 8")
    g = islands(w, ["doc_id", "page"], order, F.col("reach").isNull() | (F.col("l") - F.col("reach") >= 20), "band")
    b = g.groupBy("doc_id", "page", "band").agg(F.min("l").alias("l"), F.max("r").alias("r"), F.count("*").alias("members"))
    k = b.withColumn("bands", F.count("*").over(page)).withColumn("least", F.min("members").over(page))
    return k.where("bands >= 2 and least >= 4").select("doc_id", "page", "band", "l", "r", "members")


@query(f"""WITH RECURSIVE {_ROWS_SQL}, q AS (SELECT doc_id, page, para, arg_min(l, n) AS first_l, min(l) FILTER (n > start) AS rest_l, max(r) AS r, count(*) AS k, bool_or(parted) AS parted, max(t) - min(t) AS tall, arg_min(hang, n) AS hang FROM (SELECT *, min(n) OVER (PARTITION BY doc_id, page, para) AS start FROM para) GROUP BY doc_id, page, para)
 SELECT doc_id, page, CAST(para AS BIGINT) AS para, coalesce(rest_l, first_l) * 20 AS indent, (first_l - coalesce(rest_l, first_l)) * 20 AS first_line, CASE WHEN k > 1 THEN ({WIDTH} - r) * 20 ELSE 0 END AS right_indent, coalesce(rest_l > first_l, false) AS hanging, CASE WHEN k > 1 THEN CAST(round(tall * 20.0 / (k - 1)) AS BIGINT) ELSE 0 END AS line_rule FROM q""")
def paragraph_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How paragraphs are written: indents of the block and of the first line, hanging, and the pitch of lines, in twips."""
    of = lambda c, f, xs="lines": f(F.transform(xs, lambda x: x[c]))
    rest = F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0)))
    q = composed(table(spark, sf_dir, "documents")).select("doc_id", "page", "para", F.col("lines")[0]["l"].cast("long").alias("first_l"), of("l", F.array_min, rest).cast("long").alias("rest_l"), of("r", F.array_max).cast("long").alias("r"), F.size("lines").alias("k"), (of("t", F.array_max) - of("t", F.array_min)).alias("tall"))
    block = F.coalesce("rest_l", "first_l")
    many = F.col("k") > 1
    return q.select("doc_id", "page", "para", (block * 20).alias("indent"), ((F.col("first_l") - block) * 20).alias("first_line"), F.when(many, (WIDTH - F.col("r")) * 20).otherwise(0).alias("right_indent"), F.coalesce(F.col("rest_l") > F.col("first_l"), F.lit(False)).alias("hanging"), F.when(many, F.round(F.col("tall") * 20.0 / (F.col("k") - 1)).cast("long")).otherwise(0).alias("line_rule"))


_INK = "SELECT user_id AS page, event_id, 1 + event_id * 7 % 190 AS w, 1 + event_id * 3 % 47 AS h, (1 + event_id * 7 % 190) * (1 + event_id * 3 % 47) * (event_id % 10 + 1) // 10 AS n FROM events"


@query(f"WITH k AS ({_INK}), g AS (SELECT page, greatest(list_sort(list(h) FILTER (h >= 8))[count(*) FILTER (h >= 8) // 2 + 1], 4) AS glyph FROM k GROUP BY page), c AS (SELECT k.page, glyph, h <= greatest(3.0, glyph * 0.35) AND w >= greatest(6.0, glyph * 0.5) AND w >= 3 * h AND 100 * n >= 55 * w * h AS is_rule, 10 * h > 26 * glyph OR w > 9 * glyph OR 100 * n < 22 * w * h AND 10 * h > 13 * glyph AND 10 * w > 13 * glyph AS is_drawing FROM k JOIN g USING (page)) SELECT page, min(glyph) AS glyph, count(*) FILTER (is_rule) AS rules, count(*) FILTER (is_drawing AND NOT is_rule) AS drawings, count(*) FILTER (NOT is_rule AND NOT is_drawing) AS glyphs FROM c GROUP BY page")
def page_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scanned page's marks as glyphs, rules and drawings, by the height of its usual glyph."""
    from pagequarry.functions.objects import ink_drawing, ink_rule

    k = table(spark, sf_dir, "events").selectExpr("user_id as page", "1 + event_id * 7 % 190 as w", "1 + event_id * 3 % 47 as h", "(1 + event_id * 7 % 190) * (1 + event_id * 3 % 47) * (event_id % 10 + 1) div 10 as n")
    g = ranked_groups(k.where("h >= 8"), ["page"], "h", {"glyph": F.floor(F.col("n") / 2)}).withColumn("glyph", F.greatest("glyph", F.lit(4)))
    w, h, n, glyph = (F.col(c) for c in ("w", "h", "n", "glyph"))
    c = k.join(g, "page").select("page", "glyph", ink_rule(w, h, n, glyph).alias("rule"), ink_drawing(w, h, n, glyph).alias("drawing"))
    return c.groupBy("page").agg(F.min("glyph").alias("glyph"), F.count_if("rule").alias("rules"), F.count_if(F.expr("drawing and not rule")).alias("drawings"), F.count_if(F.expr("not rule and not drawing")).alias("glyphs"))


@query(f"WITH {LINES_SQL}, s AS (SELECT doc_id, line, sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY line) - length(text) - 1 AS start FROM lines), a AS (SELECT event_id, user_id AS doc_id, event_id * 7 % 3000 AS place FROM events) SELECT a.event_id, a.doc_id, place, CAST(s.line AS BIGINT) AS line, CAST(place - s.start AS BIGINT) AS col FROM a ASOF JOIN (SELECT doc_id, line, CAST(start AS BIGINT) AS start FROM s) s ON a.doc_id = s.doc_id AND a.place >= s.start")
def index_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line that a place in a document's text is on: the last one that starts at or before it."""
    n = F.char_length("text") + 1
    start = F.sum(n).over(Window.partitionBy("doc_id").orderBy("line")) - n
    s = lines(table(spark, sf_dir, "documents")).select("doc_id", start.cast("long").alias("at"), "line", start.cast("long").alias("start"))
    a = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("doc_id"), (F.col("event_id") * 7 % 3000).alias("at"))
    return as_of(a, s, ["doc_id"], "at", ["line"], ["line", "start"]).where("line is not null").select("event_id", "doc_id", F.col("at").alias("place"), "line", (F.col("at") - F.col("start")).alias("col"))


@query(f"WITH c AS (SELECT {_CELLS} FROM lineitem), f AS (SELECT *, fill % 4 = 0 AS white FROM (SELECT {_FILLS} FROM supplier)), t AS (SELECT sheet, (max(r) - min(l)) * (max(b) - min(t)) AS area FROM c GROUP BY sheet), o AS (SELECT cell, fill, white, (f.r - f.l) * (f.b - f.t) AS area FROM c JOIN f ON c.sheet = f.sheet AND 10 * greatest(least(c.r, f.r) - greatest(c.l, f.l), 0) * greatest(least(c.b, f.b) - greatest(c.t, f.t), 0) >= 7 * (c.r - c.l) * (c.b - c.t) JOIN t ON t.sheet = c.sheet WHERE 100 * (f.r - f.l) * (f.b - f.t) <= 75 * t.area) SELECT cell, CASE WHEN NOT arg_min(white, area * 1000000 + fill) THEN arg_min(fill, area * 1000000 + fill) END AS shading FROM o GROUP BY cell")
def cell_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cell's shading: the smallest fill over seven tenths of it that is no background of the table; white is none."""
    c = table(spark, sf_dir, "lineitem").selectExpr(*_CELLS.split(", "))
    t = c.groupBy("sheet").agg(((F.max("r") - F.min("l")) * (F.max("b") - F.min("t"))).alias("whole"))
    f = table(spark, sf_dir, "supplier").selectExpr(*_FILLS.split(", ")).join(t, "sheet").where("100 * (r - l) * (b - t) <= 75 * whole")
    best = covering_fills(c, f)
    return best.select("cell", F.when(F.col("x.fill") % 4 != 0, F.col("x.fill")).alias("shading"))


@query(f"WITH {LINES_SQL}, n AS (SELECT doc_id, page, CAST(sum(length(text) + 1) - 1 AS BIGINT) AS n FROM lines GROUP BY ALL), s AS (SELECT user_id AS doc_id, min(event_id) % 3 AS p0, min(event_id) * 7 % 500 AS c0, min(event_id) % 3 + count(*) % 3 AS p1, count(*) * 11 % 700 AS c1 FROM events GROUP BY user_id) SELECT n.doc_id, n.page, CASE WHEN n.page = p0 THEN least(c0, n) ELSE 0 END AS start, CASE WHEN n.page = p1 THEN least(c1, n) ELSE n END AS stop FROM n JOIN s ON s.doc_id = n.doc_id AND n.page BETWEEN p0 AND p1 WHERE CASE WHEN n.page = p0 THEN least(c0, n) ELSE 0 END < CASE WHEN n.page = p1 THEN least(c1, n) ELSE n END")
def selection_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a selection from one place to another takes of every page between."""
    n = lines(table(spark, sf_dir, "documents")).groupBy("doc_id", "page").agg((F.sum(F.char_length("text") + 1) - 1).alias("n"))
    i = F.min("event_id")
    s = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc_id")).agg((i % 3).alias("p0"), (i * 7 % 500).alias("c0"), (i % 3 + F.count("*") % 3).alias("p1"), (F.count("*") * 11 % 700).alias("c1"))
    j = n.join(s, "doc_id").where("page between p0 and p1")
    start = F.when(F.col("page") == F.col("p0"), F.least("c0", "n")).otherwise(0)
    stop = F.when(F.col("page") == F.col("p1"), F.least("c1", "n")).otherwise(F.col("n"))
    return j.select("doc_id", "page", start.alias("start"), stop.alias("stop")).where("start < stop")


@query("WITH c AS (SELECT user_id AS page, event_id AS idx, event_id % 6 = 5 AS generated, event_id % 11 < 7 AS visible, event_id // 7 % 4 AS style FROM events), s AS (SELECT *, CASE WHEN generated THEN NULL ELSE style END AS own, CASE WHEN generated THEN NULL ELSE visible END AS own_visible FROM c), f AS (SELECT page, idx, coalesce(last_value(own IGNORE NULLS) OVER w, 0) AS style, coalesce(last_value(own_visible IGNORE NULLS) OVER w, true) AS visible, count(*) FILTER (NOT generated AND visible) OVER (PARTITION BY page) AS seen FROM s WINDOW w AS (PARTITION BY page ORDER BY idx)), k AS (SELECT * FROM f WHERE visible OR seen = 0), i AS (SELECT *, CASE WHEN lag(style) OVER (PARTITION BY page ORDER BY idx) = style THEN 0 ELSE 1 END AS st FROM k), g AS (SELECT *, sum(st) OVER (PARTITION BY page ORDER BY idx) AS span FROM i) SELECT page, CAST(span AS BIGINT) AS span, min(style) AS style, min(idx) AS start, count(*) AS n FROM g GROUP BY page, span")
def styled_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of one style: generated characters take the style before them, and a page's hidden layer counts only without a visible one."""
    i = F.col("event_id")
    over = Window.partitionBy("page").orderBy("idx")
    c = table(spark, sf_dir, "events").select(F.col("user_id").alias("page"), i.alias("idx"), (i % 6 == 5).alias("generated"), (i % 11 < 7).alias("visible"), (F.floor(i / 7) % 4).alias("style"))
    back = lambda x, otherwise: F.coalesce(F.last(F.when(~F.col("generated"), F.col(x)), ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, 0)), F.lit(otherwise))
    seen = F.count_if(~F.col("generated") & F.col("visible")).over(Window.partitionBy("page"))
    k = c.select("page", "idx", back("style", 0).alias("style"), back("visible", True).alias("visible"), seen.alias("seen")).where("visible or seen = 0")
    runs = islands(k.withColumn("same", F.lag("style").over(over) == F.col("style")), ["page"], ["idx"], ~F.coalesce("same", F.lit(False)), "span")
    return runs.groupBy("page", "span").agg(F.min("style").alias("style"), F.min("idx").alias("start"), F.count("*").alias("n"))


@query("WITH RECURSIVE o AS (SELECT page_id AS node, CASE WHEN page_id > 0 THEN page_id // 2 END AS form, page_id % 7 AS dx, page_id % 5 AS dy FROM pages), w AS (SELECT node, dx AS x, dy AS y, 0 AS depth FROM o WHERE form IS NULL UNION ALL SELECT o.node, w.x + o.dx, w.y + o.dy, w.depth + 1 FROM o JOIN w ON o.form = w.node WHERE w.depth < 8) SELECT node, x, y, depth FROM w")
def object_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where objects of nested forms stand: shifts added up along eight levels at most, by doubling."""
    i = F.col("page_id")
    walk = table(spark, sf_dir, "pages").select(i.alias("node"), F.when(i > 0, F.floor(i / 2)).alias("at"), (i % 7).alias("x"), (i % 5).alias("y"), F.when(i > 0, 1).otherwise(0).alias("depth"))
    for _ in range(4):
        up = walk.select(F.col("node").alias("_n"), F.col("at").alias("_a"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("depth").alias("_d"))
        j = walk.join(up, F.col("at") == F.col("_n"), "left")
        plus = lambda c: (F.col(c) + F.coalesce(f"_{c[0]}", F.lit(0))).alias(c)
        walk = j.select("node", F.when(F.col("_n").isNotNull(), F.col("_a")).otherwise(F.col("at")).alias("at"), plus("x"), plus("y"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"))
    return walk.where("at is null and depth <= 8").select("node", "x", "y", "depth")


@query("WITH j AS (SELECT user_id AS worker, event_id, event_id % 4 AS priority, event_id % 9 = 0 AS cancelled FROM events) SELECT worker, event_id, row_number() OVER (PARTITION BY worker ORDER BY priority, event_id) AS turn FROM j WHERE NOT cancelled")
def render_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of a worker as they are taken: by priority, then as they came; cancelled ones are passed over."""
    j = table(spark, sf_dir, "events").where("event_id % 9 <> 0").select(F.col("user_id").alias("worker"), "event_id", (F.col("event_id") % 4).alias("priority"))
    return j.select("worker", "event_id", F.row_number().over(Window.partitionBy("worker").orderBy("priority", "event_id")).cast("long").alias("turn"))


_ASKED = "o_orderkey AS ask, 5 + o_orderkey % 20 AS pages, (1 + o_orderkey % 6) || CASE o_orderkey % 5 WHEN 0 THEN '-' || (3 + o_orderkey % 9) WHEN 1 THEN ', x' WHEN 2 THEN ',, 2 ,' || (o_orderkey % 30) ELSE '' END || CASE o_orderkey % 3 WHEN 0 THEN ' , 1-2' ELSE '' END AS text"


@query(f"""WITH a AS (SELECT {_ASKED} FROM orders), p AS (SELECT ask, pages, trim(unnest(string_split(text, ','))) AS part FROM a), s AS (SELECT *, CASE WHEN contains(part, '-') THEN try_cast(regexp_extract(part, '^([0-9]+)\\s*-\\s*[0-9]+$', 1) AS BIGINT) ELSE try_cast(part AS BIGINT) END AS lo, CASE WHEN contains(part, '-') THEN try_cast(regexp_extract(part, '^[0-9]+\\s*-\\s*([0-9]+)$', 1) AS BIGINT) ELSE try_cast(part AS BIGINT) END AS hi FROM p WHERE part <> ''),
 g AS (SELECT *, coalesce(lo >= 1 AND hi <= pages AND lo <= hi, false) AS good FROM s), k AS (SELECT ask, bool_and(good) AS valid FROM g GROUP BY ask), x AS (SELECT g.ask, unnest(range(lo - 1, hi)) AS page FROM g JOIN k USING (ask) WHERE valid)
 SELECT k.ask, valid, (SELECT count(DISTINCT page) FROM x WHERE x.ask = k.ask) AS n_pages, coalesce((SELECT string_agg(page, ' ' ORDER BY page) FROM (SELECT DISTINCT page FROM x WHERE x.ask = k.ask)), '') AS chosen FROM k""")
def page_ranges_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts like ``1-3, 5`` as pages from 0, each once and in order; one bad part makes all of it invalid."""
    i = F.col("o_orderkey")
    text = F.concat((1 + i % 6).cast("string"), F.when(i % 5 == 0, F.concat(F.lit("-"), (3 + i % 9).cast("string"))).when(i % 5 == 1, ", x").when(i % 5 == 2, F.concat(F.lit(",, 2 ,"), (i % 30).cast("string"))).otherwise(""), F.when(i % 3 == 0, " , 1-2").otherwise(""))
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")
    ends = lambda p, k: F.when(p.contains("-"), F.regexp_extract(p, r"^([0-9]+)\s*-\s*([0-9]+)$", k)).otherwise(p).try_cast("long")
    a = table(spark, sf_dir, "orders").select(i.alias("ask"), (5 + i % 20).alias("pages"), F.transform(parts, lambda p: F.struct(ends(p, 1).alias("lo"), ends(p, 2).alias("hi"))).alias("p"))
    good = F.forall("p", lambda x: F.coalesce((x["lo"] >= 1) & (x["hi"] <= F.col("pages")) & (x["lo"] <= x["hi"]), F.lit(False)))
    a = a.withColumn("valid", good)
    chosen = F.when(F.col("valid"), F.array_sort(F.array_distinct(F.flatten(F.transform("p", lambda x: F.sequence(x["lo"] - 1, x["hi"] - 1)))))).otherwise(F.array().cast("array<bigint>"))
    return a.withColumn("c", chosen).select("ask", "valid", F.size("c").cast("long").alias("n_pages"), F.array_join(F.transform("c", lambda v: v.cast("string")), " ").alias("chosen"))


@query("WITH p AS (SELECT o_custkey AS doc, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page, CASE WHEN o_orderkey % 7 = 0 THEN 842 ELSE 792 END AS height, 1 + o_orderkey % 10 // 8 AS columns FROM orders), f AS (SELECT *, CASE WHEN lag(height) OVER w = height AND lag(columns) OVER w = columns THEN 0 ELSE 1 END AS s FROM p WINDOW w AS (PARTITION BY doc ORDER BY page)), g AS (SELECT *, sum(s) OVER (PARTITION BY doc ORDER BY page) AS section FROM f) SELECT doc, CAST(section AS BIGINT) AS section, min(page) AS first_page, max(page) AS last_page, min(height) AS height, min(columns) AS columns FROM g GROUP BY doc, section")
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of a document: pages in succession of one size and number of columns."""
    over = Window.partitionBy("doc").orderBy("page")
    p = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long").alias("page"), F.when(F.col("o_orderkey") % 7 == 0, 842).otherwise(792).alias("height"), (1 + F.floor(F.col("o_orderkey") % 10 / 8)).alias("columns"))
    same = (F.lag("height").over(over) == F.col("height")) & (F.lag("columns").over(over) == F.col("columns"))
    g = islands(p.withColumn("same", same), ["doc"], ["page"], ~F.coalesce("same", F.lit(False)), "section")
    return g.groupBy("doc", "section").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.min("height").alias("height"), F.min("columns").alias("columns"))


@query(f"WITH {_PAGES_SQL}, a AS (SELECT event_id, user_id AS doc_id, event_id * 13 % 4000 AS y FROM events), c AS (SELECT a.event_id, a.doc_id, y, page, greatest(top - y, y - top - height, 0) AS away FROM a JOIN placed USING (doc_id)) SELECT event_id, doc_id, y, arg_min(page, away * 100000 + page) AS nearest, min(away) AS away, bool_or(away = 0) AS hit FROM c GROUP BY ALL")
def nearest_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page at a height of a document laid out, or the nearest one; the upper one wins ties.

    Pages follow one another: only the last one that starts at or above the height and the next one can be nearest.
    """
    a = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("doc_id"), (F.col("event_id") * 13 % 4000).alias("y"))
    over = Window.partitionBy("doc_id").orderBy("page")
    pages = placed_pages(table(spark, sf_dir, "documents")).select("doc_id", "page", "top", "height").withColumn("next_page", F.lead("page").over(over)).withColumn("next_top", F.lead("top").over(over))
    none = pages.where("page = 0").select("doc_id", F.lit(None).cast("long").alias("page"), F.lit(-(1 << 40)).alias("top"), F.lit(None).cast(pages.schema["height"].dataType).alias("height"), F.col("page").alias("next_page"), F.col("top").alias("next_top"))
    marks = pages.unionByName(none).withColumnRenamed("top", "y").withColumn("at_top", F.col("y"))
    c = as_of(a, marks, ["doc_id"], "y", ["next_page"], ["page", "at_top", "height", "next_page", "next_top"])
    choice = lambda page, away: F.when(F.col(page).isNotNull(), F.struct(away.alias("away"), F.col(page).alias("page")))
    best = F.least(choice("page", F.greatest(F.col("y") - F.col("at_top") - F.col("height"), F.lit(0))), choice("next_page", F.col("next_top") - F.col("y")))
    return c.withColumn("x", best).where("x is not null").select("event_id", "doc_id", "y", F.col("x.page").alias("nearest"), F.col("x.away").alias("away"), (F.col("x.away") == 0).alias("hit"))
