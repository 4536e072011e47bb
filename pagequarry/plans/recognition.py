"""Recognised words and ink: baselines, scripts, reading order, symbol repair, leaders, tracking, grids.

Lines of orders stand for lines of recognised glyphs, in whole units of a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagequarry.operators.shapes import islands
from pagequarry.plans.registry import query
from pagequarry.sources.views import LINES_SQL, lines, table

#: How the recogniser spells pi, what a script's height, rise and drop are (hundredths of a line's height).
PI, SCRIPT_HEIGHT, RISE, DROP = ["TT", "Tt", "tt", "1t", "It", "lt", "7t"], 78, 30, 15
#: Letters that hang below the line.
DESCENDERS = "gjpqyQJ,;µ"

_GLYPH_SQL = "g AS (SELECT l_orderkey AS line, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS idx, 20 * row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) + l_partkey % 7 AS x, 100 - CASE WHEN l_suppkey % 4 = 0 THEN l_partkey % 12 ELSE 0 END + CASE WHEN l_suppkey % 7 = 0 THEN 6 ELSE 0 END AS bottom, CASE WHEN l_suppkey % 4 = 0 OR l_suppkey % 7 = 0 THEN 7 ELSE 14 + l_partkey % 3 END AS height, CASE WHEN l_suppkey % 4 = 0 OR l_suppkey % 7 = 0 THEN chr(48 + (l_partkey % 10)::INT) ELSE chr(97 + (l_partkey % 26)::INT) END AS ch FROM lineitem)"


def glyph_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``line, idx, x, bottom, height, ch``: letters on the line, small digits above and below it."""
    li = table(spark, sf_dir, "lineitem")
    idx = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    small = (s % 4 == 0) | (s % 7 == 0)
    bottom = 100 - F.when(s % 4 == 0, p % 12).otherwise(0) + F.when(s % 7 == 0, 6).otherwise(0)
    ch = F.when(small, F.char((48 + p % 10).cast("int"))).otherwise(F.char((97 + p % 26).cast("int")))
    return li.select(F.col("l_orderkey").alias("line"), idx.alias("idx"), p, s, "l_orderkey").select("line", F.col("idx").cast("long").alias("idx"), (20 * F.col("idx") + p % 7).alias("x"), bottom.alias("bottom"), F.when(small, 7).otherwise(14 + p % 3).alias("height"), ch.alias("ch"))


_BASE_SQL = f"""{_GLYPH_SQL},
 h AS (SELECT line, list_sort(list(height))[least(count(*) - 1, count(*) * 4 // 5) + 1] AS line_height FROM g GROUP BY line),
 r AS (SELECT g.line, list({{'x': x, 'bottom': bottom}}) AS tall, list({{'x': x, 'bottom': bottom}}) FILTER (NOT contains('{DESCENDERS}', ch)) AS rests FROM g JOIN h USING (line) WHERE 10 * height >= 7 * line_height GROUP BY g.line),
 n AS (SELECT g.*, line_height, coalesce(rests, tall) AS rests FROM g JOIN h USING (line) JOIN r USING (line)),
 b AS (SELECT line, idx, x, bottom, height, ch, line_height, list_sort(list_transform(list_sort(list_transform(rests, lambda q: {{'d': abs(q.x - x), 'x': q.x, 'bottom': q.bottom}}))[1:5], lambda q: q.bottom))[least(len(rests), 5) // 2 + 1] AS rest FROM n)"""


def with_baselines(glyphs: DataFrame) -> DataFrame:
    """Glyphs with ``line_height`` (80th percentile) and ``rest``: the median bottom of the five resting glyphs nearest in x."""
    line = Window.partitionBy("line")
    heights = F.array_sort(F.collect_list("height").over(line))
    g = glyphs.withColumn("line_height", F.element_at(heights, F.least(F.size(heights) - 1, F.floor(F.size(heights) * 4 / 5)).cast("int") + 1))
    tall = F.when(10 * F.col("height") >= 7 * F.col("line_height"), F.struct("x", "bottom", F.lit(DESCENDERS).contains(F.col("ch")).alias("hangs")))
    g = g.withColumn("tall", F.collect_list(tall).over(line)).withColumn("rests", F.filter("tall", lambda q: ~q["hangs"]))
    rests = F.when(F.size("rests") > 0, F.col("rests")).otherwise(F.col("tall"))
    near = F.slice(F.array_sort(F.transform(rests, lambda q: F.struct(F.abs(q["x"] - F.col("x")).alias("d"), q["x"].alias("x"), q["bottom"].alias("bottom")))), 1, 5)
    bottoms = F.array_sort(F.transform("near", lambda q: q["bottom"]))
    return g.withColumn("near", near).withColumn("rest", F.element_at(bottoms, F.floor(F.size(bottoms) / 2).cast("int") + 1)).drop("tall", "rests", "near")


@query(f"WITH {_BASE_SQL} SELECT line, idx, line_height, rest FROM b")
def local_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a line rests at each of its glyphs, and how tall its type is."""
    return with_baselines(glyph_rows(spark, sf_dir)).select("line", "idx", "line_height", "rest")


@query(f"""WITH {_BASE_SQL}, s AS (SELECT *, CASE WHEN ch NOT BETWEEN '0' AND '9' AND ch NOT IN ('o', 'O', '°', 'º') OR 100 * height >= {SCRIPT_HEIGHT} * line_height THEN 0 WHEN 100 * (rest - bottom) > {RISE} * line_height THEN 1 WHEN 100 * (bottom - rest) > {DROP} * line_height AND 2 * (rest - (bottom - height)) < line_height THEN -1 ELSE 0 END AS script FROM b),
 f AS (SELECT *, CASE WHEN script <> 0 AND lag(script) OVER w = script THEN 0 ELSE 1 END AS st, lag(ch) OVER w AS before FROM s WINDOW w AS (PARTITION BY line ORDER BY idx)),
 i AS (SELECT *, sum(st) OVER (PARTITION BY line ORDER BY idx) AS run FROM f),
 rr AS (SELECT line, run, min(script) AS script, count(*) AS k, string_agg(ch, '' ORDER BY idx) AS t, list(before ORDER BY idx)[1] AS before FROM i GROUP BY line, run),
 m AS (SELECT line, count(*) AS n, count(*) FILTER (script <> 0) AS marked, string_agg(ch, '' ORDER BY idx) AS plain FROM s GROUP BY line),
 o AS (SELECT line, string_agg(CASE WHEN script = 0 THEN t WHEN script = 1 AND k = 1 AND t IN ('0', 'o', 'O', '°', 'º') AND before BETWEEN '0' AND '9' THEN '°' WHEN regexp_matches(t, '^[0-9]+$') AND (script = 1 OR regexp_matches(coalesce(before, ''), '^[\\p{{L}}0-9]$')) THEN CASE WHEN script = 1 THEN '^' ELSE '_' END || CASE WHEN k > 1 THEN '(' || t || ')' ELSE t END ELSE t END, '' ORDER BY run) AS text FROM rr GROUP BY line)
 SELECT line, marked, CASE WHEN n >= 3 AND marked > n // 2 THEN plain ELSE text END AS text FROM m JOIN o USING (line)""")
def script_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with raised and lowered digits written out: ``x^2``, ``a_(10)``, ``90°``; unless most of a line seems raised."""
    b = with_baselines(glyph_rows(spark, sf_dir))
    digit, ring = F.col("ch").rlike("^[0-9]$"), F.col("ch").isin("o", "O", "°", "º")
    tall = F.col("line_height")
    script = F.when(~(digit | ring) | (100 * F.col("height") >= SCRIPT_HEIGHT * tall), 0).when(100 * (F.col("rest") - F.col("bottom")) > RISE * tall, 1).when((100 * (F.col("bottom") - F.col("rest")) > DROP * tall) & (2 * (F.col("rest") - F.col("bottom") + F.col("height")) < tall), -1).otherwise(0)
    over = Window.partitionBy("line").orderBy("idx")
    s = b.withColumn("script", script).withColumn("before", F.lag("ch").over(over)).withColumn("same", (F.col("script") != 0) & (F.lag("script").over(over) == F.col("script")))
    runs = islands(s, ["line"], ["idx"], ~F.coalesce("same", F.lit(False)), "run")
    joined = lambda of, at: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, of))), lambda q: q[of]), "")
    r = runs.groupBy("line", "run").agg(F.min("script").alias("script"), F.count("*").alias("k"), joined("ch", "idx").alias("t"), F.min_by("before", "idx").alias("before"))
    number = F.col("t").rlike("^[0-9]+$") & ((F.col("script") == 1) | F.coalesce(F.col("before").rlike(r"^[\p{L}0-9]$"), F.lit(False)))
    degree = (F.col("script") == 1) & (F.col("k") == 1) & F.col("t").isin("0", "o", "O", "°", "º") & F.coalesce(F.col("before").rlike("^[0-9]$"), F.lit(False))
    marked = F.concat(F.when(F.col("script") == 1, "^").otherwise("_"), F.when(F.col("k") > 1, F.concat(F.lit("("), "t", F.lit(")"))).otherwise(F.col("t")))
    written = F.when(F.col("script") == 0, F.col("t")).when(degree, "°").when(number, marked).otherwise(F.col("t"))
    lines_ = r.withColumn("w", written).groupBy("line").agg(joined("w", "run").alias("text"), joined("t", "run").alias("plain"), F.sum("k").alias("n"), F.sum(F.when(F.col("script") != 0, F.col("k")).otherwise(0)).alias("marked"))
    return lines_.select("line", "marked", F.when((F.col("n") >= 3) & (F.col("marked") > F.floor(F.col("n") / 2)), F.col("plain")).otherwise(F.col("text")).alias("text"))


@query("WITH b AS (SELECT user_id AS page, event_id, event_id * 37 % 900 // 450 AS col, event_id * 37 % 900 AS l, event_id * 53 % 900 AS t FROM events), f AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY page, col ORDER BY t, l, event_id) < 8 THEN 0 ELSE 1 END AS s FROM b), r AS (SELECT *, sum(s) OVER (PARTITION BY page, col ORDER BY t, l, event_id ROWS UNBOUNDED PRECEDING) AS row FROM f) SELECT page, event_id, col, CAST(row AS BIGINT) AS row, row_number() OVER (PARTITION BY page ORDER BY col, row, l, event_id) AS place FROM r")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks by column, then by rows of tops that chain within 0.6 of a glyph, then from the left."""
    e = table(spark, sf_dir, "events").selectExpr("user_id as page", "event_id", "event_id * 37 % 900 div 450 as col", "event_id * 37 % 900 as l", "event_id * 53 % 900 as t")
    order = ["t", "l", "event_id"]
    near = F.coalesce(F.col("t") - F.lag("t").over(Window.partitionBy("page", "col").orderBy(*order)) < 8, F.lit(False))
    rows = islands(e.withColumn("near", near), ["page", "col"], order, ~F.col("near"), "row")
    return rows.select("page", "event_id", "col", "row", F.row_number().over(Window.partitionBy("page").orderBy("col", "row", "l", "event_id")).cast("long").alias("place"))


_TOKEN = "['(TT-1)', 'ABtt+2', '7t-4', 'LABC', 'ZXY', 'word', '(lt)lt5', 'lAB'][event_id % 8 + 1]"
_PI_SQL = "CASE WHEN length(t) < 3 OR NOT regexp_matches(t, '[()+−-]') OR NOT regexp_matches(t, '[0-9]') THEN t " + " ".join(f"WHEN regexp_matches(t, '(^|[^\\p{{L}}]){x}([^\\p{{L}}]|$)') THEN regexp_replace(t, '(^|[^\\p{{L}}]){x}([^\\p{{L}}]|$)', '\\1π\\2')" for x in PI) + " ELSE t END"


def repaired_pi(text: Column) -> Column:
    """The first spelling of pi that stands by itself in a token that does arithmetic."""
    sums = (F.char_length(text) >= 3) & text.rlike("[()+−-]") & text.rlike("[0-9]")
    out = F.when(~sums, text)
    for spelling in PI:
        alone = rf"(?<!\p{{L}}){spelling}(?!\p{{L}})"
        out = out.when(text.rlike(alone), F.regexp_replace(text, rf"^(.*?){alone}", "$1π"))
    return out.otherwise(text)


@query(f"WITH w AS (SELECT user_id, event_id, {_TOKEN} AS t, CASE WHEN event_id % 3 = 0 THEN '= 5' ELSE 'x' END AS nxt FROM events), p AS (SELECT *, {_PI_SQL} AS u, lead(nxt) OVER (PARTITION BY user_id ORDER BY event_id) AS q FROM w) SELECT event_id, CASE WHEN regexp_matches(u, '^[LZl][A-Z]{{2,3}}$') AND starts_with(q, '=') THEN '∠' || substring(u, 2) ELSE u END AS text FROM p")
def symbol_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pi and angles that a recogniser has no letters for, where no word can be meant."""
    tokens = ["(TT-1)", "ABtt+2", "7t-4", "LABC", "ZXY", "word", "(lt)lt5", "lAB"]
    i = F.col("event_id")
    w = table(spark, sf_dir, "events").select("user_id", i, F.element_at(F.array(*map(F.lit, tokens)), (i % 8 + 1).cast("int")).alias("t"), F.when(i % 3 == 0, "= 5").otherwise("x").alias("nxt"))
    p = w.select(i, repaired_pi(F.col("t")).alias("u"), F.lead("nxt").over(Window.partitionBy("user_id").orderBy("event_id")).alias("q"))
    angle = F.col("u").rlike("^[LZl][A-Z]{2,3}$") & F.coalesce(F.startswith("q", F.lit("=")), F.lit(False))
    return p.select(i, F.when(angle, F.concat(F.lit("∠"), F.expr("substring(u, 2)"))).otherwise(F.col("u")).alias("text"))


_ENTRY = "p_name || ' ' || CASE p_partkey % 5 WHEN 0 THEN repeat('. ', p_size % 7) WHEN 1 THEN repeat('.', p_size % 9) WHEN 2 THEN repeat('_', p_size % 8) WHEN 3 THEN '…' || repeat('.', p_size % 3) ELSE repeat('·', p_size % 9) END || ' ' || CASE p_partkey % 4 WHEN 0 THEN 'xiv' WHEN 1 THEN CAST(p_partkey AS VARCHAR) WHEN 2 THEN 'A-' || p_partkey ELSE 'the end' END"


@query(f"WITH e AS (SELECT p_partkey, {_ENTRY} AS text FROM part), m AS (SELECT p_partkey, regexp_extract(text, '^(.*[\\p{{L}}\\p{{Nd}}][^.…·_]*?)\\s*([.…](?:\\s*[.…])*|[·](?:\\s*[·])*|_(?:\\s*_)*)\\s*([^\\s.…·_][^.…·_]{{0,14}})$', ['a', 'run', 'tail']) AS x FROM e) SELECT p_partkey, CASE WHEN starts_with(x.run, '_') THEN 'line' WHEN starts_with(x.run, '·') THEN 'middle' ELSE 'dot' END AS kind, x.tail AS target FROM m WHERE x.run <> '' AND length(regexp_replace(replace(x.run, '…', '...'), '\\s', '', 'g')) >= 4 AND CASE WHEN starts_with(x.run, '_') THEN regexp_matches(x.tail, '^[0-9]+$') ELSE regexp_matches(x.tail, '[0-9]') OR regexp_matches(lower(x.tail), '^[ivxlcdm]{{1,7}}$') END")
def leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with a leader: four marks at least after a letter, and a page or numbered reference at their end."""
    k = F.col("p_partkey")
    size = F.col("p_size")
    marks = F.when(k % 5 == 0, F.repeat(F.lit(". "), size % 7)).when(k % 5 == 1, F.repeat(F.lit("."), size % 9)).when(k % 5 == 2, F.repeat(F.lit("_"), size % 8)).when(k % 5 == 3, F.concat(F.lit("…"), F.repeat(F.lit("."), size % 3))).otherwise(F.repeat(F.lit("·"), size % 9))
    tail = F.when(k % 4 == 0, "xiv").when(k % 4 == 1, k.cast("string")).when(k % 4 == 2, F.concat(F.lit("A-"), k.cast("string"))).otherwise("the end")
    text = F.concat("p_name", F.lit(" "), marks, F.lit(" "), tail)
    pattern = r"^(.*[\p{L}\p{Nd}][^.…·_]*?)\s*([.…](?:\s*[.…])*|[·](?:\s*[·])*|_(?:\s*_)*)\s*([^\s.…·_][^.…·_]{0,14})$"
    m = table(spark, sf_dir, "part").select(k, F.regexp_extract(text, pattern, 2).alias("run"), F.regexp_extract(text, pattern, 3).alias("target"))
    enough = F.char_length(F.regexp_replace(F.replace("run", F.lit("…"), F.lit("...")), r"\s", "")) >= 4
    blank = F.startswith("run", F.lit("_"))
    reference = F.when(blank, F.col("target").rlike("^[0-9]+$")).otherwise(F.col("target").rlike("[0-9]") | F.lower("target").rlike("^[ivxlcdm]{1,7}$"))
    return m.where((F.col("run") != "") & enough & reference).select(k, F.when(blank, "line").when(F.startswith("run", F.lit("·")), "middle").otherwise("dot").alias("kind"), "target")


@query(f"WITH {LINES_SQL}, m AS (SELECT doc_id, line, CASE WHEN line % 3 = 0 THEN rtrim(text, '.') || chr(173) ELSE text END AS text FROM lines), n AS (SELECT *, lead(text) OVER (PARTITION BY doc_id ORDER BY line) AS nxt FROM m) SELECT doc_id, line, regexp_matches(text, '\\p{{L}}' || chr(173) || '$') AND coalesce(regexp_matches(nxt, '^\\s*\\p{{Ll}}'), false) AS joined FROM n WHERE ends_with(text, chr(173))")
def soft_hyphens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soft hyphens at ends of lines: one after a letter goes where the next line begins in lower case."""
    m = lines(table(spark, sf_dir, "documents")).select("doc_id", "line", F.when(F.col("line") % 3 == 0, F.concat(F.expr("rtrim('.', text)"), F.lit("­"))).otherwise(F.col("text")).alias("text"))
    n = m.withColumn("nxt", F.lead("text").over(Window.partitionBy("doc_id").orderBy("line")))
    joined = F.col("text").rlike("\\p{L}­$") & F.coalesce(F.col("nxt").rlike(r"^\s*\p{Ll}"), F.lit(False))
    return n.where(F.endswith("text", F.lit("­"))).select("doc_id", "line", joined.alias("joined"))


@query("WITH c AS (SELECT p_partkey, i, substring(p_name, i, 1) AS ch, i > 1 AND substring(p_name, i - 1, 1) = ' ' AS word FROM part, LATERAL (SELECT unnest(range(1, length(p_name) + 1)) AS i) WHERE substring(p_name, i, 1) <> ' '), g AS (SELECT *, CASE WHEN i > 1 THEN CASE WHEN word THEN 14 ELSE 4 + i % 3 END END AS gap FROM c), m AS (SELECT p_partkey, list_sort(list(gap) FILTER (gap IS NOT NULL))[count(gap) // 2 + 1] AS typical, count(*) AS n FROM g GROUP BY p_partkey) SELECT p_partkey, string_agg(CASE WHEN 100 * gap > 100 * typical + greatest(50 * typical, 165) THEN ' ' ELSE '' END || ch, '' ORDER BY i) AS text, CAST(least(greatest(min(typical), 0), 11) * 20 AS BIGINT) AS twips FROM g JOIN m USING (p_partkey) WHERE n >= 4 GROUP BY p_partkey")
def letter_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters set apart joined to words again: gaps far wider than the usual one are blanks, the usual one is spacing."""
    i = F.col("i")
    c = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.explode(F.sequence(F.lit(1), F.char_length("p_name"))).alias("i")).withColumn("ch", F.substring(F.col("p_name"), i, F.lit(1))).where("ch <> ' '")
    word = (i > 1) & (F.substring(F.col("p_name"), F.greatest(i - 1, F.lit(1)), F.lit(1)) == " ")
    g = c.withColumn("gap", F.when(i > 1, F.when(word, 14).otherwise(4 + i % 3)))
    gaps = F.array_sort(F.collect_list("gap"))
    one = g.groupBy("p_partkey").agg(F.array_sort(F.collect_list(F.struct("i", "ch", "gap"))).alias("cs"), F.element_at(gaps, F.floor(F.count("gap") / 2).cast("int") + 1).alias("typical")).where("size(cs) >= 4")
    wide = lambda q: F.coalesce(100 * q["gap"] > 100 * F.col("typical") + F.greatest(50 * F.col("typical"), F.lit(165)), F.lit(False))
    text = F.array_join(F.transform("cs", lambda q: F.concat(F.when(wide(q), " ").otherwise(""), q["ch"])), "")
    return one.select("p_partkey", text.alias("text"), (F.least(F.greatest("typical", F.lit(0)), F.lit(11)) * 20).cast("long").alias("twips"))


@query("WITH w AS (SELECT l_orderkey AS block, l_linenumber AS n, l_linenumber * 7 + l_partkey % 3 AS x, l_linenumber * 12 + l_suppkey % 2 AS t FROM lineitem), s AS (SELECT *, x - lag(x) OVER (PARTITION BY block ORDER BY n, x, t) AS step FROM w), m AS (SELECT block, CASE WHEN count(step) >= 3 THEN list_sort(list(step) FILTER (step IS NOT NULL))[count(step) // 2 + 1]::DOUBLE END AS mid, min(x) AS origin FROM s GROUP BY block), k AS (SELECT block, origin, CASE WHEN mid IS NULL OR mid < 3.3 OR mid > 11 THEN 6.6 ELSE mid END AS width FROM m) SELECT w.block, w.n, w.x, width, CAST(round_even((w.x - origin) / width, 0) AS BIGINT) AS col FROM w JOIN k USING (block)")
def code_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of code: places in widths of a letter, the usual step between letters, from the leftmost one."""
    w = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as block", "l_linenumber as n", "l_linenumber * 7 + l_partkey % 3 as x", "l_linenumber * 12 + l_suppkey % 2 as t")
    s = w.withColumn("step", F.col("x") - F.lag("x").over(Window.partitionBy("block").orderBy("n", "x", "t")))
    steps = F.array_sort(F.collect_list("step"))
    m = s.groupBy("block").agg(F.when(F.count("step") >= 3, F.element_at(steps, F.floor(F.count("step") / 2).cast("int") + 1).cast("double")).alias("mid"), F.min("x").alias("origin"))
    k = m.select("block", "origin", F.when(F.col("mid").isNull() | (F.col("mid") < 3.3) | (F.col("mid") > 11), F.lit(6.6)).otherwise(F.col("mid")).alias("width"))
    return w.join(k, "block").select("block", "n", "x", "width", F.bround((F.col("x") - F.col("origin")) / F.col("width")).cast("long").alias("col"))


@query("WITH h AS (SELECT user_id % 40 AS page, event_id % 97 AS x, count(*) AS n FROM events WHERE event_id % 97 NOT BETWEEN 30 AND 36 OR user_id % 3 = 0 GROUP BY ALL), e AS (SELECT page, min(x) AS low, max(x) AS high FROM h GROUP BY page), a AS (SELECT page, x, low, high, coalesce(n, 0) AS n FROM e JOIN range(97) r(x) ON x BETWEEN low AND high LEFT JOIN h USING (page, x)), z AS (SELECT *, x - row_number() OVER (PARTITION BY page ORDER BY x) AS k FROM a WHERE n = 0), g AS (SELECT page, min(x) AS a, max(x) AS b, min(low) AS low, min(high) AS high FROM z GROUP BY page, k), c AS (SELECT page, (a + b) // 2 AS cut FROM g WHERE b - a + 1 >= greatest(3, (high - low + 1) // 50) AND a - low >= greatest(8, (high - low + 1) * 15 // 100) AND high - b >= greatest(8, (high - low + 1) * 15 // 100)) SELECT page, list_sort(list(cut))::VARCHAR AS cuts FROM c GROUP BY page HAVING count(*) <= 3")
def column_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a page's ink leaves gutters wide enough and far enough from both sides; none if there would be over three."""
    e = table(spark, sf_dir, "events").where("event_id % 97 not between 30 and 36 or user_id % 3 = 0").selectExpr("user_id % 40 as page", "event_id % 97 as x").distinct()
    after = F.lead("x").over(Window.partitionBy("page").orderBy("x"))
    ends = Window.partitionBy("page")
    gaps = e.withColumn("next", after).withColumn("low", F.min("x").over(ends)).withColumn("high", F.max("x").over(ends)).where("next - x > 1").selectExpr("page", "x + 1 as a", "next - 1 as b", "low", "high")
    wide = "b - a + 1 >= greatest(3, (high - low + 1) div 50) and a - low >= greatest(8, (high - low + 1) * 15 div 100) and high - b >= greatest(8, (high - low + 1) * 15 div 100)"
    cuts = gaps.where(wide).groupBy("page").agg(F.array_sort(F.collect_list(F.expr("(a + b) div 2"))).alias("c")).where("size(c) <= 3")
    return cuts.select("page", F.concat(F.lit("["), F.array_join(F.transform("c", lambda v: v.cast("string")), ", "), F.lit("]")).alias("cuts"))


@query("WITH w AS (SELECT event_id AS word, user_id AS page, event_id * 37 % 900 AS l, event_id * 53 % 900 AS t, 2 + event_id % 2 AS n FROM events WHERE event_id % 3 = 0), b AS (SELECT event_id AS blob, user_id AS page, event_id * 37 % 900 AS x, event_id * 53 % 900 AS y FROM events), m AS (SELECT word, w.page, n, count(*) AS k, min(x) AS low, max(x) AS high FROM w JOIN b ON b.page = w.page AND x BETWEEN l - 2 AND l + 62 AND y BETWEEN t - 12 AND t + 52 GROUP BY ALL) SELECT word, page, CASE WHEN k = n THEN low END AS low, CASE WHEN k = n THEN high END AS high, k FROM m")
def glyph_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks of ink that lie in a word's box: its letters, if there are as many as it has; by cells of 64 units."""
    e = table(spark, sf_dir, "events")
    w = e.where("event_id % 3 = 0").selectExpr("event_id as word", "user_id as page", "event_id * 37 % 900 as l", "event_id * 53 % 900 as t", "2 + event_id % 2 as n")
    b = e.selectExpr("user_id as page", "event_id * 37 % 900 as x", "event_id * 53 % 900 as y", "event_id * 37 % 900 div 64 as column", "event_id * 53 % 900 div 64 as row")
    cells = w.withColumn("column", F.explode(F.expr("sequence((l - 2) div 64, (l + 62) div 64)"))).withColumn("row", F.explode(F.expr("sequence((t - 12) div 64, (t + 52) div 64)")))
    inside = cells.join(b, ["page", "column", "row"]).where("x between l - 2 and l + 62 and y between t - 12 and t + 52")
    m = inside.groupBy("word", "page", "n").agg(F.count("*").alias("k"), F.min("x").alias("low"), F.max("x").alias("high"))
    return m.select("word", "page", F.when(F.col("k") == F.col("n"), F.col("low")).alias("low"), F.when(F.col("k") == F.col("n"), F.col("high")).alias("high"), "k")


@query("WITH w AS (SELECT event_id, user_id AS page, event_id * 7 % 640 AS x, substring(event_type, 1, 2) AS t FROM events), s AS (SELECT *, x // 80 AS slot FROM w WHERE x % 80 < 70) SELECT page, slot // 2 AS fraction, coalesce(string_agg(t, '' ORDER BY event_id) FILTER (slot % 2 = 0), '') AS numerator, coalesce(string_agg(t, '' ORDER BY event_id) FILTER (slot % 2 = 1), '') AS denominator FROM s GROUP BY page, slot // 2")
def slot_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words read off a sheet of fractions by the slot that holds their centre, in order, as numerators and denominators."""
    s = table(spark, sf_dir, "events").where("event_id * 7 % 640 % 80 < 70").selectExpr("user_id as page", "event_id", "event_id * 7 % 640 div 80 as slot", "substring(event_type, 1, 2) as t")
    of = lambda half: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("slot") % 2 == half, F.struct("event_id", "t")))), lambda q: q["t"]), "")
    return s.groupBy("page", F.floor(F.col("slot") / 2).alias("fraction")).agg(of(0).alias("numerator"), of(1).alias("denominator"))


@query("""WITH RECURSIVE c AS (SELECT o_custkey AS sheet, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, 20 + o_orderkey % 50 AS w FROM orders),
 s AS (SELECT sheet, o_orderkey, k, w, 0::BIGINT AS row, 0::BIGINT AS x FROM c WHERE k = 1 UNION ALL
  SELECT c.sheet, c.o_orderkey, c.k, c.w, CASE WHEN c.k % 2 = 1 AND s.x + s.w + 8 + 2 * (c.w + 8) > 300 THEN s.row + 1 ELSE s.row END, CASE WHEN c.k % 2 = 1 AND s.x + s.w + 8 + 2 * (c.w + 8) > 300 THEN 0 ELSE s.x + s.w + 8 END FROM s JOIN c ON c.sheet = s.sheet AND c.k = s.k + 1)
 SELECT sheet, o_orderkey, row, x FROM s""")
def fraction_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Halves of fractions set out on a sheet 300 wide: a pair never breaks over two rows."""
    one = F.array_sort(F.collect_list(F.struct("o_orderkey", (20 + F.col("o_orderkey") % 50).alias("w"))))
    sheets = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("sheet")).agg(one.alias("crops"))

    def place(acc: Column, c: Column) -> Column:
        wraps = (F.size(acc["done"]) > 0) & (F.size(acc["done"]) % 2 == 0) & (acc["used"] + 2 * (c["w"] + 8) > 300)
        row, x = F.when(wraps, acc["row"] + 1).otherwise(acc["row"]), F.when(wraps, 0).otherwise(acc["used"]).cast("long")
        return F.struct(F.concat(acc["done"], F.array(F.struct(c["o_orderkey"].alias("o_orderkey"), row.alias("row"), x.alias("x")))).alias("done"), row.alias("row"), (x + c["w"] + 8).alias("used"))

    begin = F.struct(F.expr("cast(array() as array<struct<o_orderkey:bigint,row:bigint,x:bigint>>)").alias("done"), F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("used"))
    return sheets.select("sheet", F.explode(F.aggregate("crops", begin, place, lambda a: a["done"])).alias("x")).select("sheet", "x.*")


_MEASURED = f"{LINES_SQL}, m AS (SELECT doc_id, line, length(text) AS n, 12 + length(text) % 4 * 0.5 AS box, CASE WHEN line % 9 = 4 THEN 13.0 ELSE 7 + length(text) % 3 * 0.5 END AS glyph FROM lines WHERE length(text) > 0)"


@query(f"WITH {_MEASURED}, bb AS (SELECT doc_id, round_even(box, 0) AS k, count(*) AS c, avg(box) AS mean, min(line) AS f FROM m GROUP BY doc_id, round_even(box, 0) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, f) = 1), gg AS (SELECT doc_id, round_even(glyph, 0) AS k, count(*) AS c, avg(glyph) AS mean, min(line) AS f FROM m GROUP BY doc_id, round_even(glyph, 0) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, f) = 1), b AS (SELECT bb.doc_id, least(greatest(round_even(round(bb.mean, 4) * 0.8 * 2, 0) / 2, 6), 36) AS body, round(gg.mean, 4) AS bg FROM bb JOIN gg USING (doc_id)) SELECT doc_id, line, CASE WHEN glyph / bg > 1.5 AND n > 40 OR abs(glyph / bg - 1) <= 0.18 THEN body ELSE least(greatest(round_even(body * round(glyph / bg, 4) * 2, 0) / 2, body * 0.7), body * 2) END AS size FROM m JOIN b USING (doc_id)")
def recognised_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type sizes of recognised lines: one body size a document, and other sizes only where a short line's letters say so."""
    n = F.char_length("text")
    m = lines(table(spark, sf_dir, "documents")).where(n > 0).select("doc_id", "line", n.alias("n"), (12 + n % 4 * F.lit(0.5)).alias("box"), F.when(F.col("line") % 9 == 4, F.lit(13.0)).otherwise(7 + n % 3 * F.lit(0.5)).alias("glyph"))

    def mode(c: str) -> DataFrame:
        k = m.groupBy("doc_id", F.bround(c).alias("k")).agg(F.count("*").alias("c"), F.avg(c).alias("mean"), F.min("line").alias("f"))
        return k.groupBy("doc_id").agg(F.round(F.max_by("mean", F.struct("c", -F.col("f"))), 4).alias(c))

    b = mode("box").join(mode("glyph").withColumnRenamed("glyph", "bg"), "doc_id")
    body = F.least(F.greatest(F.bround(F.col("box") * 0.8 * 2) / 2, F.lit(6.0)), F.lit(36.0))
    j = m.join(b.select("doc_id", body.alias("body"), "bg"), "doc_id")
    ratio = F.col("glyph") / F.col("bg")
    usual = ((ratio > 1.5) & (F.col("n") > 40)) | (F.abs(ratio - 1) <= 0.18)
    scaled = F.least(F.greatest(F.bround(F.col("body") * F.round(ratio, 4) * 2) / 2, F.col("body") * 0.7), F.col("body") * 2)
    return j.select("doc_id", "line", F.when(usual, F.col("body")).otherwise(scaled).alias("size"))


@query(f"WITH {LINES_SQL}, k AS (SELECT doc_id, page, line, length(text) >= 56 AS wide, line % 2 AS band FROM lines), f AS (SELECT *, CASE WHEN lag(wide) OVER w = wide THEN 0 ELSE 1 END AS s FROM k WINDOW w AS (PARTITION BY doc_id, page ORDER BY line)), r AS (SELECT *, sum(s) OVER (PARTITION BY doc_id, page ORDER BY line) AS run FROM f) SELECT doc_id, page, CAST(run AS BIGINT) AS run, min(line) AS first_line, count(*) AS n_lines, bool_and(wide) OR count(DISTINCT band) < 2 AS spanning FROM r GROUP BY doc_id, page, run")
def column_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of lines that span the measure and of narrow ones; narrow ones in fewer than two columns count as spanning."""
    k = lines(table(spark, sf_dir, "documents")).select("doc_id", "page", "line", (F.char_length("text") >= 56).alias("wide"), (F.col("line") % 2).alias("band"))
    same = F.lag("wide").over(Window.partitionBy("doc_id", "page").orderBy("line")) == F.col("wide")
    r = islands(k.withColumn("same", same), ["doc_id", "page"], ["line"], ~F.coalesce("same", F.lit(False)), "run")
    return r.groupBy("doc_id", "page", "run").agg(F.min("line").alias("first_line"), F.count("*").alias("n_lines"), (F.bool_and("wide") | (F.count_distinct("band") < 2)).alias("spanning"))


@query(f"WITH {LINES_SQL}, w AS (SELECT doc_id, line, i, w[i + 1] AS t, length(w[i + 1]) AS n FROM (SELECT doc_id, line, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM lines), LATERAL (SELECT unnest(range(len(w))) AS i)), p AS (SELECT *, 60 * i AS l, 60 * i + 60 - 4 * (i % 3) + CASE WHEN i % 5 = 0 THEN 10 ELSE 0 END AS r FROM w), b AS (SELECT *, lag(r) OVER (PARTITION BY doc_id, line ORDER BY i) AS pr FROM p) SELECT doc_id, line, CAST(sum(n) + count(*) - 1 AS BIGINT) AS chars, count(*) FILTER (l > pr) AS boxed_blanks, round(sum((r - l) * 1.0 / n), 4) AS widths FROM b GROUP BY doc_id, line")
def word_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of letters out of boxes of words: split evenly, with one for a blank only where it has room; summed a line."""
    w = lines(table(spark, sf_dir, "documents")).select("doc_id", "line", F.filter(F.split("text", " ", -1), lambda x: x != "").alias("w")).where("size(w) > 0")
    place = lambda x, i: F.struct(F.char_length(x).alias("n"), (60 * i).alias("l"), (60 * i + 60 - 4 * (i % 3) + F.when(i % 5 == 0, 10).otherwise(0)).alias("r"))
    p = w.select("doc_id", "line", F.transform("w", place).alias("p"))
    total = lambda f, zero: F.aggregate("p", zero, lambda a, x: a + f(x))
    blanks = F.size(F.filter(F.expr("transform(p, (x, i) -> i > 0 and x.l > p[greatest(i - 1, 0)].r)"), lambda y: y))
    return p.select("doc_id", "line", (total(lambda x: x["n"], F.lit(0)) + F.size("p") - 1).cast("long").alias("chars"), blanks.cast("long").alias("boxed_blanks"), F.round(total(lambda x: (x["r"] - x["l"]) * F.lit(1.0) / x["n"], F.lit(0.0)), 4).alias("widths"))


@query("""WITH w AS (SELECT user_id AS page, event_id, event_type AS t, event_id * 37 % 900 AS l, event_id * 53 % 900 AS y FROM events WHERE event_type <> 'purchase'), f AS (SELECT user_id AS page, event_id AS figure, event_id * 37 % 900 - 60 AS l, event_id * 53 % 900 - 40 AS t, event_id * 37 % 900 + 60 AS r, event_id * 53 % 900 + 40 AS b FROM events WHERE event_type = 'purchase'),
 h AS (SELECT w.*, (SELECT min(figure) FROM f WHERE f.page = w.page AND w.l BETWEEN f.l AND f.r AND w.y BETWEEN f.t AND f.b) AS figure FROM w),
 b AS (SELECT page, l // 450 AS col, l, y, event_id, t FROM h WHERE figure IS NULL UNION ALL SELECT page, greatest(l, 0) // 450, greatest(l, 0), greatest(t, 0), figure, '[figure]' FROM f WHERE EXISTS (SELECT 1 FROM h WHERE h.figure = f.figure)),
 s AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY page, col ORDER BY y, l, event_id) < 8 THEN 0 ELSE 1 END AS st FROM b), r AS (SELECT *, sum(st) OVER (PARTITION BY page, col ORDER BY y, l, event_id ROWS UNBOUNDED PRECEDING) AS row FROM s)
 SELECT page, count(*) AS parts, count(DISTINCT (col, row)) AS n_lines, md5(string_agg(t, ' ' ORDER BY col, row, l, event_id)) AS digest FROM r GROUP BY page""")
def rebuilt_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised pages put together again: words within a figure give way to one mark for it, the rest is read by columns, rows and from the left."""
    e = table(spark, sf_dir, "events")
    w = e.where("event_type <> 'purchase'").selectExpr("user_id as page", "event_id", "event_type as t", "event_id * 37 % 900 as l", "event_id * 53 % 900 as y")
    f = e.where("event_type = 'purchase'").selectExpr("user_id as page", "event_id as figure", "event_id * 37 % 900 as x", "event_id * 53 % 900 as z")
    # Figures are 120 by 80: they visit the cells of 128 units that they touch, words lie in one.
    cells = f.withColumn("column", F.explode(F.expr("sequence(greatest(x - 60, 0) div 128, (x + 60) div 128)"))).withColumn("row", F.explode(F.expr("sequence(greatest(z - 40, 0) div 128, (z + 40) div 128)")))
    held = w.withColumn("column", F.expr("l div 128")).withColumn("row", F.expr("y div 128")).join(cells, ["page", "column", "row"]).where("l between x - 60 and x + 60 and y between z - 40 and z + 40").groupBy("page", "event_id").agg(F.min("figure").alias("figure"))
    body = w.join(held, ["page", "event_id"], "left_anti")
    shown = f.join(held.select("page", "figure").distinct(), ["page", "figure"], "left_semi").select("page", F.col("figure").alias("event_id"), F.lit("[figure]").alias("t"), F.greatest(F.col("x") - 60, F.lit(0)).alias("l"), F.greatest(F.col("z") - 40, F.lit(0)).alias("y"))
    b = body.unionByName(shown).withColumn("col", F.expr("l div 450"))
    order = ["y", "l", "event_id"]
    near = F.coalesce(F.col("y") - F.lag("y").over(Window.partitionBy("page", "col").orderBy(*order)) < 8, F.lit(False))
    r = islands(b.withColumn("near", near), ["page", "col"], order, ~F.col("near"), "row")
    parts = F.array_sort(F.collect_list(F.struct("col", "row", "l", "event_id", "t")))
    return r.groupBy("page").agg(F.count("*").alias("parts"), F.count_distinct("col", "row").alias("n_lines"), F.md5(F.array_join(F.transform(parts, lambda x: x["t"]), " ").cast("binary")).alias("digest"))
