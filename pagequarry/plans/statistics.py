"""Exact statistics of documents and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagequarry.functions.stats import ranked_groups
from pagequarry.functions.text import running_head_key
from pagequarry.operators.shapes import islands
from pagequarry.plans.registry import query
from pagequarry.sources.views import LINES_SQL, lines, table


@query("SELECT l_returnflag, list_sort(list(l_quantity))[count(*) // 2 + 1] AS upper_median FROM lineitem GROUP BY l_returnflag")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_groups(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", {"upper_median": F.floor(F.col("n") / 2)})


@query("SELECT l_returnflag, list_sort(list(l_quantity))[(count(*) - 1) // 2 + 1] AS lower_median FROM lineitem GROUP BY l_returnflag")
def lower_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_groups(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", {"lower_median": F.floor((F.col("n") - 1) / 2)})


_RANKS = {"p20": 0.2, "p25": 0.25, "p80": 0.8, "p85": 0.85}


@query("SELECT l_returnflag, l_linestatus, " + ", ".join(f"list_sort(list(l_quantity))[CAST(round_even((count(*) - 1) * {v}, 0) AS BIGINT) + 1] AS {k}" for k, v in _RANKS.items()) + " FROM lineitem GROUP BY l_returnflag, l_linestatus")
def nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_groups(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", {k: F.bround((F.col("n") - 1) * v) for k, v in _RANKS.items()})


@query(f"WITH {LINES_SQL}, w AS (SELECT doc_id, length(text) // 10 AS size, sum(length(text)) AS w FROM lines GROUP BY ALL) SELECT doc_id, CAST(size AS BIGINT) AS body_size, CAST(w AS BIGINT) AS weight FROM w QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, size) = 1")
def body_size_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line size that most characters have; the smaller wins ties."""
    w = lines(table(spark, sf_dir, "documents")).groupBy("doc_id", F.floor(F.char_length("text") / 10).alias("size")).agg(F.sum(F.char_length("text")).alias("w"))
    best = F.max_by(F.struct("size", "w"), F.struct(F.col("w"), -F.col("size")))
    return w.groupBy("doc_id").agg(best.alias("x")).select("doc_id", F.col("x.size").alias("body_size"), F.col("x.w").alias("weight"))


@query(f"WITH {LINES_SQL}, s AS (SELECT DISTINCT doc_id, length(text) // 10 AS size FROM lines WHERE length(text) > 0), b AS (SELECT doc_id, min(size) AS body FROM s WHERE size > 0 GROUP BY doc_id), k AS (SELECT s.doc_id, size, row_number() OVER (PARTITION BY s.doc_id ORDER BY size DESC) AS level FROM s JOIN b ON s.doc_id = b.doc_id WHERE 100 * size >= 112 * body AND size <= 6 * body) SELECT doc_id, size, level FROM k WHERE level <= 4")
def heading_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four largest sizes from 1.12 to 6 times the body's, largest first."""
    s = lines(table(spark, sf_dir, "documents")).where("text <> ''").select("doc_id", F.floor(F.char_length("text") / 10).alias("size")).distinct()
    b = s.where("size > 0").groupBy("doc_id").agg(F.min("size").alias("body"))
    k = s.join(b, "doc_id").where("100 * size >= 112 * body and size <= 6 * body").withColumn("level", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("size"))))
    return k.where("level <= 4").select("doc_id", "size", F.col("level").cast("long").alias("level"))


_KEY_SQL = "replace(regexp_replace(trim(text), '\\d+', '#', 'g'), '  ', ' ')"


@query(f"WITH {LINES_SQL} SELECT {_KEY_SQL} AS key, count(DISTINCT doc_id) AS n_docs, count(*) AS n_lines, min(doc_id) AS first_doc FROM lines WHERE length(trim(text)) > 0 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3")
def running_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that three documents or more repeat, digits aside."""
    keyed = lines(table(spark, sf_dir, "documents")).where("char_length(trim(text)) > 0").select(running_head_key(F.col("text")).alias("key"), "doc_id")
    by_doc = keyed.groupBy("key", "doc_id").agg(F.count("*").alias("n"))
    return by_doc.groupBy("key").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_lines"), F.min("doc_id").alias("first_doc")).where("n_docs >= 3")


@query("WITH p AS (SELECT DISTINCT user_id, event_id % 60 AS page FROM events), g AS (SELECT *, page - row_number() OVER (PARTITION BY user_id ORDER BY page) AS k FROM p), r AS (SELECT user_id, k, min(page) + 1 AS a, max(page) + 1 AS b FROM g GROUP BY user_id, k), t AS (SELECT user_id, a, CASE WHEN b > a + 1 THEN a || '–' || b WHEN b = a + 1 THEN a || ', ' || b ELSE '' || a END AS part, row_number() OVER (PARTITION BY user_id ORDER BY a) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM r) SELECT user_id, string_agg(part, ', ' ORDER BY a) FILTER (WHERE i <= 6) || CASE WHEN max(n) > 6 THEN ' and ' || (max(n) - 6) || ' more' ELSE '' END AS pages FROM t GROUP BY user_id")
def page_ranges_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as text: ``1, 3, 7–9``; beyond six parts, how many more."""
    p = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 60).alias("page")).distinct()
    over = Window.partitionBy("user_id").orderBy("page")
    runs = p.withColumn("k", F.col("page") - F.row_number().over(over)).groupBy("user_id", "k").agg((F.min("page") + 1).alias("a"), (F.max("page") + 1).alias("b"))
    part = F.expr("case when b > a + 1 then concat(a, '–', b) when b = a + 1 then concat(a, ', ', b) else cast(a as string) end")
    parts = runs.withColumn("part", part).groupBy("user_id").agg(F.expr("transform(array_sort(collect_list(struct(a, part))), x -> x.part)").alias("parts"))
    return parts.select("user_id", F.expr("concat(array_join(slice(parts, 1, 6), ', '), if(size(parts) > 6, concat(' and ', size(parts) - 6, ' more'), ''))").alias("pages"))


_GREY = "CAST(floor(value) AS BIGINT) % 256"


@query(f"WITH h AS (SELECT g, count(x.g0) AS n FROM (SELECT unnest(range(256)) AS g) LEFT JOIN (SELECT {_GREY} AS g0 FROM events WHERE value IS NOT NULL) x ON g = g0 GROUP BY g), c AS (SELECT g, CAST(sum(n) OVER w AS DOUBLE) AS w0, CAST(sum(n * g) OVER w AS DOUBLE) AS s0, CAST(sum(n) OVER () AS DOUBLE) AS w, CAST(sum(n * g) OVER () AS DOUBLE) AS s FROM h WINDOW w AS (ORDER BY g ROWS UNBOUNDED PRECEDING)), v AS (SELECT g, CASE WHEN w0 > 0 AND w > w0 THEN round((s0 * w - s * w0) * (s0 * w - s * w0) / (w0 * (w - w0)) / w, 3) END AS v FROM c) SELECT CAST((min(g) + max(g)) // 2 + 1 AS BIGINT) AS threshold FROM v WHERE v = (SELECT max(v) FROM v)")
def otsu_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grey level that splits values best; the middle of tied ones, and one more."""
    found = table(spark, sf_dir, "events").where("value is not null").groupBy(F.expr("cast(floor(value) as bigint) % 256").alias("g")).agg(F.count("*").alias("n"))
    h = spark.range(256).withColumnRenamed("id", "g").join(found, "g", "left").fillna(0, ["n"])
    # 256 rows, whatever the input.
    up = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    c = h.select("g", *[F.sum(x).over(o).cast("double").alias(n) for n, x, o in (("w0", F.col("n"), up), ("s0", F.col("n") * F.col("g"), up), ("w", F.col("n"), every), ("s", F.col("n") * F.col("g"), every))])
    v = c.withColumn("v", F.expr("case when w0 > 0 and w > w0 then round((s0 * w - s * w0) * (s0 * w - s * w0) / (w0 * (w - w0)) / w, 3) end"))
    best = v.withColumn("best", F.max("v").over(every)).where("v = best")
    return best.agg((F.floor((F.min("g") + F.max("g")) / 2) + 1).cast("long").alias("threshold"))


@query(f"WITH {LINES_SQL}, p AS (SELECT doc_id, page, min(length(text) - length(ltrim(text))) AS l, max(length(text)) AS r, count(*) AS n FROM lines WHERE length(trim(text)) > 0 GROUP BY doc_id, page) SELECT doc_id, list_sort(list(l))[count(*) // 2 + 1] AS left_margin, list_sort(list(r))[CAST(round_even((count(*) - 1) * 0.85, 0) AS BIGINT) + 1] AS right_edge, CAST(sum(n) AS BIGINT) AS n_lines FROM p GROUP BY doc_id")
def margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's left margin (upper median over pages) and right edge (85th percentile)."""
    p = lines(table(spark, sf_dir, "documents")).where("char_length(trim(text)) > 0").groupBy("doc_id", "page").agg(F.min(F.expr("char_length(text) - char_length(ltrim(text))")).cast("long").alias("l"), F.max(F.char_length("text")).cast("long").alias("r"), F.count("*").alias("n"))
    left = ranked_groups(p, ["doc_id"], "l", {"left_margin": F.floor(F.col("n") / 2)})
    right = ranked_groups(p, ["doc_id"], "r", {"right_edge": F.bround((F.col("n") - 1) * 0.85)})
    return left.join(right, "doc_id").join(p.groupBy("doc_id").agg(F.sum("n").alias("n_lines")), "doc_id")


@query(f"WITH {LINES_SQL}, p AS (SELECT doc_id, page % 2 AS odd, avg(length(text) - length(ltrim(text))) AS m FROM lines GROUP BY ALL) SELECT doc_id, round(max(m) FILTER (WHERE odd = 0), 6) AS even_margin, round(max(m) FILTER (WHERE odd = 1), 6) AS odd_margin, coalesce(abs(max(m) FILTER (WHERE odd = 0) - max(m) FILTER (WHERE odd = 1)) > 4, false) AS mirrored FROM p GROUP BY doc_id")
def mirrored_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margins by page parity, and whether they differ by more than 4."""
    p = lines(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(*[F.avg(F.when(F.col("page") % 2 == k, F.expr("char_length(text) - char_length(ltrim(text))"))).alias(n) for k, n in ((0, "e"), (1, "o"))])
    return p.select("doc_id", F.round("e", 6).alias("even_margin"), F.round("o", 6).alias("odd_margin"), F.coalesce(F.abs(F.col("e") - F.col("o")) > 4, F.lit(False)).alias("mirrored"))


@query("WITH e AS (SELECT user_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS gap FROM events) SELECT user_id, count(*) AS n, list_sort(list(gap))[CAST(round_even((count(*) - 1) * 0.25, 0) AS BIGINT) + 1] AS pitch FROM e WHERE gap > 0 GROUP BY user_id HAVING count(*) >= 3")
def line_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25th percentile of the steps between neighbours, from three samples on."""
    gap = F.col("event_id") - F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    e = table(spark, sf_dir, "events").select("user_id", gap.alias("gap")).where("gap > 0")
    return ranked_groups(e, ["user_id"], "gap", {"pitch": F.bround((F.col("n") - 1) * 0.25)}, count="n").where("n >= 3").select("user_id", "n", "pitch")


@query("WITH b AS (SELECT event_type, CAST(round_even(value / 10, 0) AS BIGINT) AS bucket, count(*) AS n, avg(value) AS mean FROM events WHERE value IS NOT NULL GROUP BY ALL) SELECT event_type, bucket, n, round(mean, 6) AS mean FROM b QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY n DESC, bucket) = 1")
def bucketed_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fullest bucket of values and its mean; the lower wins ties."""
    b = table(spark, sf_dir, "events").where("value is not null").groupBy("event_type", F.bround(F.col("value") / 10).cast("long").alias("bucket")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    best = F.max_by(F.struct("bucket", "n", "mean"), F.struct(F.col("n"), -F.col("bucket")))
    return b.groupBy("event_type").agg(best.alias("x")).select("event_type", F.col("x.bucket").alias("bucket"), F.col("x.n").alias("n"), F.round("x.mean", 6).alias("mean"))


@query(f"WITH {LINES_SQL}, s AS (SELECT doc_id, line, length(text) AS n FROM lines), d AS (SELECT doc_id, n, count(*) AS c, min(line) AS first_seen FROM s GROUP BY ALL), t AS (SELECT *, sum(c) OVER (PARTITION BY doc_id) AS every FROM d) SELECT doc_id, CAST(n AS BIGINT) AS style, c AS n_lines, 10 * c >= 8 * every AS dominant FROM t QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, first_seen) = 1")
def dominant_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest line length of a document, and whether eight tenths of the lines have it."""
    d = lines(table(spark, sf_dir, "documents")).groupBy("doc_id", F.char_length("text").cast("long").alias("style")).agg(F.count("*").alias("n_lines"), F.min("line").alias("first_seen"))
    best = F.max_by(F.struct("style", "n_lines"), F.struct(F.col("n_lines"), -F.col("first_seen")))
    g = d.groupBy("doc_id").agg(best.alias("x"), F.sum("n_lines").alias("every"))
    return g.select("doc_id", F.col("x.style").alias("style"), F.col("x.n_lines").alias("n_lines"), (10 * F.col("x.n_lines") >= 8 * F.col("every")).alias("dominant"))


@query("SELECT user_id, count(*) AS n, min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b FROM (SELECT user_id, CAST(floor(value) AS BIGINT) AS l, event_id % 50 AS t, CAST(floor(value) AS BIGINT) + event_id % 9 AS r, event_id % 50 + event_id % 7 AS b FROM events WHERE value IS NOT NULL) WHERE r > l AND b > t GROUP BY user_id")
def union_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rectangle around each user's rectangles; empty ones add nothing."""
    e = table(spark, sf_dir, "events").where("value is not null").selectExpr("user_id", "floor(value) as l", "event_id % 50 as t", "floor(value) + event_id % 9 as r", "event_id % 50 + event_id % 7 as b")
    return e.where("r > l and b > t").groupBy("user_id").agg(F.count("*").alias("n"), F.min("l").alias("l"), F.min("t").alias("t"), F.max("r").alias("r"), F.max("b").alias("b"))


@query("WITH x AS (SELECT event_type, CAST(floor(value) AS BIGINT) % 100 AS x FROM events WHERE value IS NOT NULL), h AS (SELECT event_type, x, count(*) AS n FROM x GROUP BY ALL), f AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY event_type ORDER BY x) = 1 THEN 0 ELSE 1 END AS s FROM h) SELECT event_type, CAST(k AS BIGINT) AS run, min(x) AS low, max(x) AS high, CAST(sum(n) AS BIGINT) AS ink FROM (SELECT *, sum(s) OVER (PARTITION BY event_type ORDER BY x ROWS UNBOUNDED PRECEDING) AS k FROM f) GROUP BY event_type, k")
def ink_profile_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of columns with ink, from a histogram of columns."""
    h = table(spark, sf_dir, "events").where("value is not null").groupBy("event_type", (F.floor("value") % 100).alias("x")).agg(F.count("*").alias("n"))
    step = F.col("x") - F.lag("x").over(Window.partitionBy("event_type").orderBy("x"))
    run = islands(h.withColumn("step", step), ["event_type"], ["x"], F.col("step").isNull() | (F.col("step") != 1), "run")
    return run.groupBy("event_type", "run").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.sum("n").alias("ink"))
