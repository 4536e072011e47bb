"""Tables of pages and their numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagequarry.functions.stats import ranked_groups
from pagequarry.operators.tables import boundaries, ruled_grids, unruled_tables
from pagequarry.plans.registry import query
from pagequarry.sources.views import LINES_SQL, lines, table

_FOLD = "list_reduce(list_prepend({'done': []::DOUBLE[], 'sum': 0::DOUBLE, 'n': 0::BIGINT, 'x': 0::DOUBLE}, list_transform(list_sort(p), lambda x: {'done': []::DOUBLE[], 'sum': 0::DOUBLE, 'n': 0::BIGINT, 'x': x})), lambda a, b: CASE WHEN a.n > 0 AND b.x - a.sum / a.n <= 6 THEN {'done': a.done, 'sum': a.sum + b.x, 'n': a.n + 1, 'x': b.x} ELSE {'done': CASE WHEN a.n = 0 THEN a.done ELSE list_append(a.done, a.sum / a.n) END, 'sum': b.x, 'n': 1::BIGINT, 'x': b.x} END)"


@query(f"WITH p AS (SELECT user_id, event_id // 4096 AS page, list(CAST(floor(value) AS DOUBLE)) AS p FROM events WHERE value IS NOT NULL GROUP BY ALL), f AS (SELECT user_id, page, {_FOLD} AS f FROM p), c AS (SELECT user_id, page, list_append(f.done, f.sum / f.n) AS c FROM f) SELECT user_id, page, len(c) AS n, round(c[1], 6) AS first, round(c[-1], 6) AS last FROM c")
def table_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions on a page as boundaries of a table, six units apart at least."""
    e = table(spark, sf_dir, "events").where("value is not null").select("user_id", F.floor(F.col("event_id") / 4096).alias("page"), F.floor("value").cast("double").alias("x"))
    c = e.groupBy("user_id", "page").agg(F.collect_list("x").alias("p")).select("user_id", "page", boundaries(F.col("p"), 6).alias("c"))
    return c.select("user_id", "page", F.size("c").cast("long").alias("n"), F.round(F.element_at("c", 1), 6).alias("first"), F.round(F.element_at("c", -1), 6).alias("last"))


@query()
def table_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids that an order's rules draw: lines of the order make rules across, their parts rules down."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    x, y = F.col("l_partkey") % 5 * 40.0 + F.col("l_suppkey") % 3, F.col("l_linenumber") * 20.0
    rule = lambda across, a, b, c, d: F.struct(F.lit(across).alias("across"), a.cast("double").alias("l"), b.cast("double").alias("t"), c.cast("double").alias("r"), d.cast("double").alias("b"))
    both = F.array(rule(True, F.lit(0), y, F.lit(160), y + 1), rule(False, x, F.lit(0), x + 1, F.lit(140)))
    pages = li.select("l_orderkey", F.explode(both).alias("rule")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list("rule")).alias("rules"))
    return ruled_grids(pages, ["l_orderkey"], glyph=12, snap_least=2)


_PIECES = "SELECT doc_id, page, line, 16 * line + line // 10 * 30 AS t, 16 * line + line // 10 * 30 + 12 AS b, i AS piece, 100 * i + length(text) % 2 AS l, 100 * i + 40 + length(text) % 7 AS r, length(text) % 90 AS chars FROM (SELECT *, unnest(range(2 + length(text) // 40 % 2)) AS i FROM lines)"


@query(f"WITH {LINES_SQL}, pieces AS ({_PIECES}), made AS (SELECT doc_id, page, line, min(t) AS t, max(b) AS b, count(*) AS n, max(chars) AS chars FROM pieces GROUP BY ALL), s AS (SELECT *, t - lag(t) OVER w AS step FROM made WINDOW w AS (PARTITION BY doc_id, page ORDER BY line)), p AS (SELECT doc_id, page, list_sort(list(step) FILTER (step IS NOT NULL))[count(step) // 2 + 1] AS pitch FROM s GROUP BY ALL), f AS (SELECT s.*, pitch, n >= 2 AND chars <= 80 AS fits FROM s JOIN p USING (doc_id, page)), g AS (SELECT *, CASE WHEN lag(fits) OVER w IS NULL OR NOT lag(fits) OVER w OR lag(n) OVER w <> n OR t - lag(b) OVER w >= greatest(coalesce(pitch, 0), 12) * 1.6 THEN 1 ELSE 0 END AS starts FROM f WINDOW w AS (PARTITION BY doc_id, page ORDER BY line)), r AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id, page ORDER BY line ROWS UNBOUNDED PRECEDING) AS run FROM g), c AS (SELECT r.doc_id, r.page, run, piece, min(r.line) AS first_line, count(*) AS n_rows, min(q.l) AS l0, max(q.l) AS l1, min(q.r) AS r0, max(q.r) AS r1 FROM r JOIN pieces q USING (doc_id, page, line) WHERE fits GROUP BY ALL), e AS (SELECT *, coalesce(l0 > lag(r1) OVER (PARTITION BY doc_id, page, run ORDER BY piece), true) AND (l1 - l0 <= 5 OR r1 - r0 <= 5) AS good FROM c), h AS (SELECT doc_id, page, run, min(first_line) AS first_line, max(n_rows) AS n_rows, count(*) AS n_columns, min(l0) AS l, max(r1) AS r FROM e GROUP BY doc_id, page, run HAVING bool_and(good) AND max(n_rows) >= 3) SELECT doc_id, page, first_line, n_rows, n_columns, l, r FROM h QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY first_line) <= 6")
def unruled_page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables without rules, the first six of a page (the feature's limit); pieces are made from lines' lengths."""
    n, line = F.char_length("text"), F.col("line")
    top = 16 * line + F.floor(line / 10) * 30
    cut = lines(table(spark, sf_dir, "documents")).select("doc_id", "page", "line", n.alias("n"), top.alias("t"), (top + 12).alias("b"), F.explode(F.sequence(F.lit(0), 1 + F.floor(n / 40).cast("int") % 2)).alias("piece"))
    p, n = F.col("piece").cast("long"), F.col("n")
    pieces = cut.select("doc_id", "page", "line", "t", "b", "piece", (100 * p + n % 2).alias("l"), (100 * p + 40 + n % 7).alias("r"), (n % 90).alias("chars"))
    return unruled_tables(pieces, ["doc_id", "page"], glyph=12, tolerance=5)


@query("SELECT l_returnflag, list_sort(list(l_quantity))[count(*) // 4 + 1] AS padding, list_sort(list(l_extendedprice))[count(*) // 2 + 1] AS weight FROM lineitem GROUP BY l_returnflag")
def cell_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lower quartile of insets and the upper median of rules' weights."""
    li = table(spark, sf_dir, "lineitem")
    padding = ranked_groups(li, ["l_returnflag"], "l_quantity", {"padding": F.floor(F.col("n") / 4)})
    return padding.join(ranked_groups(li, ["l_returnflag"], "l_extendedprice", {"weight": F.floor(F.col("n") / 2)}), "l_returnflag")


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL) SELECT user_id, arg_max(event_type, n * 1000000000000 - first) AS colour, max(n) AS n FROM c GROUP BY user_id")
def rule_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest colour of a table's rules; the first seen wins ties."""
    c = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
    return c.groupBy("user_id").agg(F.max_by("event_type", F.struct("n", -F.col("first"))).alias("colour"), F.max("n").alias("n"))


@query("WITH f AS (SELECT user_id, event_type AS family, value > 50 AS bold, value > 100 AS italic, min(event_id) AS first FROM events WHERE value IS NOT NULL GROUP BY ALL) SELECT user_id, family, bold, italic, first FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY first) <= 24")
def fonts_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each font and style once, by first use; 24 a document (the feature's limit)."""
    style = [F.col("event_type").alias("family"), (F.col("value") > 50).alias("bold"), (F.col("value") > 100).alias("italic")]
    f = table(spark, sf_dir, "events").where("value is not null").groupBy("user_id", *style).agg(F.min("event_id").alias("first"))
    return f.withColumn("nth", F.row_number().over(Window.partitionBy("user_id").orderBy("first"))).where("nth <= 24").drop("nth")


@query(f"WITH {LINES_SQL}, g AS (SELECT doc_id, length(text) % 4 AS gap FROM lines), n AS (SELECT doc_id, count(*) AS n, list_sort(list(gap) FILTER (gap > 0)) AS gaps FROM g GROUP BY doc_id) SELECT doc_id, CASE WHEN 2 * len(gaps) > n THEN gaps[len(gaps) // 2 + 1] END AS gap FROM n")
def paragraph_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usual gap between paragraphs, if more than half of them have one."""
    g = lines(table(spark, sf_dir, "documents")).select("doc_id", (F.char_length("text") % 4).cast("long").alias("gap"))
    counts = g.groupBy("doc_id").agg(F.count("*").alias("all"), F.count_if(F.col("gap") > 0).alias("some"))
    middle = ranked_groups(g.where("gap > 0"), ["doc_id"], "gap", {"gap": F.floor(F.col("n") / 2)})
    return counts.join(middle, "doc_id", "left").select("doc_id", F.when(2 * F.col("some") > F.col("all"), F.col("gap")).alias("gap"))
