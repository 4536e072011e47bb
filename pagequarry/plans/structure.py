"""Tags, cells, tables and running heads."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagequarry.operators.shapes import islands
from pagequarry.operators.spatial import kept_apart
from pagequarry.operators.trees import depths
from pagequarry.plans import statistics
from pagequarry.plans.registry import SQL, query
from pagequarry.sources.views import LINES_SQL, lines, rows, table


@query("WITH RECURSIVE t AS (SELECT page_id AS node, CASE WHEN page_id > 0 THEN page_id // 3 END AS parent FROM pages), r AS (SELECT node, parent, 0 AS depth FROM t WHERE parent IS NULL UNION ALL SELECT t.node, t.parent, r.depth + 1 FROM t JOIN r ON t.parent = r.node WHERE r.depth < 64) SELECT node, parent, depth FROM r")
def outline_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An outline as rows with their depth, 64 levels at most; pages hang on a third of their number."""
    p = table(spark, sf_dir, "pages")
    return depths(p.select(F.col("page_id").alias("node"), F.when(F.col("page_id") > 0, F.floor(F.col("page_id") / 3)).alias("parent")))


@query("WITH RECURSIVE t AS (SELECT page_id AS node, CASE WHEN page_id > 0 THEN page_id - 1 - page_id % 2 * 2 * (page_id > 2)::INT END AS parent, coalesce(nullif(regexp_extract(html, '<([a-z]+)[^>]*>[^<]*</', 1), ''), 'P') AS sort, round_even(page_id * 7 / 5.0, 0)::INT - 9 AS span FROM pages), r AS (SELECT node, parent, sort, span, 0 AS depth FROM t WHERE parent IS NULL UNION ALL SELECT t.node, t.parent, t.sort, t.span, r.depth + 1 FROM t JOIN r ON t.parent = r.node WHERE r.depth < 24) SELECT node, parent, depth, sort, least(greatest(span, 1), 64) AS col_span FROM r")
def tag_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of a structure tree, 24 levels at most, with a sort and a span of 1 to 64 columns; the tree is a long chain."""
    i = F.col("page_id")
    sort = F.regexp_extract("html", "<([a-z]+)[^>]*>[^<]*</", 1)
    p = table(spark, sf_dir, "pages").select(i.alias("node"), F.when(i > 0, i - 1 - i % 2 * 2 * (i > 2).cast("int")).alias("parent"), F.when(sort != "", sort).otherwise("P").alias("sort"), (F.bround(i * 7 / 5.0).cast("int") - 9).alias("span"))
    found = depths(p.select("node", "parent"), 24).drop("parent")
    return found.join(p, "node").select("node", "parent", "depth", "sort", F.least(F.greatest("span", F.lit(1)), F.lit(64)).alias("col_span"))


_MARKS = "SELECT user_id AS doc_id, event_id % 97 AS start, event_id % 97 + 1 + event_id % 13 AS stop, event_id % 7 AS mcid FROM events WHERE event_type <> 'error'"
_NODES = "SELECT user_id AS doc_id, event_id * 3 % 7 AS mcid, event_id AS node FROM events WHERE event_type = 'error'"


def owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, idx, owner``: every marked character with the last node in order that has one of its marks."""
    e = table(spark, sf_dir, "events")
    marks = e.where("event_type <> 'error'").selectExpr("user_id as doc_id", "event_id % 97 as start", "event_id % 97 + 1 + event_id % 13 as stop", "event_id % 7 as mcid")
    last = e.where("event_type = 'error'").groupBy(F.col("user_id").alias("doc_id"), (F.col("event_id") * 3 % 7).alias("mcid")).agg(F.max("event_id").alias("node"))
    chars = marks.join(last, ["doc_id", "mcid"]).select("doc_id", "node", F.explode(F.sequence("start", F.col("stop") - 1)).alias("idx"))
    return chars.groupBy("doc_id", "idx").agg(F.max("node").alias("owner"))


_OWNED_SQL = f"m AS ({_MARKS}), n AS ({_NODES}), o AS (SELECT m.doc_id, i AS idx, max(node) AS owner FROM m JOIN n USING (doc_id, mcid), LATERAL (SELECT unnest(range(start, stop)) AS i) GROUP BY ALL)"


@query(f"WITH {_OWNED_SQL} SELECT doc_id, idx, owner FROM o")
def tag_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tag that owns each character: of all that mark it, the last in order."""
    return owned(spark, sf_dir)


@query(f"WITH {_OWNED_SQL}, f AS (SELECT *, CASE WHEN lag(owner) OVER w = owner AND lag(idx) OVER w = idx - 1 THEN 0 ELSE 1 END AS s FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY idx)), g AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY idx) AS run FROM f) SELECT doc_id, CAST(run AS BIGINT) AS run, min(owner) AS owner, min(idx) AS start, max(idx) + 1 AS stop FROM g GROUP BY doc_id, run")
def tag_owner_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of characters with one owner."""
    over = Window.partitionBy("doc_id").orderBy("idx")
    o = owned(spark, sf_dir).withColumn("same", (F.lag("owner").over(over) == F.col("owner")) & (F.lag("idx").over(over) == F.col("idx") - 1))
    runs = islands(o, ["doc_id"], ["idx"], ~F.coalesce("same", F.lit(False)), "run")
    return runs.groupBy("doc_id", "run").agg(F.min("owner").alias("owner"), F.min("idx").alias("start"), (F.max("idx") + 1).alias("stop"))


_PARTS = "SELECT user_id AS doc_id, event_id, event_id % 8 // 2 - 1 AS block, event_id // 50 % 2 AS band, event_id * 16 AS t, event_id * 16 + 4 + event_id % 9 AS b FROM events"


@query(f"WITH p AS ({_PARTS}), f AS (SELECT *, CASE WHEN block >= 0 AND lag(block) OVER w = block AND lag(band) OVER w = band AND t - lag(b) OVER w < 2000 THEN 0 ELSE 1 END AS s FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY event_id)), g AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY event_id) AS para FROM f) SELECT doc_id, CAST(para AS BIGINT) AS para, count(*) AS parts, min(event_id) AS first, min(t) AS t, max(b) AS b FROM g GROUP BY doc_id, para")
def tag_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that one tag, column and nearness make a paragraph."""
    over = Window.partitionBy("doc_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").selectExpr("user_id as doc_id", "event_id", "event_id % 8 div 2 - 1 as block", "event_id div 50 % 2 as band", "event_id * 16 as t", "event_id * 16 + 4 + event_id % 9 as b")
    same = lambda c: F.lag(c).over(over) == F.col(c)
    goes_on = F.coalesce((F.col("block") >= 0) & same("block") & same("band") & (F.col("t") - F.lag("b").over(over) < 2000), F.lit(False))
    runs = islands(e.withColumn("on", goes_on), ["doc_id"], ["event_id"], ~F.col("on"), "para")
    return runs.groupBy("doc_id", "para").agg(F.count("*").alias("parts"), F.min("event_id").alias("first"), F.min("t").alias("t"), F.max("b").alias("b"))


@query("""WITH RECURSIVE c AS (SELECT l_orderkey AS tbl, l_linenumber AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, least(greatest(l_partkey % 4, 1), 64), least(greatest(l_suppkey % 4, 1), 64)) AS k, l_linenumber % 3 = 1 AS fresh, least(greatest(l_partkey % 4, 1), 64) AS cs, least(greatest(l_suppkey % 4, 1), 64) AS rs FROM lineitem),
 s AS (SELECT tbl, k, n, 0::BIGINT AS row, 0::BIGINT AS col, cs, rs, list_transform(range(cs), lambda i: rs) AS until, cs AS at FROM c WHERE k = 1
  UNION ALL SELECT c.tbl, c.k, c.n, p.row, p.col, c.cs, c.rs, list_transform(range(greatest(len(p.until), p.col + c.cs)), lambda i: CASE WHEN i >= p.col AND i < p.col + c.cs THEN p.row + c.rs ELSE coalesce(p.until[i + 1], 0) END), p.col + c.cs
  FROM (SELECT q.*, q.at0 + coalesce(list_position(list_transform(q.until[q.at0 + 1:], lambda u: u <= q.row), true) - 1, greatest(len(q.until) - q.at0, 0)) AS col FROM (SELECT s.tbl, s.k, s.until, CASE WHEN x.fresh THEN s.row + 1 ELSE s.row END AS row, CASE WHEN x.fresh THEN 0 ELSE s.at END AS at0 FROM s JOIN c x ON x.tbl = s.tbl AND x.k = s.k + 1) q) p JOIN c ON c.tbl = p.tbl AND c.k = p.k + 1)
 SELECT tbl, n, row, col, cs AS col_span, rs AS row_span FROM s""")
def tagged_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where cells of a tagged table stand: each in the first slot of its row that no cell above reaches into.

    A table's cells stream past in order; what is held is how far down each of its slots is taken.
    """
    within = lambda c: F.least(F.greatest(c, F.lit(1)), F.lit(64)).cast("long")
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tbl"), F.col("l_linenumber").alias("n"), within(F.col("l_partkey") % 4).alias("col_span"), within(F.col("l_suppkey") % 4).alias("row_span"))
    placed = cells.repartition("tbl").sortWithinPartitions("tbl", F.col("n").asc_nulls_last(), "col_span", "row_span")
    return placed.mapInArrow(_placed_cells, "tbl long, n int, row long, col long, col_span long, row_span long")


def _placed_cells(batches):
    now, begun, row, at, until = None, False, 0, 0, []
    for batch in batches:
        rows, cols = [], []
        for tbl, n, wide, tall in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not begun or tbl != now:
                now, begun, row, at, until = tbl, True, 0, 0, []
            elif n is not None and n % 3 == 1:
                row, at = row + 1, 0
            while at < len(until) and until[at] > row:
                at += 1
            rows.append(row)
            cols.append(at)
            end = at + wide
            until += [0] * (end - len(until))
            until[at:end] = [row + tall] * wide
            at = end
        tbl, n, wide, tall = batch.columns
        yield pa.RecordBatch.from_arrays([tbl, n, pa.array(rows, pa.int64()), pa.array(cols, pa.int64()), wide, tall], ["tbl", "n", "row", "col", "col_span", "row_span"])


@query("""WITH g AS (SELECT o_orderkey AS grid, r, c, c = 0 OR (o_orderkey * 7 + r * 3 + c * 5) % 4 > 0 AS v, r = 0 OR (o_orderkey * 11 + r * 5 + c * 3) % 5 > 0 AS h, (r + 1 < 3) AND NOT (o_orderkey * 11 + (r + 1) * 5 + c * 3) % 5 > 0 AS open_below FROM orders, range(3) a(r), range(4) b(c)),
 s AS (SELECT *, sum(v::INT) OVER (PARTITION BY grid, r ORDER BY c) AS cell FROM g)
 SELECT grid, r AS row, min(c) AS col, count(*) AS col_span, CASE WHEN NOT arg_min(h, c) THEN 2 WHEN arg_min(open_below, c) THEN 1 ELSE 0 END AS merge FROM s GROUP BY grid, r, cell""")
def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of ruled grids: a missing edge joins columns, one above goes on from the row before (2), one below begins a merge (1)."""
    o, r, c = F.col("o_orderkey"), F.col("row"), F.col("c")
    above = lambda row: (row == 0) | ((o * 11 + row * 5 + c * 3) % 5 > 0)
    each = table(spark, sf_dir, "orders").select(o, F.explode(F.sequence(F.lit(0), F.lit(2))).alias("row")).select(o, r, F.explode(F.sequence(F.lit(0), F.lit(3))).alias("c"))
    edged = each.withColumn("v", (c == 0) | ((o * 7 + r * 3 + c * 5) % 4 > 0)).withColumn("h", above(r)).withColumn("open", (r + 1 < 3) & ~above(r + 1))
    cells = islands(edged, ["o_orderkey", "row"], ["c"], F.col("v"), "cell")
    first = F.min(F.struct("c", "h", "open"))
    found = cells.groupBy(o.alias("grid"), "row", "cell").agg(first.alias("x"), F.count("*").alias("col_span"))
    return found.select("grid", F.col("row").cast("long").alias("row"), F.col("x.c").cast("long").alias("col"), "col_span", F.when(~F.col("x.h"), 2).when(F.col("x.open"), 1).otherwise(0).alias("merge"))


@query(f"WITH {LINES_SQL}, k AS (SELECT doc_id, line, k AS row, substring(text, k * 90 + 1, 90) AS text FROM lines, LATERAL (SELECT unnest(range(greatest(CAST(ceil(length(text) / 90.0) AS BIGINT), 1))) AS k)), c AS (SELECT doc_id, line, row, c AS cell, trim(substring(text, c * 20 + 1, 20)) AS text FROM k, range(5) t(c)) SELECT doc_id, line, row, cell, text FROM c WHERE text <> ''")
def cell_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of each row by cells 20 letters wide: letters whose centre is in the cell, blanks between them kept."""
    cells = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.struct(i.cast("long").alias("cell"), F.trim(F.substring(F.col("text"), i * 20 + 1, F.lit(20))).alias("text")))
    each = rows(lines(table(spark, sf_dir, "documents"))).select("doc_id", "line", F.col("row").cast("long").alias("row"), F.explode(cells).alias("x"))
    return each.select("doc_id", "line", "row", "x.cell", "x.text").where("text <> ''")


_CANDIDATES = "SELECT user_id AS page, event_id, event_id % 3 AS rank, event_id * 37 % 900 AS l, event_id * 53 % 900 AS t, event_id * 37 % 900 + 20 + event_id % 150 AS r, event_id * 53 % 900 + 20 + event_id % 90 AS b FROM events"


@query(f"""WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY rank, event_id) AS k FROM ({_CANDIDATES})),
 s AS (SELECT page, k, event_id, rank, true AS kept, [{{'l': l, 't': t, 'r': r, 'b': b}}] AS held FROM c WHERE k = 1
  UNION ALL SELECT x.page, x.k, x.event_id, x.rank, x.kept, CASE WHEN x.kept THEN list_append(x.held, {{'l': x.l, 't': x.t, 'r': x.r, 'b': x.b}}) ELSE x.held END
  FROM (SELECT c.*, s.held, c.rank = 0 OR len(list_filter(s.held, lambda h: c.l < h.r AND h.l < c.r AND c.t < h.b AND h.t < c.b)) = 0 AS kept FROM s JOIN c ON c.page = s.page AND c.k = s.k + 1) x)
 SELECT page, event_id, rank FROM s WHERE kept""")
def table_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of a page: all ruled ones, then tagged and unruled ones that meet none kept before them."""
    e = table(spark, sf_dir, "events").selectExpr("user_id as page", "event_id % 3 as rank", "event_id", "event_id * 37 % 900 as l", "event_id * 53 % 900 as t", "event_id * 37 % 900 + 20 + event_id % 150 as r", "event_id * 53 % 900 + 20 + event_id % 90 as b")
    return kept_apart(e, "page", ["rank", "event_id"], F.col("rank") == 0).select("page", "event_id", "rank")


_WORDS = "SELECT l_orderkey AS line, l_linenumber AS word, l_linenumber * 70 + l_partkey % 60 AS l, l_linenumber * 70 + l_partkey % 60 + 10 + l_suppkey % 30 AS r FROM lineitem"


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as line", "l_linenumber as word", "l_linenumber * 70 + l_partkey % 60 as l", "l_linenumber * 70 + l_partkey % 60 + 10 + l_suppkey % 30 as r")
    return w.withColumn("gap", F.col("l") - F.lag("r").over(Window.partitionBy("line").orderBy("word", "l", "r")))


@query(f"WITH w AS ({_WORDS}), g AS (SELECT *, l - lag(r) OVER (PARTITION BY line ORDER BY word, l, r) AS gap FROM w), s AS (SELECT *, sum(CASE WHEN gap > 45 THEN 1 ELSE 0 END) OVER (PARTITION BY line ORDER BY word, l, r ROWS UNBOUNDED PRECEDING) AS piece FROM g) SELECT line, CAST(piece AS BIGINT) AS piece, min(l) AS l, max(r) AS r, count(*) AS words FROM s GROUP BY line, piece")
def line_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in pieces, cut at wide gaps between words."""
    s = islands(_gaps(spark, sf_dir), ["line"], ["word", "l", "r"], F.coalesce(F.col("gap") > 45, F.lit(False)), "piece")
    return s.groupBy("line", "piece").agg(F.min("l").alias("l"), F.max("r").alias("r"), F.count("*").alias("words"))


@query(f"WITH w AS ({_WORDS}), g AS (SELECT *, l - lag(r) OVER (PARTITION BY line ORDER BY word, l, r) AS gap FROM w), t AS (SELECT line, least(list_sort(list(gap) FILTER (gap IS NOT NULL))[count(gap) // 2 + 1], 3.85) AS typical FROM g GROUP BY line), h AS (SELECT *, greatest(27.5, 3.5 * typical, 12) AS threshold FROM t), k AS (SELECT g.*, threshold, bool_or(gap < threshold) OVER (PARTITION BY line) AS spaced FROM g JOIN h USING (line)) SELECT line, word, l AS stop FROM k WHERE spaced AND gap >= threshold")
def tab_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words after a tab: gaps far wider than a line's usual ones, where it has usual ones (type of 11 points)."""
    over = Window.partitionBy("line")
    gaps = F.array_sort(F.collect_list("gap").over(over))
    g = _gaps(spark, sf_dir).withColumn("typical", F.least(F.try_element_at(gaps, F.floor(F.size(gaps) / 2).cast("int") + 1).cast("double"), F.lit(3.85)))
    k = g.withColumn("threshold", F.greatest(F.lit(27.5), 3.5 * F.col("typical"), F.lit(12.0))).withColumn("spaced", F.bool_or(F.col("gap") < F.col("threshold")).over(over))
    return k.where("spaced and gap >= threshold").select("line", "word", F.col("l").alias("stop"))


_HEAD_SQL = """n AS (SELECT doc_id // 20 AS book, doc_id % 20 AS page, CASE WHEN doc_id % 7 < 6 THEN 'Report 2024 on ' || chr(65 + (doc_id // 20 % 26)::INT) || ', page ' || (doc_id % 20 + 3 + CASE WHEN doc_id // 20 % 5 = 4 THEN doc_id % 3 ELSE 0 END) ELSE string_split(text, chr(10))[1] END AS head FROM documents),
 b AS (SELECT book, count(*) AS pages, max(page) - min(page) + 1 = count(*) AS whole, min(page) AS first_page FROM n GROUP BY book),
 k AS (SELECT *, replace(regexp_replace(trim(head), '\\d+', '#', 'g'), '  ', ' ') AS key, regexp_extract_all(trim(head), '\\d{1,9}') AS numbers FROM n WHERE length(trim(head)) BETWEEN 1 AND 120),
 c AS (SELECT book, key, count(*) AS lines, count(DISTINCT page) AS on_pages, min(page) AS first FROM k GROUP BY ALL)"""


@query(f"""WITH {_HEAD_SQL}, p AS (SELECT c.book, c.key, on_pages, pages, first, first_page FROM c JOIN b USING (book) WHERE pages >= 4 AND whole AND lines = on_pages AND on_pages >= greatest(3, CAST(ceil(0.75 * pages) AS BIGINT))),
 d AS (SELECT book, key, i, min(numbers[i]::BIGINT - page) AS low, max(numbers[i]::BIGINT - page) AS high, count(DISTINCT list_filter(numbers, lambda x, j: j <> i)) AS others FROM k, LATERAL (SELECT unnest(range(1, len(numbers) + 1)) AS i) GROUP BY ALL),
 f AS (SELECT book, key, min(i) AS i FROM d WHERE low = high AND low > 0 AND others <= 1 GROUP BY ALL)
 SELECT p.book, p.key, on_pages, pages, first > first_page AS skips_first, f.i AS number, CASE WHEN f.i IS NULL THEN 0 ELSE d.low + first_page END AS starts_at FROM p LEFT JOIN f USING (book, key) LEFT JOIN d ON d.book = f.book AND d.key = f.key AND d.i = f.i""")
def running_head_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running heads of books of 20 documents: once a page, on three quarters of the pages, and which number counts pages.

    Of a head's numbers the first that goes up with the pages is the page number, if no other varies.
    """
    i = F.col("doc_id")
    book = F.floor(i / 20)
    made = F.concat(F.lit("Report 2024 on "), F.char((65 + book % 26).cast("int")), F.lit(", page "), (i % 20 + 3 + F.when(book % 5 == 4, i % 3).otherwise(0)).cast("string"))
    n = table(spark, sf_dir, "documents").select(book.alias("book"), (i % 20).alias("page"), F.trim(F.when(i % 7 < 6, made).otherwise(F.element_at(F.split("text", "\n"), 1))).alias("head"))
    b = n.groupBy("book").agg(F.count("*").alias("pages"), (F.max("page") - F.min("page") + 1 == F.count("*")).alias("whole"), F.min("page").alias("first_page"))
    k = n.where(F.char_length("head").between(1, 120)).select("book", "page", F.replace(F.regexp_replace("head", r"\d+", "#"), F.lit("  "), F.lit(" ")).alias("key"), F.regexp_extract_all("head", F.lit(r"\d{1,9}"), 0).alias("numbers"))
    c = k.groupBy("book", "key").agg(F.count("*").alias("lines"), F.count_distinct("page").alias("on_pages"), F.min("page").alias("first"))
    p = c.join(b, "book").where("pages >= 4 and whole and lines = on_pages and on_pages >= greatest(3, ceil(0.75D * pages))")
    at = k.select("book", "key", "page", F.posexplode("numbers").alias("i", "x"), "numbers")
    others = F.expr("filter(numbers, (v, j) -> j <> i)")
    d = at.groupBy("book", "key", "i").agg(F.min(F.col("x").cast("long") - F.col("page")).alias("low"), F.max(F.col("x").cast("long") - F.col("page")).alias("high"), F.count_distinct(others).alias("others"))
    f = d.where("low = high and low > 0 and others <= 1").groupBy("book", "key").agg(F.min(F.struct("i", "low")).alias("f"))
    return p.join(f, ["book", "key"], "left").select("book", "key", "on_pages", "pages", (F.col("first") > F.col("first_page")).alias("skips_first"), (F.col("f.i") + 1).cast("long").alias("number"), F.coalesce(F.col("f.low") + F.col("first_page"), F.lit(0)).alias("starts_at"))


@query("WITH h AS (SELECT user_id AS head, event_id % 12 AS page, event_id * 7 % 40 AS b FROM events WHERE event_type <> 'error'), r AS (SELECT event_id % 12 AS page, event_id * 11 % 120 AS t FROM events WHERE event_type = 'error'), g AS (SELECT h.head, h.page, h.b, min(r.t - h.b) AS gap FROM h LEFT JOIN r ON r.page = h.page AND r.t - h.b BETWEEN 0 AND 18 GROUP BY ALL) SELECT head, count(*) AS samples, count(gap) AS ruled, min(gap) AS gap FROM g GROUP BY head HAVING 10 * count(gap) >= 8 * count(*)")
def head_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running heads with a rule within 18 units below them on eight of ten samples."""
    e = table(spark, sf_dir, "events")
    h = e.where("event_type <> 'error'").selectExpr("user_id as head", "event_id % 12 as page", "event_id * 7 % 40 as b").distinct()
    r = e.where("event_type = 'error'").selectExpr("event_id % 12 as page", "event_id * 11 % 120 as t").distinct()
    # A rule stands at most 18 below: heads meet rules by page and by bands of 18 units, their own and the next.
    banded = h.withColumn("band", F.explode(F.array(F.floor(F.col("b") / 18), F.floor(F.col("b") / 18) + 1))).join(r.withColumn("band", F.floor(F.col("t") / 18)), ["page", "band"]).where("t - b between 0 and 18")
    near = banded.groupBy("head", "page", "b").agg(F.min(F.col("t") - F.col("b")).alias("gap"))
    found = h.join(near, ["head", "page", "b"], "left").groupBy("head").agg(F.count("*").alias("samples"), F.count("gap").alias("ruled"), F.min("gap").alias("gap"))
    return found.where("10 * ruled >= 8 * samples")


@query(f"SELECT m.doc_id, m.left_margin, m.right_edge, m.n_lines, s.body_size, s.weight, d.style, d.dominant, g.gap AS paragraph_gap, coalesce(h.levels, 0) AS heading_levels FROM ({SQL['margins']}) m LEFT JOIN ({SQL['body_size_mode']}) s USING (doc_id) LEFT JOIN ({SQL['dominant_style']}) d USING (doc_id) LEFT JOIN (WITH {LINES_SQL}, g AS (SELECT doc_id, length(text) % 4 AS gap FROM lines), n AS (SELECT doc_id, count(*) AS n, list_sort(list(gap) FILTER (gap > 0)) AS gaps FROM g GROUP BY doc_id) SELECT doc_id, CASE WHEN 2 * len(gaps) > n THEN gaps[len(gaps) // 2 + 1] END AS gap FROM n) g USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS levels FROM ({SQL['heading_sizes']}) GROUP BY doc_id) h USING (doc_id)")
def document_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that is measured of a document before its pages are composed, in one row."""
    from pagequarry.plans.tables import paragraph_gap

    m = statistics.margins(spark, sf_dir)
    parts = [statistics.body_size_mode(spark, sf_dir), statistics.dominant_style(spark, sf_dir).drop("n_lines"), paragraph_gap(spark, sf_dir).withColumnRenamed("gap", "paragraph_gap"), statistics.heading_sizes(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("heading_levels"))]
    for part in parts:
        m = m.join(part, "doc_id", "left")
    return m.select("doc_id", "left_margin", "right_edge", "n_lines", "body_size", "weight", "style", "dominant", "paragraph_gap", F.coalesce("heading_levels", F.lit(0)).alias("heading_levels"))
