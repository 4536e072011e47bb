"""Pages composed into paragraphs, headings, lists, and joins over pages.

Rows of 90 characters stand for a page's lines; their places and styles follow from their
numbers, so that every rule of grouping has lines to decide on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagequarry.operators import paragraphs as p
from pagequarry.plans.registry import query
from pagequarry.sources.views import LINES_A_PAGE, LINES_SQL, ROW, table

WIDTH, CHAR, BODY = 900, 10, 11


def page_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, page, rows``: every page's rows with place and style, in order, without a shuffle."""
    cut = f"transform(sequence(0, cast((size(l) - 1) div {LINES_A_PAGE} as int)), k -> slice(transform(l, (x, i) -> struct(cast(i as bigint) as line, x as text)), k * {LINES_A_PAGE} + 1, {LINES_A_PAGE}))"
    pages = docs.where("text is not null").select("doc_id", F.split("text", "\n", -1).alias("l")).select("doc_id", F.posexplode(F.expr(cut)).alias("page", "l"))
    each = f"flatten(transform(l, x -> transform(sequence(0, greatest(cast(ceil(char_length(x.text) / {ROW}.0) as int) - 1, 0)), k -> struct(x.line as line, k as row, concat(if(k = 0 and x.line % 19 in (5, 6), '• ', if(k = 0 and x.line % 41 = 3, '2. ', '')), substring(x.text, k * {ROW} + 1, {ROW})) as text))))"
    return pages.select("doc_id", F.col("page").cast("long").alias("page"), F.transform(F.expr(each), _placed).alias("rows"))


def _placed(x: Column, n: Column) -> Column:
    line, row, text = x["line"], x["row"], x["text"]
    wide = CHAR * F.char_length(text)
    left = F.when((line % 7 == 3) & (row == 0), 40).when(line % 31 == 12, F.floor((WIDTH - wide) / 2)).when(line % 37 == 9, WIDTH - wide).otherwise(F.when((line % 19).isin(5, 6) & (row > 0), 20).otherwise(0)).cast("int")
    top = (16 * n + 10 * F.floor(line / 5)).cast("int")
    marker = F.regexp_extract(text, f"{p.BULLET}|{p.MAYBE_BULLET}|{p.NUMBER}", 0)
    item = text.rlike(p.BULLET) | text.rlike(p.NUMBER)
    return F.struct(
        line.alias("line"), row.alias("row"), text.alias("text"), left.alias("l"), (left + wide).alias("r"), top.alias("t"), (top + 12).alias("b"),
        F.when(line % 13 == 6, 14).otherwise(BODY).alias("size"), (line % 11 == 4).alias("bold"), (line % 17).isin(8, 9).alias("mono"),
        ((line % 23 == 7) & (row == 0)).alias("parted"), (line % 29 == 11).alias("leader"),
        (CHAR * F.char_length(F.element_at(F.split(F.ltrim(text), " "), 1))).alias("fw"), item.alias("item"),
        F.when(marker != "", left + CHAR * F.char_length(marker)).cast("int").alias("hang"),
    )


_ROWS_SQL = f"""{LINES_SQL},
 cut AS (SELECT doc_id, page, line, k AS row, CASE WHEN k = 0 AND line % 19 IN (5, 6) THEN '• ' WHEN k = 0 AND line % 41 = 3 THEN '2. ' ELSE '' END || substring(text, k * {ROW} + 1, {ROW}) AS text FROM lines, LATERAL (SELECT unnest(range(greatest(CAST(ceil(length(text) / {ROW}.0) AS BIGINT), 1))) AS k)),
 num AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY line, row) - 1 AS n, {CHAR} * length(text) AS wide FROM cut),
 pos AS (SELECT *, CASE WHEN line % 7 = 3 AND row = 0 THEN 40 WHEN line % 31 = 12 THEN CAST(floor(({WIDTH} - wide) / 2) AS BIGINT) WHEN line % 37 = 9 THEN {WIDTH} - wide WHEN line % 19 IN (5, 6) AND row > 0 THEN 20 ELSE 0 END AS l, 16 * n + 10 * (line // 5) AS t FROM num),
 rws AS (SELECT doc_id, page, n, line, row, text, l, l + wide AS r, t, t + 12 AS b, CASE WHEN line % 13 = 6 THEN 14 ELSE {BODY} END AS size, line % 11 = 4 AS bold, line % 17 IN (8, 9) AS mono, line % 23 = 7 AND row = 0 AS parted, line % 29 = 11 AS leader,
  {CHAR} * length(string_split(ltrim(text), ' ')[1]) AS fw, regexp_matches(text, '{p.BULLET}') OR regexp_matches(text, '{p.NUMBER}') AS item,
  CASE WHEN regexp_matches(text, '{p.BULLET}|{p.MAYBE_BULLET}|{p.NUMBER}') THEN l + {CHAR} * length(regexp_extract(text, '{p.BULLET}|{p.MAYBE_BULLET}|{p.NUMBER}', 0)) END AS hang FROM pos),
 gaps AS (SELECT doc_id, page, CASE WHEN t > lag(b) OVER w AND least(r, lag(r) OVER w) > greatest(l, lag(l) OVER w) THEN t - lag(b) OVER w END AS g FROM rws WINDOW w AS (PARTITION BY doc_id, page ORDER BY n)),
 med AS (SELECT doc_id, page, coalesce(list_sort(list(g) FILTER (g IS NOT NULL))[(count(g) - 1) // 2 + 1], 0) AS gap FROM gaps GROUP BY ALL),
 fold AS (
  SELECT r.*, m.gap, true AS fresh, l AS low, r AS high, l AS first_l, hang AS at, 50 * abs(l - ({WIDTH} - r)) <= {WIDTH} AS even, l AS inset FROM rws r JOIN med m USING (doc_id, page) WHERE n = 0
  UNION ALL
  SELECT x.*, f.gap, f.fresh,
   CASE WHEN f.fresh THEN x.l ELSE least(f.low, x.l) END, CASE WHEN f.fresh THEN x.r ELSE greatest(f.high, x.r) END, CASE WHEN f.fresh THEN x.l ELSE f.first_l END, CASE WHEN f.fresh THEN x.hang ELSE f.at END,
   (f.fresh OR f.even) AND 50 * abs(x.l - ({WIDTH} - x.r)) <= {WIDTH}, CASE WHEN f.fresh THEN x.l ELSE greatest(f.inset, x.l) END
  FROM (SELECT p.doc_id, p.page, p.n, p.gap, p.low, p.high, p.first_l, p.at, p.even, p.inset,
    CASE WHEN p.mono <> y.mono THEN true
     WHEN y.mono THEN 100 * (y.t - p.b) > {p.CODE_GAP} * (p.b - p.t) OR 2 * abs(p.size - y.size) > 1
     WHEN y.item OR y.parted OR p.leader THEN true
     WHEN 100 * (y.t - p.b) > CASE WHEN p.gap > 0 THEN greatest({p.PARAGRAPH_GAP} * p.gap, 100 * p.gap + 35 * (p.b - p.t)) ELSE 50 * (p.b - p.t) END THEN true
     WHEN 25 * abs(p.size - y.size) > 2 * p.size OR p.bold <> y.bold THEN true
     WHEN p.l <= {max(WIDTH * p.SHORT_LINE // 1000, 2 * CHAR)} AND ({WIDTH} - p.r) * 10 > y.fw * 10 + {6 * CHAR} THEN true
     WHEN p.l <= {max(WIDTH * p.SHORT_LINE // 1000, 2 * CHAR)} AND 100 * ({WIDTH} - p.r) > 35 * {WIDTH} AND 10 * y.fw >= 9 * (y.r - y.l) AND 10 * (y.r - y.l) >= 9 * {WIDTH} THEN true
     WHEN p.l > {max(WIDTH * p.SHORT_LINE // 1000, 2 * CHAR)} AND abs(p.l - y.l) * 10 <= greatest(3 * (p.b - p.t), 20) AND abs(p.l - p.first_l) * 10 <= greatest(3 * (p.b - p.t), 20) AND 10 * (greatest(p.high, y.r) - p.r) > y.fw * 10 + {6 * CHAR} THEN true
     WHEN p.l > {max(WIDTH * p.SHORT_LINE // 1000, 2 * CHAR)} AND NOT (abs(p.l - y.l) * 10 <= greatest(3 * (p.b - p.t), 20) AND abs(p.l - p.first_l) * 10 <= greatest(3 * (p.b - p.t), 20)) AND coalesce(abs(y.l - p.at) * 10 <= greatest(5 * (p.b - p.t), {10 * CHAR}), false)
      AND (({WIDTH} - p.r) * 10 > y.fw * 10 + {6 * CHAR} OR 100 * ({WIDTH} - p.r) > 35 * {WIDTH} AND 10 * y.fw >= 9 * (y.r - y.l) AND 10 * (y.r - y.l) >= 9 * {WIDTH}) THEN true
     WHEN p.l > {max(WIDTH * p.SHORT_LINE // 1000, 2 * CHAR)} AND NOT (abs(p.l - y.l) * 10 <= greatest(3 * (p.b - p.t), 20) AND abs(p.l - p.first_l) * 10 <= greatest(3 * (p.b - p.t), 20)) AND NOT coalesce(abs(y.l - p.at) * 10 <= greatest(5 * (p.b - p.t), {10 * CHAR}), false)
      AND 25 * p.l > {WIDTH} AND 25 * ({WIDTH} - p.r) > {WIDTH} AND 50 * abs(p.l - ({WIDTH} - p.r)) <= {WIDTH} AND 10 * ({WIDTH} - (p.r - p.l)) > y.fw * 10 + {6 * CHAR} THEN true
     ELSE 10 * y.l > 10 * p.low + 7 * (p.b - p.t) AND NOT (p.even AND 50 * abs(y.l - ({WIDTH} - y.r)) <= {WIDTH} AND greatest(p.inset, y.l) * 200 > 3 * {WIDTH}) AND NOT coalesce(abs(y.l - p.at) * 10 <= greatest(5 * (p.b - p.t), {10 * CHAR}), false) END AS fresh
   FROM fold p JOIN rws y ON y.doc_id = p.doc_id AND y.page = p.page AND y.n = p.n + 1) f
  JOIN rws x ON x.doc_id = f.doc_id AND x.page = f.page AND x.n = f.n + 1),
 para AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY n) AS para FROM fold)"""


def composed(docs: DataFrame) -> DataFrame:
    """``doc_id, page, para, lines``: paragraphs of every page, from 1, each with its lines; no shuffle."""
    pages = page_rows(docs).withColumn("starts", p.starts(F.col("rows"), p.median_gap(F.col("rows")), WIDTH, CHAR))
    firsts = F.expr("filter(transform(starts, (s, i) -> if(s, i + 1, 0)), i -> i > 0)")
    cut = F.expr("transform(firsts, (a, k) -> slice(rows, a, if(k + 1 < size(firsts), firsts[k + 1], size(rows) + 1) - a))")
    each = pages.withColumn("firsts", firsts).select("doc_id", "page", F.posexplode(cut).alias("para", "lines"))
    return each.select("doc_id", "page", (F.col("para") + 1).cast("long").alias("para"), "lines")


def _of(name: str, f) -> Column:
    return f(F.transform("lines", lambda x: x[name])).cast("long")


@query(f"WITH RECURSIVE {_ROWS_SQL} SELECT doc_id, page, CAST(para AS BIGINT) AS para, min(line) AS first_line, count(*) AS n_lines, CAST(min(l) AS BIGINT) AS l, CAST(min(t) AS BIGINT) AS t, CAST(max(r) AS BIGINT) AS r, CAST(max(b) AS BIGINT) AS b, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM para GROUP BY doc_id, page, para")
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every page grouped into paragraphs by all rules, with bounds."""
    n_chars = F.aggregate(F.transform("lines", lambda x: F.char_length(x["text"])), F.lit(0), lambda a, b: a + b).cast("long")
    return composed(table(spark, sf_dir, "documents")).select("doc_id", "page", "para", _of("line", F.array_min).alias("first_line"), F.size("lines").cast("long").alias("n_lines"), _of("l", F.array_min).alias("l"), _of("t", F.array_min).alias("t"), _of("r", F.array_max).alias("r"), _of("b", F.array_max).alias("b"), n_chars.alias("n_chars"))


_SLACK, _EVEN = WIDTH * 15 // 1000, WIDTH * 2 // 100
_ALIGNED_SQL = f"""{_ROWS_SQL},
 ends AS (SELECT *, n = max(n) OVER (PARTITION BY doc_id, page, para) AS last FROM para),
 al AS (SELECT doc_id, page, para, count(*) AS k, bool_and(abs(l) <= {_SLACK}) AS lf, bool_and(abs({WIDTH} - r) <= {_SLACK}) AS rf, bool_and(abs(l) <= {_SLACK} AND abs({WIDTH} - r) <= {_SLACK}) FILTER (NOT last) AS inner_flush,
  bool_and(abs(l - ({WIDTH} - r)) <= {_EVEN}) AS even, min(l) FILTER (l > {_SLACK} AND {WIDTH} - r > {_SLACK}) AS inset, max(l) - min(l) AS spread, bool_or(leader) AS leader, bool_or(parted) AS parted, bool_and(bold) AS bold, bool_or(mono) AS mono, max(size) AS size, string_agg(text, ' ' ORDER BY n) AS text, arg_min(text, n) AS head, min(l) AS l, arg_min(l, n) AS first_l, min(l) FILTER (n > start) AS rest_l
  FROM (SELECT *, min(n) OVER (PARTITION BY doc_id, page, para) AS start FROM ends) GROUP BY doc_id, page, para),
 kinds AS (SELECT *, CASE WHEN regexp_matches(head, '{p.BULLET}') THEN 'bullet' WHEN regexp_matches(head, '{p.MAYBE_BULLET}') THEN 'maybe' WHEN regexp_matches(head, '{p.NUMBER}') THEN 'number' ELSE 'text' END AS kind FROM al),
 aligned AS (SELECT *, CASE WHEN lf AND rf AND k > 1 OR k > 2 AND inner_flush THEN 'justify' WHEN lf OR kind <> 'text' OR leader THEN 'left' WHEN even AND inset IS NOT NULL AND (k > 1 AND spread > {_SLACK} OR inset * 100 > CASE WHEN k > 1 THEN 8 ELSE 4 END * {WIDTH}) THEN 'center' WHEN rf THEN 'right' ELSE 'left' END AS alignment FROM kinds)"""


@query(f"WITH RECURSIVE {_ALIGNED_SQL} SELECT doc_id, page, CAST(para AS BIGINT) AS para, alignment FROM aligned")
def paragraph_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How paragraphs are set: justified, left, centred or right."""
    return composed(table(spark, sf_dir, "documents")).select("doc_id", "page", "para", p.alignment(F.col("lines"), WIDTH).alias("alignment"))


def structured(docs: DataFrame) -> DataFrame:
    """Paragraphs with ``text``, list ``kind``, whether it is corroborated (``listed``), its level, and heading level."""
    of = lambda c, f: f(F.transform("lines", lambda x: x[c]))
    every = F.forall("lines", lambda x: x["bold"])
    some = lambda c: F.exists("lines", lambda x: x[c])
    head = F.col("lines")[0]
    each = composed(docs).select("doc_id", "page", "para", F.size("lines").alias("k"), F.array_join(F.transform("lines", lambda x: x["text"]), " ").alias("text"), p.list_kind(head["text"]).alias("kind"), some("leader").alias("leader"), some("parted").alias("parted"), some("mono").alias("mono"), every.alias("bold"), of("size", F.array_max).alias("size"), of("l", F.array_min).alias("l"), head["l"].alias("first_l"), head["text"].alias("head"), F.array_min(F.transform(F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0))), lambda x: x["l"])).alias("rest_l"))
    each = each.withColumn("kind", F.when(F.col("leader") | F.col("mono"), "text").otherwise(F.col("kind")))
    over = Window.partitionBy("doc_id", "page").orderBy("para")
    same = lambda c: F.coalesce(F.regexp_replace(c, "maybe", "bullet") == F.regexp_replace("kind", "maybe", "bullet"), F.lit(False))
    near = each.withColumn("p", F.lag("kind").over(over)).withColumn("q", F.lead("kind").over(over))
    hanging = F.coalesce(F.col("rest_l") > F.col("first_l") + 3, F.lit(False))
    listed = (F.col("kind") != "text") & ((F.col("kind") == "bullet") | same(F.col("p")) | same(F.col("q")) | hanging)
    near = near.withColumn("listed", listed).withColumn("level", F.least(F.greatest(F.bround(F.col("l") / 31.5), F.lit(0)), F.lit(4)).cast("int"))
    n = F.char_length("text")
    large, tight = 100 * F.col("size") >= 112 * BODY, F.col("bold") & (100 * F.col("size") >= 97 * BODY) & (n <= 120)
    plain = ~F.col("listed") & ~F.col("mono") & ~F.col("leader") & ~F.col("parted") & (F.col("k") <= 3) & n.between(1, 200) & ~(F.endswith("text", F.lit(".")) & (n > 60))
    return near.withColumn("heading", F.when(plain & large, 1).when(plain & tight, 4).otherwise(0))


_STRUCTURE_SQL = f"""{_ALIGNED_SQL},
 ks AS (SELECT *, CASE WHEN leader OR mono THEN 'text' ELSE kind END AS kd FROM aligned),
 nb AS (SELECT *, lag(kd) OVER w AS pk, lead(kd) OVER w AS nk FROM ks WINDOW w AS (PARTITION BY doc_id, page ORDER BY para)),
 ls AS (SELECT *, kd <> 'text' AND (kd = 'bullet' OR coalesce(replace(pk, 'maybe', 'bullet') = replace(kd, 'maybe', 'bullet'), false) OR coalesce(replace(nk, 'maybe', 'bullet') = replace(kd, 'maybe', 'bullet'), false) OR coalesce(rest_l > first_l + 3, false)) AS listed, length(text) AS n FROM nb),
 st AS (SELECT *, CASE WHEN listed OR mono OR leader OR parted OR k > 3 OR n NOT BETWEEN 1 AND 200 OR ends_with(text, '.') AND n > 60 THEN 0 WHEN 100 * size >= {112 * BODY} THEN 1 WHEN bold AND 100 * size >= {97 * BODY} AND n <= 120 THEN 4 ELSE 0 END AS heading FROM ls)"""


@query(f"WITH RECURSIVE {_STRUCTURE_SQL} SELECT doc_id, page, CAST(para AS BIGINT) AS para, heading FROM st WHERE heading > 0")
def paragraph_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs that are headings, with their level."""
    return structured(table(spark, sf_dir, "documents")).where("heading > 0").select("doc_id", "page", "para", "heading")


@query(f"WITH RECURSIVE {_STRUCTURE_SQL} SELECT doc_id, page, CAST(para AS BIGINT) AS para, kd AS kind, listed, CAST(least(greatest(round_even(l / 31.5, 0), 0), 4) AS INT) AS level FROM st WHERE kd <> 'text'")
def paragraph_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs with a list marker: whether they are items of a list, and how deep."""
    return structured(table(spark, sf_dir, "documents")).where("kind <> 'text'").select("doc_id", "page", "para", "kind", "listed", "level")


@query(f"""WITH RECURSIVE {_STRUCTURE_SQL}, e AS (SELECT doc_id, page, arg_min(text, para) AS head, arg_max(text, para) AS tail, arg_min(heading = 0 AND NOT listed, para) AS head_body, arg_max(heading = 0 AND NOT listed, para) AS tail_body FROM st GROUP BY ALL),
 j AS (SELECT doc_id, page, coalesce(lag(tail_body) OVER w AND head_body AND lag(page) OVER w = page - 1 AND NOT regexp_matches(rtrim(lag(tail) OVER w), '[.!?:;"”]$') AND length(trim(lag(tail) OVER w)) > 0 AND regexp_matches(ltrim(head), '^[\\p{{Ll}},;]'), false) AS joined FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY page))
 SELECT doc_id, CAST(sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY page) AS BIGINT) AS chain, page, joined FROM j""")
def cross_page_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a page's first paragraph goes on from the page before, and chains of such pages."""
    place = F.struct("para", "text", ((F.col("heading") == 0) & ~F.col("listed")).alias("body"))
    e = structured(table(spark, sf_dir, "documents")).groupBy("doc_id", "page").agg(F.min(place).alias("head"), F.max(place).alias("tail"))
    over = Window.partitionBy("doc_id").orderBy("page")
    before = F.lag("tail").over(over)
    e = e.withColumn("before", before).withColumn("near", F.lag("page").over(over) == F.col("page") - 1)
    tail, head = F.rtrim("before.text"), F.ltrim("head.text")
    joined = F.col("before.body") & F.col("head.body") & F.col("near") & ~tail.rlike('[.!?:;"”]$') & (F.char_length(F.trim(tail)) > 0) & head.rlike(r"^[\p{Ll},;]")
    j = e.withColumn("joined", F.coalesce(joined, F.lit(False)))
    return j.select("doc_id", F.sum(F.when(F.col("joined"), 0).otherwise(1)).over(over).alias("chain"), "page", "joined")


@query(f"""WITH RECURSIVE {_STRUCTURE_SQL}, e AS (SELECT doc_id, page, count(*) AS k, arg_min(heading, para) AS opens, (page * 37 + doc_id) % 200 AS top FROM st GROUP BY doc_id, page),
 s AS (SELECT *, least(top + 12 * k, 840) AS bottom FROM e), q AS (SELECT *, lag(page) OVER w AS pp, lag(bottom) OVER w AS pb, lag(top) OVER w AS pt FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY page))
 SELECT doc_id, page, pp IS NOT NULL AND coalesce(pp <> page - 1 OR 100 * (840 - pb) >= 22 * 840 OR 100 * top >= 15 * 840 OR 100 * (840 - pb) >= 8 * 840 AND 100 * (840 - pb + pt) >= 25 * 840 OR 100 * (840 - pb) >= 3 * 840 AND opens = 1, false) AS new_page FROM q""")
def page_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that start anew: room left before, text set low, both together, or a chapter's heading."""
    opens = F.min_by("heading", "para")
    e = structured(table(spark, sf_dir, "documents")).groupBy("doc_id", "page").agg(F.count("*").alias("k"), opens.alias("opens")).withColumn("top", (F.col("page") * 37 + F.col("doc_id")) % 200).withColumn("bottom", F.least(F.col("top") + 12 * F.col("k"), F.lit(840)))
    over, area = Window.partitionBy("doc_id").orderBy("page"), 840
    q = e.withColumn("pp", F.lag("page").over(over)).withColumn("free", area - F.lag("bottom").over(over)).withColumn("drop", F.lag("top").over(over))
    gap, low = F.col("pp") != F.col("page") - 1, 100 * F.col("top") >= 15 * area
    room = (100 * F.col("free") >= 22 * area) | ((100 * F.col("free") >= 8 * area) & (100 * (F.col("free") + F.col("drop")) >= 25 * area)) | ((100 * F.col("free") >= 3 * area) & (F.col("opens") == 1))
    return q.select("doc_id", "page", F.coalesce(F.when(F.col("pp").isNotNull(), gap | room | low), F.lit(False)).alias("new_page"))
