"""Search, selection and text access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagequarry.functions.search import SOFT, pattern
from pagequarry.functions.text import MIN_VISIBLE, WORD, matches, visible_chars
from pagequarry.plans.registry import query
from pagequarry.sources.views import LINES_A_PAGE, LINES_SQL, lines, table

TERM, CONTEXT, MOST_HITS = "thing", 40, 5_000
BETWEEN = r"[\p{L}\p{Nd}]"


def page_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, page, text``: every page as one text, without a shuffle."""
    cut = f"transform(sequence(0, cast((size(l) - 1) div {LINES_A_PAGE} as int)), k -> array_join(slice(l, k * {LINES_A_PAGE} + 1, {LINES_A_PAGE}), '\\n'))"
    pages = docs.where("text is not null").select("doc_id", F.split("text", "\n", -1).alias("l")).select("doc_id", F.posexplode(F.expr(cut)).alias("page", "text"))
    return pages.select("doc_id", F.col("page").cast("long").alias("page"), "text")


def collapsed(text: Column) -> Column:
    """Runs of white space as one blank, soft hyphens dropped."""
    return F.regexp_replace(F.translate(text, SOFT, ""), r"\s+", " ")


#: Hits that are added up together; sums of sums give every hit's place.
_BLOCK = 64


def _before(k: Column, size: int) -> Column:
    """The last ``size`` code points before hit ``k``, out of the ends of what lies between hits."""
    pieces = F.transform(F.sequence(F.greatest(k - size, F.lit(0)), k), lambda j: F.concat(F.when(j > F.greatest(k - size, F.lit(0)), F.get("hits", j - 1)).otherwise(""), F.get("tails", j)))
    return F.when(F.char_length(F.get("tails", k)) >= size, F.get("tails", k)).otherwise(F.right(F.array_join(pieces, ""), F.lit(size)))


def _after(k: Column, size: int) -> Column:
    """The first ``size`` code points after hit ``k``."""
    last = F.least(k + 1 + size, F.size("gaps") - 1)
    pieces = F.transform(F.sequence(k + 1, last), lambda j: F.concat(F.get("heads", j), F.when(j < last, F.get("hits", j)).otherwise("")))
    return F.when(F.char_length(F.get("heads", k + 1)) >= size, F.get("heads", k + 1)).otherwise(F.left(F.array_join(pieces, ""), F.lit(size)))


def hits(docs: DataFrame, query: str = TERM, match_case: bool = False, whole_word: bool = False) -> DataFrame:
    """Every occurrence of ``query`` on a page: ``doc_id, page, start, length, before, hit, after``."""
    return page_hits(page_texts(docs), query, match_case, whole_word)


def page_hits(pages: DataFrame, query: str, match_case: bool = False, whole_word: bool = False) -> DataFrame:
    """``hits`` on pages that are given as ``doc_id, page, text``.

    Occurrences do not overlap; they may run over line breaks. A whole-word match has no letter or
    digit at either side, and one that has is skipped as a whole. The context is ``CONTEXT`` code
    points either side on the match's own lines, with an ellipsis where it is cut. A page is cut at
    its matches once; places are sums over the pieces and contexts come from the pieces' ends, so
    that time follows the text's length however long its lines are and however many hits it has.
    """
    find, size, n = F.lit(pattern(query, match_case)), CONTEXT + 1, F.size("hits")
    found = pages.where(F.col("text").rlike(pattern(query, match_case)))
    parts = found.select("doc_id", "page", F.regexp_extract_all("text", find, 0).alias("hits"), F.split("text", pattern(query, match_case), -1).alias("gaps"))
    parts = parts.withColumn("tails", F.transform("gaps", lambda g: F.right(g, F.lit(size)))).withColumn("heads", F.transform("gaps", lambda g: F.left(g, F.lit(size))))
    parts = parts.withColumn("steps", F.transform("hits", lambda h, k: (F.char_length(F.get("gaps", k)) + F.char_length(h)).cast("long")))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int")), lambda b: total(F.slice("steps", b * _BLOCK + 1, F.lit(_BLOCK))))
    empty = F.expr("cast(array() as array<bigint>)")
    parts = parts.withColumn("bases", F.aggregate(blocks, F.struct(empty.alias("done"), F.lit(0).cast("long").alias("at")), lambda acc, x: F.struct(F.concat(acc["done"], F.array(acc["at"])).alias("done"), (acc["at"] + x).alias("at")), lambda acc: acc["done"]))

    def hit(h: Column, k: Column) -> Column:
        block = F.floor(k / _BLOCK).cast("int")
        start = F.get("bases", block) + total(F.slice("steps", block * _BLOCK + 1, k % _BLOCK)) + F.char_length(F.get("gaps", k))
        return F.struct(start.alias("start"), F.char_length(h).cast("long").alias("length"), h.alias("hit"), _before(k, size).alias("left"), _after(k, size).alias("right"), *edges(k))

    def edges(k: Column) -> list[Column]:
        """The letters next to a hit, soft hyphens aside; where hits touch, the other hit's."""
        if not whole_word:
            return []
        bare = lambda j: F.translate(F.get("gaps", j), SOFT, "")
        last = F.when(bare(k) != "", F.right(bare(k), F.lit(1))).otherwise(F.right(F.coalesce(F.get("hits", k - 1), F.lit("")), F.lit(1)))
        first = F.when(bare(k + 1) != "", F.left(bare(k + 1), F.lit(1))).otherwise(F.left(F.coalesce(F.get("hits", k + 1), F.lit("")), F.lit(1)))
        return [last.alias("last"), first.alias("first")]

    at = parts.select("doc_id", "page", F.explode(F.transform("hits", hit)).alias("x")).select("doc_id", "page", "x.*")
    if whole_word:
        at = at.where(~F.col("last").rlike(BETWEEN) & ~F.col("first").rlike(BETWEEN))
    at = at.withColumn("own_left", F.substring_index("left", "\n", -1)).withColumn("own_right", F.substring_index("right", "\n", 1))
    before, after = collapsed(F.expr(f"right(own_left, {CONTEXT})")), collapsed(F.expr(f"left(own_right, {CONTEXT})"))
    return at.select(
        "doc_id", "page", "start", "length",
        F.when(F.char_length("own_left") > CONTEXT, F.concat(F.lit("…"), F.ltrim(before))).otherwise(before).alias("before"), collapsed(F.col("hit")).alias("hit"),
        F.when(F.char_length("own_right") > CONTEXT, F.concat(F.rtrim(after), F.lit("…"))).otherwise(after).alias("after"),
    )


PAGES_SQL = f"{LINES_SQL}, pg AS (SELECT doc_id, page, string_agg(text, chr(10) ORDER BY line) AS text FROM lines GROUP BY doc_id, page)"


def hits_sql(query: str, match_case: bool = False, whole_word: bool = False) -> str:
    find = pattern(query, match_case).replace("'", "''")
    words = f"WHERE NOT regexp_matches(lt, '[\\p{{L}}\\p{{Nd}}]$') AND NOT regexp_matches(rt, '^[\\p{{L}}\\p{{Nd}}]')" if whole_word else ""
    tidy = "regexp_replace(replace({}, chr(173), ''), '\\s+', ' ', 'g')"
    return f"""{PAGES_SQL},
 f AS (SELECT doc_id, page, text, regexp_extract_all(text, '{find}') AS m, string_split_regex(text, '{find}') AS g FROM pg WHERE regexp_matches(text, '{find}')),
 k AS (SELECT *, CAST(coalesce(list_sum(list_transform(g[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS start, m[k] AS hit FROM f, LATERAL (SELECT unnest(range(1, len(m) + 1)) AS k)),
 s AS (SELECT *, length(hit) AS n, substring(text, 1, start) AS lt, substring(text, start + length(hit) + 1) AS rt FROM k),
 o AS (SELECT *, regexp_extract(lt, '[^\n]*$') AS ol, regexp_extract(rt, '^[^\n]*') AS orr FROM s {words}),
 hits AS (SELECT doc_id, page, start, n AS length, CASE WHEN length(ol) > {CONTEXT} THEN '…' || ltrim({tidy.format(f"right(ol, {CONTEXT})")}) ELSE {tidy.format("ol")} END AS before, {tidy.format("hit")} AS hit, CASE WHEN length(orr) > {CONTEXT} THEN rtrim({tidy.format(f"left(orr, {CONTEXT})")}) || '…' ELSE {tidy.format("orr")} END AS after FROM o)"""


@query(f"WITH {hits_sql(TERM)} SELECT * FROM hits ORDER BY doc_id, page, start LIMIT {MOST_HITS}")
def search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 5,000 hits in page order, with their context; the limit is the feature's."""
    return hits(table(spark, sf_dir, "documents")).orderBy("doc_id", "page", "start").limit(MOST_HITS)


@query(f"WITH {hits_sql('of the')} SELECT * FROM hits")
def search_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase, also where its words stand on two lines."""
    return hits(table(spark, sf_dir, "documents"), "of  the ")


@query(f"WITH {hits_sql('ère')} SELECT doc_id, page, count(*) AS n_hits, count(DISTINCT hit) AS spellings FROM hits GROUP BY doc_id, page")
def search_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits a page whatever their case and accents, and how many spellings they have."""
    return hits(table(spark, sf_dir, "documents"), "ERE").groupBy("doc_id", "page").agg(F.count("*").alias("n_hits"), F.count_distinct("hit").alias("spellings"))


@query(f"WITH {hits_sql('The', match_case=True)} SELECT doc_id, page, start FROM hits")
def search_match_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of exactly these letters."""
    return hits(table(spark, sf_dir, "documents"), "The", match_case=True).select("doc_id", "page", "start")


@query(f"SELECT doc_id, CAST((length(lower(text)) - length(replace(lower(text), '{TERM}', ''))) // {len(TERM)} AS BIGINT) AS n_hits FROM documents WHERE contains(lower(text), '{TERM}')")
def search_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits a document, without positions."""
    docs = table(spark, sf_dir, "documents").withColumn("low", F.lower("text")).where(F.contains("low", F.lit(TERM)))
    return docs.select("doc_id", matches(F.col("low"), TERM).alias("n_hits"))


@query(f"WITH {hits_sql('the', whole_word=True)} SELECT doc_id, page, count(*) AS n_hits, min(start) AS first FROM hits GROUP BY doc_id, page")
def search_whole_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits a page that are words by themselves."""
    return hits(table(spark, sf_dir, "documents"), "the", whole_word=True).groupBy("doc_id", "page").agg(F.count("*").alias("n_hits"), F.min("start").alias("first"))


@query(f"WITH {LINES_SQL}, v AS (SELECT doc_id, page, CAST(sum(length(replace(text, ' ', ''))) AS BIGINT) AS visible FROM lines GROUP BY doc_id, page) SELECT doc_id, page, visible, visible < {MIN_VISIBLE} AS no_text FROM v")
def page_visible_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible code points of every page, and whether it counts as without text."""
    pages = lines(table(spark, sf_dir, "documents")).groupBy("doc_id", "page").agg(F.sum(visible_chars(F.col("text"))).cast("long").alias("visible"))
    return pages.withColumn("no_text", F.col("visible") < MIN_VISIBLE)


@query(f"SELECT doc_id, count(*) OVER () AS documents, length(regexp_replace(coalesce(text, ''), '\\s', '', 'g')) < {MIN_VISIBLE} AS no_text FROM documents")
def search_no_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents search can say nothing about, of how many."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", docs.agg(F.count("*")).scalar().alias("documents"), (visible_chars(F.coalesce("text", F.lit(""))) < MIN_VISIBLE).alias("no_text"))


@query(f"WITH {hits_sql(TERM)} SELECT doc_id, row_number() OVER w AS hit, count(*) OVER (PARTITION BY doc_id) AS of_hits, row_number() OVER w % count(*) OVER (PARTITION BY doc_id) + 1 AS next_hit, page, start FROM hits WINDOW w AS (PARTITION BY doc_id ORDER BY page, start)")
def search_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of each document in order, and the one that follows, around the end."""
    over = Window.partitionBy("doc_id")
    found = hits(table(spark, sf_dir, "documents")).select("doc_id", "page", "start")
    found = found.withColumn("hit", F.row_number().over(over.orderBy("page", "start")).cast("long")).withColumn("of_hits", F.count("*").over(over))
    return found.select("doc_id", "hit", "of_hits", (F.col("hit") % F.col("of_hits") + 1).alias("next_hit"), "page", "start")


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'known' WHEN length(regexp_replace(d.text, '\\s', '', 'g')) >= 8 THEN 'text' ELSE 'none' END AS source, CASE WHEN l.doc_id IS NOT NULL THEN '*' || d.text ELSE d.text END AS text FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def effective_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text to use: what is known for the document, else its own if it has enough; labels stand for the known (marked ``*``)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    known = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("known", F.lit(True))
    source = F.when(F.col("known"), "known").when(visible_chars(F.col("text")) >= MIN_VISIBLE, "text").otherwise("none")
    return docs.join(known, "doc_id", "left").select("doc_id", source.alias("source"), F.when(F.col("known"), F.concat(F.lit("*"), "text")).otherwise(F.col("text")).alias("text"))


@query(f"WITH {LINES_SQL}, w AS (SELECT doc_id, line, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_''’]+') AS w FROM lines) SELECT doc_id, line, CAST(len(w) AS BIGINT) AS n_words, w[1] AS first_word, CAST(list_max(list_transform(w, lambda x: length(x))) AS BIGINT) AS longest FROM w WHERE len(w) > 0")
def line_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word runs of every line."""
    words = lines(table(spark, sf_dir, "documents")).select("doc_id", "line", F.regexp_extract_all("text", F.lit(WORD), 0).alias("w")).where("size(w) > 0")
    return words.select("doc_id", "line", F.size("w").cast("long").alias("n_words"), F.col("w")[0].alias("first_word"), F.expr("array_max(transform(w, x -> char_length(x)))").cast("long").alias("longest"))


@query(f"WITH {LINES_SQL}, s AS (SELECT user_id AS doc_id, min(event_id) % 7 AS first_line, min(event_id) % 7 + count(*) AS last_line FROM events GROUP BY user_id) SELECT l.doc_id, count(*) AS n_lines, string_agg(l.text, chr(10) ORDER BY l.line) AS text FROM lines l JOIN s ON l.doc_id = s.doc_id AND l.line BETWEEN s.first_line AND s.last_line GROUP BY l.doc_id")
def selection_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected lines of each document as one text; events say what is selected."""
    spans = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc_id")).agg((F.min("event_id") % 7).alias("low"), (F.min("event_id") % 7 + F.count("*")).alias("high"))
    chosen = lines(table(spark, sf_dir, "documents")).join(spans, "doc_id").where("line between low and high")
    text = F.array_join(F.expr("transform(array_sort(collect_list(struct(line, text))), x -> x.text)"), "\n")
    return chosen.groupBy("doc_id").agg(F.count("*").alias("n_lines"), text.alias("text"))


@query(f"WITH {LINES_SQL} SELECT doc_id, page, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(length(text)) AS BIGINT) AS n_chars, md5(string_agg(text, chr(10) ORDER BY line)) AS digest FROM lines GROUP BY doc_id, page")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's whole text, as counts and a digest."""
    text = F.array_join(F.expr("transform(array_sort(collect_list(struct(line, text))), x -> x.text)"), "\n")
    pages = lines(table(spark, sf_dir, "documents")).groupBy("doc_id", "page")
    return pages.agg(F.count("*").alias("n_lines"), F.sum(F.char_length("text")).cast("long").alias("n_chars"), F.md5(text.cast("binary")).alias("digest"))
