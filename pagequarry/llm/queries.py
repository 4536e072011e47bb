"""The queries of the operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm import byte_bpe, conversations, fingerprints, html_text, jaccard, language, minhash, packing, periodic_runs, quality, substring_dedup, token_output, topk
from pagequarry.llm.common import held_out, table


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with a Jaccard of 0.9 or more on three-word shingles."""
    return jaccard.join(table(spark, sf_dir, "documents"), jaccard.Measure(words=3, num=90, den=100))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written, read back and digested."""
    return token_output.read_tokens(spark, token_output.write_tokens(table(spark, sf_dir, "documents")), digest=True)


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best candidates of every query vector, by exact integer inner product."""
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by a model of the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    found = language.predicted(docs.select("doc_id", "text"), language.fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every document."""
    return byte_bpe.encode(table(spark, sf_dir, "documents"), form=byte_bpe.Digests)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that an earlier document has, and the spans removed."""
    found = substring_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text", F.char_length("text").cast("long").alias("n_chars"), "removed_spans")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, by a model of the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    found = quality.scored(docs.select("doc_id", "text"), quality.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_predicted").alias("predicted"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints.digests(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of at most 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document, some of them with a planted one, and the texts without the repeats."""
    return periodic_runs.digests(periodic_runs.with_planted_runs(table(spark, sf_dir, "documents")))


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of documents: a Jaccard of 0.8 or more on four-word shingles."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), jaccard.Measure(words=4, num=80, den=100))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The faults of every conversation after damage, and its cheapest repair."""
    turns = table(spark, sf_dir, "conversations")
    return conversations.repair(conversations.damaged(turns), turns)


QUERIES = {f.__name__: f for f in (op1_jaccard_join, op2_token_output, op3_topk_search, op4_language_id, op5_byte_bpe, op6_substring_dedup, op7_quality, op8_html_extraction, op9_fingerprints, op10_packing, op11_periodic_runs, op12_minhash_dedup, op13_conversation_repair)}

_TOP_K = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT q.vec_id AS query_id, (row_number() OVER (PARTITION BY q.r ORDER BY list_dot_product(q.v, d.v) DESC, d.vec_id))::INT AS rank, d.vec_id, list_dot_product(q.v, d.v)::BIGINT AS score
FROM v q JOIN v d ON q.vec_id <> d.vec_id AND len(q.v) = len(d.v) WHERE q.vec_id % 20 = 0 QUALIFY rank <= 20"""

#: Components of documents by their shingles of several words, from a Jaccard of some hundredths on.
_COMPONENTS = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {words} THEN list_transform(range(1, len(w) - {words} + 2), lambda i: array_to_string(w[i:i + {words} - 1], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * k >= {num} * (a.n + b.n - k)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce((SELECT min(v) FROM r WHERE r.u = w.doc_id), w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id)"""

#: What DuckDB can say over the same tables; models, tokenizers and hashes of Spark's own it cannot.
SQL: dict[str, str] = {
    "op1_jaccard_join": _COMPONENTS.format(words=3, num=90),
    "op3_topk_search": _TOP_K,
    "op12_minhash_dedup": f"SELECT *, doc_id = component_id AS kept FROM ({_COMPONENTS.format(words=4, num=80)})",
}
