"""From raw documents to packed training sequences, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written as Parquet in
the shared folder and read again as the next stage's documents. All but the last keep the
columns of documents.

Defined cases, beside those of the operators: without a label every document passes the quality
stage, and without a known language every text with a letter passes the language stage; a row
with a null ``doc_id`` passes every filter that its text passes and is never a duplicate; of equal
rows and of ties between near copies one stays, that with the least ``doc_id``; a document whose
text the substring stage takes away wholly stays as an empty text; texts of any length are worked
on whole; extra columns pass through all stages but the last whatever their names; an empty table gives
an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm import jaccard, language, packing, quality, substring_dedup
from pagequarry.llm.common import dropped, table, written

#: Documents whose language is less sure are rejected, as are those without letters.
LEAST_LANGUAGE_SCORE = 0.5


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.scored(docs, quality.fit(docs, table(spark, sf_dir, "labels")), only_good=True)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    return language.predicted(docs, language.fit(docs), least_score=LEAST_LANGUAGE_SCORE)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard of 0.8 or more."""
    return jaccard.one_of_each(docs, jaccard.Measure(words=5, num=80, den=100))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has."""
    names, aside = docs.columns, f"aside_{uuid.uuid4().hex}"
    if "removed_spans" in names:  # a column of the documents' own steps aside
        docs = docs.withColumnRenamed("removed_spans", aside)
    cut = substring_dedup.dedup(docs).drop("removed_spans").withColumnRenamed(aside, "removed_spans").select(*[f"`{c}`" for c in names])
    return cut.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else cut


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality", good_quality),
    ("language", known_language),
    ("near_copies", one_of_near_copies),
    ("repeats", without_repeats),
    ("packing", packed),
]

#: SQL expresses neither the models nor the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name}")
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
