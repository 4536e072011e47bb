"""An index for search as written tables: folded words, where they stand, and the texts of pages by shelves (G1, T4).

A search reads the vocabulary, the postings of the words that can be part of a hit, and the texts of the
pages that they lead to; no pattern runs over other texts. Shelves are partitions by hash, so that a few words or pages
read a few of them. A word that is on every page lies in many files.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.functions.search import SOFT, folded_query
from pagequarry.plans.search import page_hits

#: The tables; ``shelf`` comes last, as Spark reads partitions.
SCHEMAS = {
    "vocabulary": "word string, pages long, uses long, shelf int",
    "postings": "word string, doc_id long, page long, places array<int>, shelf int",
    "texts": "doc_id long, page long, text string, shelf int",
}
#: Partitions of each table, and parts of a word's postings.
SHELVES, PARTS = 16, 16


@cache
def _letters() -> tuple[str, str]:
    """Letters with marks, and the same without, by the rule that search folds by."""
    found = {}
    for code in range(0xC0, 0x2000):
        whole = unicodedata.normalize("NFD", chr(code))
        if len(whole) > 1 and all(map(unicodedata.combining, whole[1:])) and len(whole[0].lower()) == 1:
            found[chr(code)] = whole[0].lower()
    return "".join(found), "".join(found.values())


def folded(text: Column) -> Column:
    """Without case, marks and soft hyphens."""
    return F.translate(F.regexp_replace(F.lower(text), rf"[\p{{M}}{SOFT}]", ""), *_letters())


def folded_words(query: str) -> list[str]:
    whole = unicodedata.normalize("NFD", folded_query(query).lower())
    return "".join(c for c in whole if not unicodedata.combining(c)).split()


def _shelf(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SHELVES)).cast("int")


@dataclass(frozen=True)
class SearchIndex:
    """The tables of an index in a folder: ``vocabulary``, ``postings``, ``texts``."""

    spark: SparkSession
    folder: str

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}")

    def pages(self, query: str) -> DataFrame:
        """``doc_id, page`` of the pages that may have hits: their words hold the query's, next to each other and in order."""
        words = folded_words(query)
        found = None
        for i, word in enumerate(words):
            first, last = i == 0, i == len(words) - 1
            w = F.col("word")
            # A hit may begin within its first word and end within its last one.
            fits = F.contains(w, F.lit(word)) if first and last else F.endswith(w, F.lit(word)) if first else F.startswith(w, F.lit(word)) if last else w == word
            chosen = self._table("vocabulary").where(fits).select("shelf", "word")
            places = self._table("postings").join(chosen, ["shelf", "word"]).groupBy("doc_id", "page").agg(F.flatten(F.collect_list("places")).alias("next"))  # a page's words at most
            if found is None:
                found = places.withColumnRenamed("next", "places")
            else:
                met = F.array_intersect(F.transform("places", lambda x: x + 1), F.col("next"))
                found = found.join(places, ["doc_id", "page"]).select("doc_id", "page", met.alias("places")).where("size(places) > 0")
        return found.select("doc_id", "page")

    def hits(self, query: str, match_case: bool = False, whole_word: bool = False) -> DataFrame:
        """What ``search.hits`` finds in the documents that the index was made of."""
        if not folded_words(query):
            raise ValueError("a search needs a word")
        wanted = self.pages(query).withColumn("shelf", _shelf("doc_id", "page"))
        texts = self._table("texts").join(wanted, ["shelf", "doc_id", "page"], "left_semi").select("doc_id", "page", "text")
        return page_hits(texts, query, match_case, whole_word)

    def counts(self, query: str) -> DataFrame:
        """``word, pages, hits`` of the words that hold a query of one word, from the vocabulary alone."""
        return self._table("vocabulary").where(F.contains("word", F.lit(folded_words(query)[0]))).select("word", "pages", "uses")


def _places(batches):
    """A row a word of each page, with its places, out of ``doc_id, page, words``; a page's words are in one row, so that they meet here."""
    for batch in batches:
        lists = batch.column(2)
        counts = np.diff(lists.offsets.to_numpy())
        words = pc.dictionary_encode(lists.flatten())
        page, code = np.repeat(np.arange(len(counts)), counts), words.indices.to_numpy()
        at = (np.arange(len(page)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)
        order = np.lexsort((code, page))  # stable: places stay ascending
        page, code = page[order], code[order]
        first = np.flatnonzero((np.diff(page, prepend=-1) != 0) | (np.diff(code, prepend=-1) != 0))
        places = pa.ListArray.from_arrays(pa.array(np.append(first, len(page)), pa.int32()), pa.array(at[order]))
        rows = pa.array(page[first])
        yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(code[first])), batch.column(0).take(rows), batch.column(1).take(rows), places], ["word", "doc_id", "page", "places"])


def build(pages: DataFrame, folder: str) -> SearchIndex:
    """Write an index of ``doc_id, page, text``. Only words with their places are shuffled, once; texts are put on shelves where they are read."""
    index = SearchIndex(pages.sparkSession, folder)
    shelved = pages.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page").cast("long").alias("page"), "text").withColumn("shelf", _shelf("doc_id", "page"))
    shelved.write.partitionBy("shelf").parquet(f"{folder}/texts")
    each = index._table("texts").select("doc_id", "page", F.filter(F.split(folded(F.col("text")), r"\s+"), lambda w: w != "").alias("words"))
    postings = each.mapInArrow(_places, "word string, doc_id long, page long, places array<int>").withColumn("shelf", _shelf("word"))
    postings.repartition("shelf", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))).sortWithinPartitions("shelf", "word").write.partitionBy("shelf").parquet(f"{folder}/postings")
    uses = index._table("postings").groupBy("word").agg(F.count("*").alias("pages"), F.sum(F.size("places")).alias("uses")).withColumn("shelf", _shelf("word"))
    uses.write.parquet(f"{folder}/vocabulary")
    return index
