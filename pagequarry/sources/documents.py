"""Where documents come from: an interface for extractors, JSON read leniently, and caches of recognised pages.

An extractor turns a file's bytes into pages; a recogniser turns a page's pixels into words. Both
are given from outside, as functions that run where the bytes are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES = "path string, page int, width_pt double, height_pt double, text string, error string"
#: Words of a recognised page: text and box ``l, t, r, b`` in parts of the page.
WORDS = "array<struct<t:string,b:array<double>>>"
#: Fixed value: the version of cached pages that is read.
VERSION = 3

Extractor = Callable[[bytes], Iterable[tuple[float, float, str]]]


def extracted(files: DataFrame, extractor: Extractor) -> DataFrame:
    """Pages of ``files`` (``path``, ``content``) by an extractor of ``(width, height, text)``; failures are rows with their error."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                try:
                    rows = [(path, i, float(w), float(h), text, None) for i, (w, h, text) in enumerate(extractor(content.as_py()))]
                except Exception as e:  # noqa: BLE001  whatever a foreign parser raises is that file's error
                    rows.append((path, None, None, None, None, f"{type(e).__name__}: {e}"))
                if rows:
                    kinds = (pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in PAGES.split(", ")])

    return files.select("path", "content").mapInArrow(run, PAGES)


def read_documents(spark: SparkSession, folder: str, extractor: Extractor, pattern: str = "*") -> DataFrame:
    return extracted(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder), extractor)


def plain_text(content: bytes) -> list[tuple[float, float, str]]:
    """An extractor for text files: pages at form feeds, of a Letter page's size."""
    return [(612.0, 792.0, page) for page in content.decode("utf-8-sig").split("\f")]


def lenient_json(text: Column, schema: str) -> Column:
    """A stored record; null where it is broken, never an error."""
    return F.from_json(text, schema, {"mode": "PERMISSIVE", "allowComments": "true", "allowTrailingComma": "true"})


def cached_words(words: Column) -> Column:
    """Words as they are kept: boxes in five places."""
    return F.transform(words, lambda w: F.struct(w["t"].alias("t"), F.transform(w["b"], lambda x: F.bround(x, 5)).alias("b")))


def write_cache(pages: DataFrame, folder: str) -> None:
    """Recognised pages (``document_key, page, words``), by document; a document that comes again is replaced whole."""
    kept = pages.select("page", F.lit(VERSION).alias("version"), cached_words(F.col("words").cast(WORDS)).alias("words"), "document_key")
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("document_key").parquet(folder)


def read_cache(spark: SparkSession, folder: str) -> DataFrame:
    """Cached pages of this version; boxes that do not have four sides are dropped."""
    found = spark.read.schema(f"page int, version int, words {WORDS}, document_key string").parquet(folder).where(F.col("version") == VERSION)
    return found.withColumn("words", F.filter("words", lambda w: F.size(w["b"]) == 4)).drop("version")


def recognised(pages: DataFrame, cache: DataFrame, recogniser: Callable[[bytes, int, int], list[tuple[str, list[float]]]]) -> DataFrame:
    """Recognise the pages (``document_key, page, width, height, grey``) that the cache lacks; lines without words go."""

    def run(batches):
        names, kind = ["document_key", "page", "words"], pa.list_(pa.struct([("t", pa.string()), ("b", pa.list_(pa.float64()))]))
        for batch in batches:
            for i in range(batch.num_rows):
                key, page, width, height, grey = (batch.column(c)[i].as_py() for c in range(5))
                words = [{"t": t.strip(), "b": list(map(float, b))} for t, b in recogniser(grey, width, height) if t.strip()]
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([page], pa.int32()), pa.array([words], kind)], names)

    todo = pages.join(cache.select("document_key", "page"), ["document_key", "page"], "left_anti").where("grey is not null")
    return todo.select(F.col("document_key").cast("string").alias("document_key"), F.col("page").cast("int").alias("page"), "width", "height", "grey").mapInArrow(run, f"document_key string, page int, words {WORDS}")
