"""Document fingerprints: bottom-k sketches of word-shingle hashes, in Spark expressions only.

A sketch is the ascending array of the ``K`` least distinct 64-bit hashes of a text's shingles.
Sketches of parts merge into the sketch of the whole; two sketches give resemblance and
containment, one gives the number of distinct shingles. With fewer than ``K`` shingles all
figures are exact.

Defined cases: null text is empty; a text without words has an empty sketch; with fewer words
than a shingle the whole sequence is one shingle; two empty sketches resemble each other fully,
an empty and another one not at all; rows that share a ``doc_id`` are ordered by a hash of their
text; a row with a null ``doc_id`` has no next document (its edited text is its first half, its
``near_next`` 0); a document that is alone comes after itself; texts of any length are worked on
whole; ids may lie anywhere; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, WORDS = 128, 5
#: Documents that are ordered together to find neighbours, and the most groups there are.
GROUP, GROUPS = 2_000, 1 << 15

_SPREAD = float(1 << 64)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Lower-case words between blanks; an empty text gives one empty word."""
    return F.split(F.trim(F.translate(F.lower(text), "\t\n\x0b\x0c\r", "     ")), " +")


def shingles(text: Column, size: int = WORDS) -> Column:
    """Hashes of all shingles of a text, in text order."""

    def of(w: Column) -> Column:
        every = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[w[i + j] for j in range(size)]))
        return F.when(F.size(w) >= size, every).when(w[0] == "", F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(w)))

    return _let(words(text), of)


def bottom(hashes: Column, k: int = K) -> Column:
    """The ``k`` least distinct values, ascending.

    Long arrays are cut first to values below a level that about ``4 k`` reach; where fewer than
    ``k`` distinct ones do, all values are taken.
    """

    def least(values: Column) -> Column:
        return F.slice(F.sort_array(F.array_distinct(values)), 1, k)

    def of(h: Column) -> Column:
        level = (F.lit(-(2.0**63)) + F.lit(_SPREAD * 4 * k) / F.size(h)).cast("long")
        short = _let(least(F.filter(h, lambda x: x < level)), lambda s: F.when(F.size(s) >= k, s).otherwise(least(h)))
        return F.when(F.size(h) > 8 * k, short).otherwise(least(h))

    return _let(hashes, of)


def sketch(text: Column, size: int = WORDS, k: int = K) -> Column:
    return bottom(shingles(F.coalesce(text, F.lit("")), size), k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of what ``a`` and ``b`` stand for together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_all(sketches: Column, k: int = K) -> Column:
    """The sketch of a column's sketches of one group (an aggregate of at most ``k`` values each)."""
    return F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list(sketches)))), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard of two shingle sets."""
    shared = _let(merge(a, b, k), lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.greatest(F.size(u), F.lit(1)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared).cast("double")


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles."""
    covered = (a[k - 1].cast("double") + 2.0**63) / _SPREAD
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / covered)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has."""
    j = resemblance(a, b, k)
    both = distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, 0.0).otherwise(F.least(F.lit(1.0), j * both / distinct_shingles(a, k)))


def fingerprint(a: Column) -> Column:
    """A sketch as text: hexadecimal hashes in ascending order."""
    return F.array_join(F.transform(a, lambda x: F.hex(x)), " ")


def _place(value: Column, bounds: list[float]) -> Column:
    """How many of the ascending ``bounds`` are not above ``value``, by binary search."""
    if not bounds:
        return F.lit(0)
    known = F.split(F.lit(",".join(map(repr, bounds))), ",").cast("array<double>")
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]

    def on(at: Column, step: Column) -> Column:
        return F.when((at + step <= len(bounds)) & (F.element_at(known, F.least(at + step, F.lit(len(bounds)))) <= value), at + step).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), on)


def with_next(docs: DataFrame, columns: list[str], group: int = GROUP) -> DataFrame:
    """``docs`` (non-null ``doc_id``, and ``tie``) with ``next_<column>`` of the next one.

    Order: descending ``doc_id``, then ``tie``; after the last comes the first. Documents are
    ordered within groups of about as many rows each, cut at quantiles of the ids whatever the
    ids are; each group also gets a copy of the first document of the group below, so no ordering
    spans all rows but that of one row a group, of which there are ``GROUPS`` at most.
    """
    n = docs.count()
    groups = max(1, min(GROUPS, n // group))
    shares = [i / groups for i in range(1, groups)]
    bounds = sorted(set(docs.stat.approxQuantile("doc_id", shares, 0.2 / groups))) if shares and n else []
    numbered = docs.withColumn("_group", _place(F.col("doc_id").cast("double"), bounds))
    firsts = numbered.groupBy("_group").agg(F.max(F.struct("doc_id", F.expr("~tie").alias("tie"))).alias("_first"))
    down = Window.orderBy(F.desc("_group"))
    below = F.lead("_first").over(down)
    guests = firsts.select(F.col("_group").alias("_host"), F.coalesce(below, F.first("_first").over(down)).alias("_id"), below.isNull().alias("_last"))
    # At most one row of 32 bytes a group: GROUPS rows.
    own = (F.col("doc_id") == F.col("_id.doc_id")) & (F.expr("~tie") == F.col("_id.tie"))
    copies = docs.join(F.broadcast(guests), own).drop("_id").withColumnRenamed("_host", "_group").withColumn("_guest", F.lit(True))
    every = numbered.withColumn("_last", F.lit(False)).withColumn("_guest", F.lit(False)).unionByName(copies)
    order = Window.partitionBy("_group").orderBy("_last", F.desc("doc_id"), "tie", "_guest")
    for c in columns:
        every = every.withColumn(f"next_{c}", F.lead(c).over(order))
    return every.where(~F.col("_guest")).drop("_group", "_last", "_guest")


def edited(docs: DataFrame) -> DataFrame:
    """``doc_id, text, sketch, edited, edited_sketch, next_sketch``.

    The edited text has its last half replaced by as much of the next document's start.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("sketch", sketch(F.col("text")))
    alone = rows.where("doc_id is null").withColumn("next_text", F.lit("")).withColumn("next_sketch", F.lit(None).cast("array<bigint>"))
    pairs = with_next(rows.where("doc_id is not null"), ["text", "sketch"]).unionByName(alone)
    half = F.floor(F.char_length("text") / 2).cast("int")
    changed = pairs.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.char_length("text") - half), F.substring(F.col("next_text"), F.lit(1), half)))
    return changed.withColumn("edited_sketch", sketch(F.col("edited"))).drop("tie", "next_text")


def digests(docs: DataFrame) -> DataFrame:
    """Fingerprints of texts and edited texts, and how near they are."""
    return edited(docs).select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("sketch")).alias("fingerprint"),
        fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        F.coalesce(resemblance(F.col("sketch"), F.col("next_sketch")), F.lit(0.0)).alias("near_next"),
        distinct_shingles(F.col("sketch")).alias("distinct_shingles"),
        containment(F.col("edited_sketch"), F.col("sketch")).alias("edited_containment"),
    )
