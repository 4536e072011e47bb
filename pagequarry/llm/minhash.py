"""Near-duplicate classes by bottom-k sketches of one hash function.

A document's set is its word shingles, hashed once; its sketch is the ``K`` least hashes. Rows with
equal sets are one class, and one of each class is worked on.

* Inverted lists: a retained value leads to the sketches that hold it. Sets as similar as the
  measure asks share at least ``least_shared`` values of their sketches, so each sketch is listed
  under its rarest values only, all but ``least_shared - 1``: in any common order two such sketches
  meet there. Values of one sketch alone and the commonest ones, of passages that many texts
  share, lead nowhere. A bit map of bounded size says which values several sketches hold,
  before any of them moves with its document; a wrong bit only moves one more.
* Overlaps are generated from the lists: first each list's members with its most typical member, which has
  the fewest values of its own, then the pairs of one list that are still in different classes.
* The least ``K`` values of the union of two sketches are a sample of the union of the sets; the
  part of it in both sketches estimates the Jaccard. Where it is six standard
  deviations under the measure, the pair goes. Sets of ``K`` values or fewer are
  their own sketches, and the estimate is exact.
* What is left is verified on the full sets of the whole texts.

The sample is drawn without replacement, so its deviation is nothing for unions of ``K`` values and grows with the
union. A link of longer sets is lost if its sample lies those six deviations off: under
one in ten million for a pair right at the measure, and less above it.

Defined cases: null text and text without words have an empty set and are linked with nothing;
with fewer words than a shingle the whole sequence is one; texts are worked on whole whatever their
length; equal texts are one class; every row is judged by its own text, also where rows share a ``doc_id``; a null
``doc_id`` takes no part (component and kept are null); an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import dropped, forget_caches, mix64, release_shuffles, utf8_parts, written
from pagequarry.llm.components import components
from pagequarry.llm.jaccard import BLOCK, Measure, _verified
from pagequarry.llm.words import shingle_sets

#: Values of a sketch, bytes of text at a time, members of a list that one task pairs with the others, bits of the map, bits of a sketch's parities, values that they are of.
K, PART, LIST, MAP_BITS, PARITIES, NEAR = 256, 1 << 20, 1024, 27, 1024, 195
_KEYS = (np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0x9FB21C651E98DF25))


def least_shared(measure: Measure, k: int, union: float) -> int:
    """Values that the sketches of two linked sets with a union of that size share: six deviations under the expected ones."""
    j = measure.num / measure.den
    return max(1, math.floor(k * j - 6 * math.sqrt(k * j * (1 - j) * max(0.0, union - k) / max(1.0, union - 1)) + 1e-9))


def _sketches(docs: DataFrame, measure: Measure, k: int) -> DataFrame:
    """A row a document: set size, set key, sketch (ascending as unsigned values)."""

    def run(batches):
        forget_caches()
        for batch in batches:
            for a, b, data, offsets in utf8_parts(batch.column(1), PART):
                sizes, keys, sketches, ends = [], ([], []), [], [0]
                for tokens in shingle_sets(data, offsets, measure.words):
                    sizes.append(len(tokens))
                    with np.errstate(over="ignore"):
                        for out, key in zip(keys, _KEYS, strict=True):
                            out.append(int(mix64(tokens ^ key).sum(dtype=np.uint64).view(np.int64)))
                    sketches.append(tokens[:k])
                    ends.append(ends[-1] + len(sketches[-1]))
                values = np.concatenate(sketches).view(np.int64) if sketches else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *[pa.array(x, pa.int64()) for x in (sizes, *keys)], lists], ["doc_id", "n", "k1", "k2", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, k1 long, k2 long, sketch array<long>")


def _several(common: DataFrame, map_bits: int = MAP_BITS) -> np.ndarray:
    """A bit map over the top ``map_bits`` of the values in ``common``: its words come to the driver, however many values there are."""
    word, bit = F.shiftrightunsigned("value", 64 - map_bits + 6), F.shiftrightunsigned("value", 64 - map_bits).bitwiseAND(F.lit(63)).cast("int")
    words = common.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits")).toArrow()
    out = np.zeros(1 << (map_bits - 6), np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def _values(sets: DataFrame, bit_map, map_bits: int = MAP_BITS) -> DataFrame:
    """``id, k1, n, value``: the retained values of each set that several sets hold, by the map."""

    def run(batches):
        words = bit_map.value
        for batch in batches:
            lists = batch.column(3)
            counts = np.diff(lists.offsets.to_numpy())
            values = np.asarray(lists.flatten())
            at = values.view(np.uint64) >> np.uint64(64 - map_bits)
            kept = np.flatnonzero(words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1))
            rows = pa.array(np.repeat(np.arange(len(counts)), counts)[kept], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(rows) for i in range(3)), pa.array(values[kept], pa.int64())], ["id", "k1", "n", "value"])

    return sets.select("id", "k1", "n", "sketch").mapInArrow(run, "id long, k1 long, n long, value long")


def _prefixes(sets: DataFrame, measure: Measure, k: int) -> DataFrame:
    """``id, n, own, several, prefix``: the rarest values of each sketch, all but those that it may lack in common with others.

    They are in order, the rarest first. ``own`` says how many values no other set has, which lead nowhere, and ``several`` how many others have.
    """
    spark = sets.sparkSession
    common = written(sets.select(F.explode("sketch").alias("value")).groupBy("value").agg(F.count("*").alias("sets")).where("sets > 1"), "sketch-values")
    release_shuffles(spark)
    bit_map = spark.sparkContext.broadcast(_several(common))
    j, held = measure.num / measure.den, F.least(F.col("n"), F.lit(k))
    # A set shares so much of itself with any partner whose union is its own sketch; others go by the sample.
    exact = F.ceil(F.col("n") * measure.num / measure.den - 1e-9)
    union = F.col("n") / j
    sampled = F.floor(k * j - 6 * F.sqrt(k * j * (1 - j) * F.greatest(union - k, F.lit(0.0)) / F.greatest(union - 1, F.lit(1.0))) + 1e-9)
    room = held - F.greatest(F.least(exact, sampled), F.lit(1)) + 1
    rarest = F.array_sort(F.collect_list(F.struct("sets", "value"))).alias("met")  # K values a set at most
    met = _values(sets, bit_map).hint("merge").join(common, "value").groupBy("id", "k1", "n").agg(rarest)
    own = held - F.size("met")  # rarer than all others, and of no use
    kept = F.slice(F.transform("met", lambda m: m["value"]), F.lit(1), F.greatest(room - own, F.lit(0)).cast("int"))
    prefixes = written(met.select("id", "n", own.alias("own"), F.size("met").alias("several"), kept.alias("prefix")).where("size(prefix) > 0"), "sketch-prefixes")
    bit_map.destroy()
    dropped(common)
    return prefixes


def _lists(prefixes: DataFrame, *more: str) -> DataFrame:
    """``value, id, n, own, left`` and ``more``: a row a value of a prefix; ``left`` says how many values of the sketch are no rarer."""
    each = prefixes.select("id", "n", "own", "several", *more, F.posexplode("prefix").alias("at", "value"))
    return each.select("value", "id", "n", "own", (F.col("several") - F.col("at")).alias("left"), *more)


def _size(measure: Measure):
    """The bucket of a set's size; sets in buckets that are not neighbours cannot link."""
    return F.floor(F.log(F.col("n").cast("double")) / (math.log(measure.den / measure.num) * 1.0001)).cast("int")


def _parities(sets: DataFrame, measure: Measure) -> DataFrame:
    """``id, odd, odd_below``: of the values under the bound of the set's bucket, and of the bucket below: how many (``few``), and in which of ``PARITIES`` places their number is odd (``bits``).

    Bounds are such that sketches hold about ``NEAR`` of ``K`` values under them. Null where a sketch ends before the bound. What two sketches differ in
    is as much at least as their parities do.
    """
    width = math.log(measure.den / measure.num) * 1.0001

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                lists, n, size = part.column(3), part.column(1).to_numpy(), part.column(2).to_numpy()
                values, held = np.asarray(lists.flatten()).view(np.uint64), np.diff(lists.offsets.to_numpy())
                row, many, out = np.repeat(np.arange(len(lists)), held), len(lists), []
                for bucket in (size, size - 1):
                    bound = np.minimum(NEAR / np.exp(width * (bucket + 1)), 1.0) * 2.0**64
                    under = (values.astype(np.float64) < bound[row]) | (bound[row] >= 2.0**64)
                    few = np.bincount(row[under], minlength=many)
                    at = row[under] * PARITIES + (values[under] & np.uint64(PARITIES - 1)).astype(np.int64)
                    words = np.packbits((np.bincount(at, minlength=many * PARITIES) & 1).astype(np.uint8), bitorder="little").view(np.int64)
                    bits = pa.ListArray.from_arrays(pa.array(np.arange(many + 1) * (PARITIES // 64), pa.int32()), pa.array(words))
                    whole = pa.array((few < held) | (n == held))
                    out.append(pa.StructArray.from_arrays([pa.array(few), bits], ["few", "bits"], mask=pc.invert(whole)))
                yield pa.RecordBatch.from_arrays([part.column(0), *out], ["id", "odd", "odd_below"])

    odd = "struct<few:long,bits:array<long>>"
    return sets.select("id", "n", _size(measure).alias("size"), "sketch").mapInArrow(run, f"id long, odd {odd}, odd_below {odd}")


def _wanted(x: str, y: str, measure: Measure, k: int) -> str:
    """How many values the sketches of two linked sets share at least."""
    j = measure.num / measure.den
    both = f"({x}.n + {y}.n)"
    whole = f"ceil({both} * {measure.num} / {measure.num + measure.den}.0D - 1e-9)"
    sampled = f"floor({k * j} - 6 * sqrt({k * j * (1 - j)} * greatest({both} / {1 + j} - {k}, 0) / greatest({both} / {1 + j} - 1, 1)) + 1e-9)"
    return f"if(greatest({x}.n, {y}.n) <= {k}, {whole}, {sampled})"


def _may_link(x: str, y: str, measure: Measure, k: int) -> str:
    """Whether two sets that meet in a list can link, if they meet there first.

    Their sizes must allow it, and so must what is left of both sketches from this value on: all that they share is there.
    A pair that meets earlier is found there.
    """
    sizes = f"least({x}.n, {y}.n) * {measure.den} >= greatest({x}.n, {y}.n) * {measure.num}"
    return f"{sizes} and least({x}.left, {y}.left) >= {_wanted(x, y, measure, k)}"


def _agree(x: str, y: str, measure: Measure, k: int) -> str:
    """Whether the parities of two sketches under one bound allow a link.

    Of the ``k`` least values of the union all but the shared ones that a link needs may differ. Either all under the bound are among those,
    or all those are under the bound; then what is under it and not shared differs. Whole sets may differ in what they need not share.
    """
    differ = f"aggregate(zip_with({x}.odd.bits, {y}.odd.bits, (a, b) -> bit_count(a ^ b)), 0, (a, b) -> a + b)"
    wanted = _wanted(x, y, measure, k)
    allowed = f"if(greatest({x}.n, {y}.n) <= {k}, {x}.n + {y}.n - 2 * {wanted}, greatest({k} - {wanted}, {x}.odd.few + {y}.odd.few - 2 * {wanted}))"
    return f"coalesce({differ} <= {allowed}, true)"


def _first_pairs(lists: DataFrame, measure: Measure, k: int) -> DataFrame:
    """Each list's members with its most typical one, as far as a link is possible."""
    first = written(lists.groupBy("value").agg(F.min(F.struct("own", "n", "id", "left")).alias("c"), F.count("*").alias("size")).where("size > 1").select("value", "c.id", "c.n", "c.left"), "sketch-firsts")
    met = lists.hint("merge").alias("x").join(first.alias("c"), F.expr(f"x.value = c.value and x.id <> c.id and {_may_link('x', 'c', measure, k)}"))
    return met.select(F.col("c.id").alias("u"), F.col("x.id").alias("v")).distinct()


def _other_pairs(lists: DataFrame, measure: Measure, k: int) -> DataFrame:
    """All pairs of one list in different components that can link, each in the first list that both are in: no value ``before`` is in both.

    Their parities must allow it too, which leaves out most pairs that estimates would, before there is a row of them.

    Lists are split by size first, as sets in buckets that are not neighbours cannot link; what is
    longer than ``LIST`` then is dealt over several tasks by one side.
    """
    rows = lists.withColumn("size", _size(measure))
    parts = rows.groupBy("value", "size").agg(F.ceil(F.count("*") / LIST).cast("int").alias("parts")).where("parts > 1")
    sides = F.array(F.struct("size", "odd"), F.struct((F.col("size") - 1).alias("size"), F.col("odd_below").alias("odd")))
    y = rows.withColumn("own", F.col("size")).withColumn("side", F.explode(sides)).withColumns({"size": F.col("side.size"), "odd": F.col("side.odd")}).drop("side", "odd_below")
    rows = rows.drop("odd_below")
    x = rows.join(parts, ["value", "size"], "left").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    y = y.join(parts, ["value", "size"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    on = f"x.value = y.value and x.size = y.size and x.part = y.part and (x.id < y.id or y.own <> y.size) and x.component <> y.component and {_may_link('x', 'y', measure, k)} and {_agree('x', 'y', measure, k)} and not arrays_overlap(x.before, y.before)"
    return x.alias("x").join(y.alias("y"), F.expr(on)).select(F.least("x.id", "y.id").alias("u"), F.greatest("x.id", "y.id").alias("v")).distinct()


def shared_of_union(a: np.ndarray, b: np.ndarray, k: int) -> tuple[int, int]:
    """Of the ``k`` least values of two sketches together: how many are in both, and how many there are."""
    both = np.sort(np.concatenate([a, b]))
    twice = np.zeros(len(both), bool)
    twice[1:] = both[1:] == both[:-1]
    distinct = np.cumsum(~twice)
    within = distinct <= k
    return int(np.count_nonzero(twice & within)), int(min(k, distinct[-1] if len(both) else 0))


def _estimated(pairs: DataFrame, sets: DataFrame, measure: Measure, k: int) -> DataFrame:
    """The ``pairs`` whose sketches allow a link.

    Members go to blocks of about ``BLOCK`` with one copy of the other's sketch in each, so that no key has many rows.
    """
    blocks = pairs.groupBy("u").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = pairs.join(blocks, "u").select("u", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int").alias("block"), "v")
    need = dealt.select("u", "block", F.col("v").alias("id"), F.lit(1).alias("member")).unionByName(dealt.select("u", "block", F.col("u").alias("id"), F.lit(0).alias("member")).distinct())
    rows = need.hint("merge").join(sets.select("id", "n", "sketch"), "id").select("u", "block", "member", "id", "n", "sketch")
    share = 1 + measure.num / measure.den

    def run(batches):
        at, centres = None, []
        for batch in batches:
            us, blocks_, members, ids, ns = (batch.column(i).to_pylist() for i in range(5))
            values = np.asarray(batch.column(5).flatten()).view(np.uint64)
            ends = np.cumsum([min(n, k) for n in ns]).tolist()
            kept = []
            for i, end in enumerate(ends):
                one = (values[end - min(ns[i], k) : end], ns[i])
                if (us[i], blocks_[i]) != at:
                    at, centres = (us[i], blocks_[i]), []
                if members[i] == 0:
                    centres.append(one)
                    continue
                for other in centres:
                    whole = max(one[1], other[1]) <= k
                    shared, of = shared_of_union(one[0], other[0], 2 * k if whole else k)
                    if shared * measure.den >= of * measure.num if whole else shared >= least_shared(measure, k, (one[1] + other[1]) / share):
                        kept.append((us[i], ids[i]))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in kept], pa.int64()) for j in (0, 1)], ["u", "v"])

    return rows.repartition("u", "block").sortWithinPartitions("u", "block", "member").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, measure: Measure = Measure(), k: int = K) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: a row a row of ``docs``; the least ``doc_id`` of a component is kept."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    every = written(_sketches(docs, measure, k), "sketch-documents")
    sets = every.where("n > 0 and doc_id is not null").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.first("sketch").alias("sketch"))
    sets = written(sets, "sketch-sets")
    prefixes = _prefixes(sets, measure, k)
    release_shuffles(spark)

    first = written(_first_pairs(_lists(prefixes), measure, k), "sketch-pairs")
    likely = written(_estimated(first, sets, measure, k), "sketch-likely")
    links = written(_verified(docs, likely, measure), "sketch-links")
    dropped(likely)
    found = components(links)
    release_shuffles(spark)

    # What is left: pairs of one list in different components.
    named = prefixes.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    apart = written(_lists(named, "component").groupBy("value").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("value"), "sketch-apart")
    listed = _lists(named.join(_parities(sets, measure), "id"), "component", "odd", "odd_below", "prefix").withColumn("before", F.expr("slice(prefix, 1, cast(array_position(prefix, value) as int) - 1)")).drop("prefix")
    rest = written(listed.hint("merge").join(apart, "value"), "sketch-rest")
    known = first.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    more = written(_other_pairs(rest, measure, k).join(known, ["u", "v"], "left_anti"), "sketch-more-pairs")
    dropped(prefixes, apart, rest, first)
    release_shuffles(spark)
    likely = written(_estimated(more, sets, measure, k), "sketch-more-likely")
    dropped(more)
    if not likely.isEmpty():
        others = written(_verified(docs, likely, measure), "sketch-more-links")
        found = components(links.unionByName(others))
        dropped(others)
    dropped(likely, links)

    classes = sets.join(found, "id", "left").select("k1", "k2", "n", F.coalesce("component", "id").alias("class"))
    # Empty sets have no class and one key: by their ids they are dealt to all tasks.
    rows = every.select("doc_id", "n", F.when(F.col("n") == 0, F.xxhash64("doc_id")).otherwise(F.col("k1")).alias("k1"), "k2")
    component = F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("class"))
    out = rows.join(classes, ["k1", "k2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
