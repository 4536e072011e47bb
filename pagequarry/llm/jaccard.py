"""N-gram Jaccard join with token-combination prefixes, and its components.

Tokens are hashes of word shingles. Documents with equal sets form a class, and one of each
class, the least ``doc_id``, is joined. Two sets with Jaccard >= num/den share enough tokens
that, in any common order of all tokens, their prefixes must share some. The order here puts
rare tokens first. Rare tokens are indexed alone. Frequent tokens are dealt to a few buckets by
hash and indexed in pairs of one bucket, which makes posting lists short where single frequent
tokens would have very long ones. A bucket of c frequent prefix tokens guarantees a shared pair
only for c - 1 of them, so the prefix is extended until rare tokens plus those guarantees exceed
the number of tokens that a partner may lack. Documents near the upper end of a size band are
also indexed as in the next band, since the bucket count follows the band.

What is frequent comes from exact counts of all tokens (by 48 hash bits), kept as a bit map of
bounded size; a second bit map marks tokens that occur at all in two documents, others need no
index entry. Wrong marks change only the order or add an entry, never the result.

Candidates: in every posting list each member is paired with the list's most typical member
(fewest rare tokens), and verified on the whole texts; then all pairs of a list whose members
are still in different components, except those already verified or excluded by exact bounds on
sizes, rare tokens and the number of lists in which a pair meets. Pairs inside a component found
already cannot change it. ``linked`` leaves that out and verifies all pairs of all lists instead,
which also gives every document its number of links.

Defined cases: null text or text without words has an empty set and is linked with nothing;
with fewer words than a shingle the whole sequence is one token; every row is compared by its own
text, whole whatever its length, and components with the same least ``doc_id`` are one; a null ``doc_id`` takes no part (component null); an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.llm.common import dropped, forget_caches, mix64, release_shuffles, utf8_parts, written
from pagequarry.llm.components import components
from pagequarry.llm.words import shingle_sets

MAP_BITS = 27  # of each bit map; small tables have fewer
LEAST_BITS = 23
FREQUENT = 32  # documents from which on a token is frequent
PART, HELD = 1 << 18, 1 << 20  # bytes of text and tokens that a task works on at a time
LIST = 1024  # members of a posting list and size bucket that one task pairs with the others
BLOCK = 64  # members that are verified against one copy of a centre's text
_ONE, _TWO, _KEY = (np.uint64(x) for x in (0x8CB92BA72F3D8DD7, 0xA24BAED4963EE407, 0x9FB21C651E98DF25))


@dataclass(frozen=True)
class Measure:
    """Shingles of ``words`` words, linked from a Jaccard of ``num / den`` on."""

    words: int = 5
    num: int = 80
    den: int = 100

    def spare(self, n: int) -> int:
        """Tokens that a partner of a set of ``n`` may lack."""
        return n - -(-self.num * n // self.den)

    def bands(self, n: int) -> list[int]:
        """Size bands in which a set of ``n`` is indexed: its own, and the next if a partner may be there."""
        own = n.bit_length() - 1
        return [own, own + 1] if n * self.den >= self.num << (own + 1) else [own]

    def buckets(self, band: int) -> int:
        return max(1, ((self.den - self.num) << band) // (2 * self.den))


# ---- token counts -------------------------------------------------------------------------------


def _count_blocks(docs: DataFrame, measure: Measure, bits: int) -> DataFrame:
    """Distinct tokens of a task by their top ``bits``, with repeats beside."""

    def run(batches):
        forget_caches()
        held, n = [], 0

        def flush():
            tokens, counts = np.unique(np.concatenate(held) >> np.uint64(16), return_counts=True)
            bucket = (tokens >> np.uint64(48 - bits)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            ends = np.append(cuts[1:], len(tokens))
            high = (tokens >> np.uint64(32)).astype("<u2")
            low = (tokens & np.uint64(0xFFFFFFFF)).astype("<u4")
            more = np.minimum(counts - 1, 0xFFFFFFFF).astype("<u4")
            rows = []
            for a, b in zip(cuts.tolist(), ends.tolist(), strict=True):
                again = np.flatnonzero(more[a:b])
                rows.append((int(bucket[a]), high[a:b].tobytes() + low[a:b].tobytes(), again.astype("<u4").tobytes() + more[a:b][again].tobytes()))
            for i in range(0, len(rows), 4096):
                part = rows[i : i + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*part, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "tokens", "again"])

        for batch in batches:
            for _, _, data, offsets in utf8_parts(batch.column(0), PART):
                for one in shingle_sets(data, offsets, measure.words):
                    held.append(one)
                    n += len(one)
                if n > HELD:
                    yield from flush()
                    held, n = [], 0
        if n:
            yield from flush()

    return docs.select("text").mapInArrow(run, "bucket int, tokens binary, again binary")


def _marks(blocks: DataFrame, bits: int, frequent: int, map_bits: int) -> DataFrame:
    """A bucket's slices of the two bit maps, deflated: seen twice, and frequent."""
    size = 1 << (map_bits - bits)

    def run(table: pa.Table) -> pa.Table:
        tokens, counts = [], []
        for blob, again in zip(table["tokens"], table["again"], strict=True):
            raw = np.frombuffer(blob.as_buffer(), np.uint8)
            n = len(raw) // 6
            tokens.append(raw[: 2 * n].copy().view("<u2").astype(np.uint64) << np.uint64(32) | raw[2 * n :].copy().view("<u4"))
            count = np.ones(n, np.int64)
            more = np.frombuffer(again.as_buffer(), "<u4")
            half = len(more) // 2
            count[more[:half]] += more[half:]
            counts.append(count)
        tokens, at = np.unique(np.concatenate(tokens), return_inverse=True)
        counts = np.bincount(at, np.concatenate(counts))
        place = (tokens >> np.uint64(48 - map_bits) & np.uint64(size - 1)).astype(np.int64)
        least = frequent
        while np.count_nonzero(counts >= least) > max(1, size // 8):
            least *= 2
        slices = []
        for kept in (counts >= 2, counts >= least):
            flags = np.zeros(max(size, 8), np.uint8)
            flags[place[kept]] = 1
            slices.append(zlib.compress(np.packbits(flags, bitorder="little").tobytes(), 1) if kept.any() else None)
        return pa.table({"bucket": table["bucket"].slice(0, 1).cast(pa.int32()), "twice": pa.array(slices[:1], pa.binary()), "often": pa.array(slices[1:], pa.binary())})

    return blocks.groupBy("bucket").applyInArrow(run, "bucket int, twice binary, often binary")


def token_maps(docs: DataFrame, measure: Measure, frequent: int = FREQUENT, map_bits: int = MAP_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Bit maps over the top ``map_bits`` of a token: seen twice, and frequent. Their size is fixed."""
    bits = min(20, max(6, (16 * docs.rdd.getNumPartitions() - 1).bit_length()))
    maps = np.zeros((2, 1 << (map_bits - 3)), np.uint8)
    each = 1 << (map_bits - bits - 3)
    for row in _marks(_count_blocks(docs, measure, bits), bits, frequent, map_bits).where("twice is not null or often is not null").toLocalIterator():
        for k, blob in enumerate((row["twice"], row["often"])):
            if blob is not None:
                maps[k, row["bucket"] * each : row["bucket"] * each + each] = np.frombuffer(zlib.decompress(blob), np.uint8)
    return maps[0], maps[1]


def _marked(bit_map: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    at = (tokens >> np.uint64(64 - (len(bit_map).bit_length() + 2))).astype(np.int64)
    return (bit_map[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


# ---- index entries ------------------------------------------------------------------------------


def signatures(tokens: np.ndarray, often: np.ndarray, twice: np.ndarray, measure: Measure) -> np.ndarray:
    """Index entries of one set. ``tokens`` ascend; the lowest bit of an entry is 1 for a pair."""
    n = len(tokens)
    need = measure.spare(n) + 1
    rare = tokens[~often]
    alone = rare[:need][twice[~often][:need]]
    with np.errstate(over="ignore"):
        out = [mix64(alone * _ONE) & ~np.uint64(1)]
        if len(rare) < need:
            many = tokens[often]
            for band in measure.bands(n):
                buckets = measure.buckets(band)
                bucket = (many >> np.uint64(7)) % np.uint64(buckets)
                later = np.ones(len(many), np.int64)
                later[np.unique(bucket, return_index=True)[1]] = 0
                end = int(np.searchsorted(np.cumsum(later), need - len(rare))) + 1
                own, b = many[:end], bucket[:end]
                order = np.argsort(b, kind="stable")
                own, b = own[order], b[order]
                step = 1
                while step < len(own):
                    same = b[step:] == b[:-step]
                    if not same.any():
                        break
                    first, second = own[:-step][same], own[step:][same]
                    out.append(mix64(first * _ONE + second * _TWO + np.uint64(band)) | np.uint64(1))
                    step += 1
    return np.unique(np.concatenate(out))


def _entries(docs: DataFrame, measure: Measure, maps) -> DataFrame:
    """A row a document: set size, set key, number of rare tokens, index entries."""

    def run(batches):
        forget_caches()
        twice_map, often_map = maps.value
        for batch in batches:
            for a, b, data, offsets in utf8_parts(batch.column(1), PART):
                rows = []
                for tokens in shingle_sets(data, offsets, measure.words):
                    if not len(tokens):
                        rows.append((0, 0, 0, 0, []))
                        continue
                    often = _marked(often_map, tokens)
                    with np.errstate(over="ignore"):
                        key = (mix64(tokens).sum(dtype=np.uint64).view(np.int64), mix64(tokens ^ _KEY).sum(dtype=np.uint64).view(np.int64))
                    rows.append((len(tokens), int(key[0]), int(key[1]), int(len(tokens) - np.count_nonzero(often)), signatures(tokens, often, _marked(twice_map, tokens), measure).view(np.int64)))
                n, k1, k2, r, s = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(r, pa.int64()), pa.array(s, pa.list_(pa.int64()))], ["doc_id", "n", "k1", "k2", "r", "entries"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, k1 long, k2 long, r long, entries array<long>")


# ---- candidates and verification ----------------------------------------------------------------


def _candidates(met: DataFrame, measure: Measure) -> DataFrame:
    """Distinct pairs ``u, v`` out of meetings (``entry``, and id, ``n``, ``r`` of both) that can be links.

    A prefix makes sure of its set's spare tokens and one more: rare ones alone, and all but one
    of a bucket. A partner lacks at most the set's size less the overlap that the two sizes call
    for, and every token that it lacks costs one of them at most. So of the rare tokens of the
    prefix that ends first, all but those are met. Sets that meet only at pairs of frequent
    tokens had all their rare tokens in their prefixes and share none of them: all they share is
    frequent, and they meet at no fewer pairs than what the prefix makes sure of.
    """
    m, d = measure.num, measure.den
    overlap = f"ceil((un + vn) * {m} / {m + d}.0D - 1e-9)"
    sure = lambda x: f"{x}n - ceil({x}n * {m} / {d}.0D + 1e-9) + 1"
    alone = f"least(least(ur, {sure('u')}) - un, least(vr, {sure('v')}) - vn) + {overlap}"
    pairs = f"least({sure('u')} - un, {sure('v')} - vn) + {overlap}"
    counted = met.groupBy("u", "v", "un", "vn", "ur", "vr").agg(F.count(F.when(F.expr("(entry & 1) = 0"), 1)).alias("alone"), F.count("*").alias("met"))
    frequent = f"alone = 0 and met >= {pairs} and least(un - ur, vn - vr) * {m + d} >= (un + vn) * {m}"
    return counted.where(f"(alone > 0 and alone >= {alone}) or ({frequent})").select("u", "v")


def _verified(docs: DataFrame, pairs: DataFrame, measure: Measure) -> DataFrame:
    """The links ``u, v`` among ``pairs`` (``u`` centre, ``v`` member), by their whole texts.

    Members go to blocks of about ``BLOCK`` with one copy of the centre's text in each.
    """
    blocks = pairs.groupBy("u").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = pairs.join(blocks, "u").select("u", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int").alias("block"), "v")
    centres = blocks.select("u", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("u").alias("id"), F.lit(0).alias("member"))
    need = dealt.select("u", "block", F.col("v").alias("id"), F.lit(1).alias("member")).unionByName(centres)
    # Texts move in the same way whatever the number of pairs: neither side is ever broadcast.
    rows = need.hint("merge").join(docs.select(F.col("doc_id").alias("id"), "text"), "id").select("u", "block", "member", "id", "text")

    def run(batches):
        forget_caches()
        at, centres = None, []
        for batch in batches:
            us, blocks_, members, ids = (batch.column(i).to_pylist() for i in range(4))
            links = []
            for a, b, data, offsets in utf8_parts(batch.column(4), PART):
                for i, tokens in zip(range(a, b), shingle_sets(data, offsets, measure.words), strict=True):
                    if (us[i], blocks_[i]) != at:
                        at, centres = (us[i], blocks_[i]), []
                    if members[i] == 0:
                        centres.append(tokens)
                        continue
                    for other in centres:
                        small, large = (tokens, other) if len(tokens) <= len(other) else (other, tokens)
                        if not len(small) or len(small) * measure.den < len(large) * measure.num:
                            continue
                        found = np.searchsorted(large, small)
                        found[found == len(large)] = 0
                        shared = int(np.count_nonzero(large[found] == small))
                        if shared * measure.den >= (len(small) + len(large) - shared) * measure.num:
                            links.append((us[i], ids[i]))
                            break
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["u", "v"])

    return rows.repartition("u", "block").sortWithinPartitions("u", "block", "member").mapInArrow(run, "u long, v long")


def _list_pairs(rows: DataFrame, measure: Measure, apart: str) -> DataFrame:
    """All pairs of one posting list that sizes and frequent tokens allow, as meetings for ``_candidates``.

    ``rows``: ``entry, id, n, r`` and what ``apart`` compares of ``x`` and ``y``. Lists are split by
    size first: sets whose sizes differ by more than the measure allows are in buckets that are
    not neighbours. What is still longer than ``LIST`` is dealt over several tasks by one side.
    """
    width = math.log(measure.den / measure.num) * 1.0001
    rows = rows.withColumn("size", F.floor(F.log(F.col("n").cast("double")) / width).cast("int"))
    parts = rows.groupBy("entry", "size").agg(F.ceil(F.count("*") / LIST).cast("int").alias("parts")).where("parts > 1")
    y = rows.withColumn("own", F.col("size")).withColumn("size", F.explode(F.array(F.col("size"), F.col("size") - 1)))
    if parts.isEmpty():  # no long list: nothing to deal
        x, y = (side.withColumn("part", F.lit(0)) for side in (rows, y))
    else:
        x = rows.join(parts, ["entry", "size"], "left").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
        y = y.join(parts, ["entry", "size"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    once = "(x.id < y.id or y.own <> y.size)"  # pairs across buckets meet in one order only
    size = f"least(x.n, y.n) * {measure.den} >= greatest(x.n, y.n) * {measure.num}"
    frequent = f"((x.entry & 1) = 0 or least(x.n - x.r, y.n - y.r) * {measure.num + measure.den} >= (x.n + y.n) * {measure.num})"
    met = x.alias("x").join(y.alias("y").hint("merge"), F.expr(f"x.entry = y.entry and x.size = y.size and x.part = y.part and {once} and {apart} and {size} and {frequent}"))
    low = "x.id < y.id"
    sides = [F.expr(f"if({low}, {p}.{c}, {q}.{c})").alias(n + c) for p, q, n in (("x", "y", "u"), ("y", "x", "v")) for c in ("n", "r")]
    return met.select("x.entry", F.least("x.id", "y.id").alias("u"), F.greatest("x.id", "y.id").alias("v"), *sides)


@dataclass
class Index:
    """Documents with their sets, one row a class of equal sets, and the posting lists of the classes."""

    docs: DataFrame
    every: DataFrame
    sets: DataFrame

    @property
    def lists(self) -> DataFrame:
        return self.sets.select(F.explode("entries").alias("entry"), "id", "n", "r")

    def by_document(self, found: DataFrame, links: DataFrame | None = None) -> DataFrame:
        """``doc_id, n_shingles, component_id`` of every row, out of components of classes (``id, component``).

        With ``links`` (``u, v``: all links of classes) also ``n_links``, the documents that a document links with.
        """
        by_set = self.sets.join(found.hint("merge"), "id", "left").select("k1", "k2", "n", F.coalesce("component", "id").alias("component"), "id", "copies")
        out = self.every.select("doc_id", "n", "k1", "k2")
        shown = [F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.when(F.col("doc_id").isNotNull(), F.col("component"))).alias("component_id")]
        if links is not None:
            both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
            others = both.join(self.sets.select(F.col("id").alias("v"), F.col("copies").alias("n")), "v").groupBy(F.col("u").alias("id")).agg(F.sum("n").alias("others"))
            by_set = by_set.join(others, "id", "left")
            linked = F.coalesce("others", F.lit(0)) + F.col("copies") - 1
            shown.append(F.coalesce(F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), linked), F.lit(0)).cast("long").alias("n_links"))
        return out.join(by_set.drop("id").hint("merge"), ["k1", "k2", "n"], "left").select("doc_id", *shown)


def index(docs: DataFrame, measure: Measure, frequent: int = FREQUENT, map_bits: int | None = None) -> Index:
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    maps = spark.sparkContext.broadcast(token_maps(docs, measure, frequent, map_bits or _bits_for(docs)))
    release_shuffles(spark)
    every = written(_entries(docs, measure, maps), "jaccard-documents")
    maps.destroy()
    sets = every.where("n > 0 and doc_id is not null").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.first("r").alias("r"), F.first("entries").alias("entries"))
    return Index(docs, every, written(sets, "jaccard-sets"))


def _bits_for(docs: DataFrame) -> int:
    """Bits of each map, from Spark's estimate of the table's size: 1 MB, 16 MB from 32 MB of input on, 64 MB at most."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return min(MAP_BITS + 2, max(LEAST_BITS, min(MAP_BITS, (4 * size).bit_length()), (size // 8).bit_length()))


def class_links(at: Index, measure: Measure) -> DataFrame:
    """``u, v``: every link between two classes of equal sets, by their least ``doc_id``; u < v.

    The classes' members are in ``Index.every``: together they say all links, and copies are
    never expanded into pairs. Near copies among thousands all link with each other, so this
    result grows with the square of a group of different texts; ``join`` does without it.
    """
    return written(_verified(at.docs, written(_candidates(_list_pairs(at.lists, measure, "true"), measure), "jaccard-all-pairs"), measure).distinct(), "jaccard-all-links")


def linked(docs: DataFrame, measure: Measure = Measure(), frequent: int = FREQUENT, map_bits: int | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links``: a row a row of ``docs``, all its links counted."""
    at = index(docs, measure, frequent, map_bits)
    links = class_links(at, measure)
    return at.by_document(components(links), links)


def join(docs: DataFrame, measure: Measure = Measure(), frequent: int = FREQUENT, map_bits: int | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id``: a row a row of ``docs``."""
    return _joined(docs, measure, frequent, map_bits)[1]


def _joined(docs: DataFrame, measure: Measure, frequent: int = FREQUENT, map_bits: int | None = None) -> tuple[Index, DataFrame]:
    """The index, which the result is still made from, and the result."""
    spark = docs.sparkSession
    at = index(docs, measure, frequent, map_bits)
    docs, lists = at.docs, at.lists

    centres = lists.groupBy("entry").agg(F.min(F.struct("r", "id", "n")).alias("c"), F.count("*").alias("size")).where("size > 1").select("entry", "c")
    size = f"least(x.n, c.n) * {measure.den} >= greatest(x.n, c.n) * {measure.num}"
    met = lists.alias("x").join(centres.hint("merge"), "entry").where("x.id <> c.id and " + size)
    both = [F.expr(f"{a}.{c}").alias(b + c) for a, b in (("c", "u"), ("x", "v")) for c in ("n", "r")]
    met = met.select("entry", F.col("c.id").alias("u"), F.col("x.id").alias("v"), *both)
    first = written(_candidates(met, measure), "jaccard-pairs")
    links = written(_verified(docs, first, measure), "jaccard-links")
    found = components(links)
    release_shuffles(spark)

    # What is left: pairs of one posting list in different components, verified one and all.
    named = at.sets.join(found.hint("merge"), "id", "left").select(F.explode("entries").alias("entry"), "id", "n", "r", F.coalesce("component", "id").alias("component"))
    apart = named.groupBy("entry").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("n").alias("least")).where("low <> high").select("entry", "least")
    # Where only frequent tokens are shared, too many rare ones exclude a set from any link.
    reach = f"(entry & 1) = 0 or (n - r) * {measure.num + measure.den} >= (n + greatest(least, ceil(n * {measure.num} / {measure.den}.0D - 1e-9))) * {measure.num}"
    rest = written(named.join(apart.hint("merge"), "entry").where(reach).select("entry", "id", "n", "r", "component"), "jaccard-rest")
    more = _candidates(_list_pairs(rest, measure, "x.component <> y.component"), measure)
    known = first.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    more = written(more.join(known.hint("merge"), ["u", "v"], "left_anti"), "jaccard-more-pairs")
    dropped(rest, first)
    release_shuffles(spark)
    if not more.isEmpty():
        others = written(_verified(docs, more, measure), "jaccard-more-links")
        found = components(found.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(others))
        dropped(others)
    dropped(more, links)
    return at, at.by_document(found)


def one_of_each(docs: DataFrame, measure: Measure = Measure()) -> DataFrame:
    """``docs`` with one document of each component, the one with the least ``doc_id``.

    Of several rows with that id one stays (by a hash of the text); rows with a null ``doc_id``
    are kept.
    """
    at, found = _joined(docs, measure)
    found = written(found, "jaccard-components")
    dropped(at.every, at.sets)
    release_shuffles(docs.sparkSession)
    name, many, rank = (f"{x}_{uuid.uuid4().hex}" for x in ("kept", "rows", "rank"))  # names that no column has
    columns = [f"`{c}`" for c in docs.columns]
    first = found.where("component_id = doc_id").groupBy(F.col("component_id").alias(name)).agg(F.count("*").alias(many))
    kept = docs.join(first, F.col("doc_id").cast("long") == F.col(name))
    if first.where(f"{many} > 1").isEmpty():
        kept = kept.select(*columns)
    else:
        one = kept.where(f"{many} > 1").withColumn(rank, F.row_number().over(Window.partitionBy(name).orderBy(F.xxhash64("text")))).where(f"{rank} = 1")
        kept = kept.where(f"{many} = 1").select(*columns).unionByName(one.select(*columns))
    return kept.unionByName(docs.where("doc_id is null"))
