"""Periodic runs of words by partition refinement, for many texts at once.

Positions are kept in classes of equal factors of one length, which grows by one a round. A class
is split by the classes that its members' successors are in, and only successors whose class is
not the largest part of the last split are looked at: a position is looked at a logarithmic number
of times. Neighbouring members of a class that are as far apart as the factor is long are a square
with a primitive root; squares of one length that start next to each other are one run, which no
neighbouring word extends and whose root is its smallest period.

All texts of a batch are refined together: every text has its own letters and ends in a letter of
its own, so that no factor goes from one to the next. A round is a few array operations on the
positions that it touches. Texts are independent, so nothing is shuffled.

Defined cases: null text, empty text and text of blanks have no words and no runs; words are
compared by 64 bits of hash; texts are worked on whole whatever their length; every row is worked
on by itself, so that repeated rows and repeated ids give repeated results; of runs that are equally long
the first, then that with the smaller period is the longest; an empty table gives no rows; other columns
pass through unless ``periodic_runs`` names its own like them: those are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry.llm.common import flat_gather, forget_caches, mix64, utf8_parts
from pagequarry.llm.words import word_hashes, word_spans

#: Least words of a run, bytes of text that are refined together, rounds between two looks at all gaps.
LEAST, PART, ROUNDS = 12, 1 << 21, 32
RUN = T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")])


def _linked(order: np.ndarray, first: np.ndarray, after: np.ndarray, before: np.ndarray) -> None:
    """Link ``order`` as lists that start where ``first`` is set."""
    joined = ~first[1:]
    after[order], before[order] = -1, -1
    after[order[:-1][joined]] = order[1:][joined]
    before[order[1:][joined]] = order[:-1][joined]


def squares(letters: np.ndarray, ends: np.ndarray):
    """Yield ``(period, starts)`` of the primitively rooted squares of a sequence.

    ``ends`` is for each position the end of its text, where a letter stands that occurs once;
    equal letters are in one text.
    """
    n = len(letters)
    order = np.argsort(letters, kind="stable")
    new = np.ones(n, bool)
    new[1:] = letters[order][1:] != letters[order][:-1]
    heads = np.flatnonzero(new)
    of = np.empty(n, np.int64)  # the class of a position
    of[order] = np.cumsum(new) - 1
    # A class has its members in elements[start : start + size], place says where a position is.
    start, size = np.zeros(2 * n + 2, np.int64), np.zeros(2 * n + 2, np.int64)
    start[: len(heads)], size[: len(heads)] = heads, np.diff(np.append(heads, n))
    classes, elements, place = len(heads), order.copy(), np.empty(n, np.int64)
    place[order] = np.arange(n)
    after, before = np.empty(n, np.int64), np.empty(n, np.int64)
    _linked(order, new, after, before)
    touched = np.zeros(n, bool)
    moved = np.arange(n)
    alive = np.flatnonzero(after >= 0)
    near = np.zeros(0, np.int64)
    period = 1
    while True:
        if (period - 1) % ROUNDS == 0:  # all gaps that may fall due before the next look
            gap = after[alive] - alive
            alive = alive[(after[alive] >= 0) & (alive + 2 * np.maximum(gap, period) <= ends[alive])]
            gap = after[alive] - alive
            near = alive[(gap >= period) & (gap < period + ROUNDS)]
        if not len(alive):
            return
        if len(near):
            found = near[after[near] - near == period]
            if len(found):
                yield period, np.unique(found)
        # Refine to factors longer by one: predecessors of moved positions leave classes of several.
        x = moved[moved > 0] - 1
        x = x[size[of[x]] > 1]
        if not len(x):
            moved = x
            period += 1
            continue
        own, nxt = of[x], of[x + 1]
        by = np.lexsort((x, nxt, own))
        x, own, nxt = x[by], own[by], nxt[by]
        edge = np.ones(len(x), bool)
        edge[1:] = own[1:] != own[:-1]
        cut = edge.copy()
        cut[1:] |= nxt[1:] != nxt[:-1]
        # Classes that leave whole, to one place, are not split.
        firsts = np.flatnonzero(edge)
        many = np.diff(np.append(firsts, len(x)))
        parts = np.add.reduceat(cut, firsts, dtype=np.int64)
        rest = size[own[firsts]] - many
        split = (parts > 1) | (rest > 0)
        if not split.all():
            keep = np.repeat(split, many)
            x, own, edge, cut = x[keep], own[keep], edge[keep], cut[keep]
            many, rest = many[split], rest[split]
            if not len(x):
                moved = x
                period += 1
                continue
            firsts = np.flatnonzero(edge)
        old = own[firsts]
        # Take the leavers out of their classes' lists, whole chains at a time.
        by = np.lexsort((x, own))
        gone = x[by]
        chain = np.ones(len(gone), bool)
        chain[1:] = after[gone[:-1]] != gone[1:]
        left, right = before[gone[chain]], after[gone[np.append(chain[1:], True)]]
        has_left, has_right = left >= 0, right >= 0
        after[left[has_left]] = right[has_left]
        before[right[has_right]] = left[has_right]
        # Leavers go to the end of their class's stretch of elements, in order of their new classes.
        touched[x] = True
        tail = flat_gather(start[old] + rest, many)
        stay = elements[tail]
        stay = stay[~touched[stay]]
        gaps = x[place[x] < np.repeat(start[old] + rest, many)]
        at = place[gaps]
        elements[at], place[stay] = stay, at
        elements[tail], place[x] = x, tail
        touched[x] = False
        groups = np.flatnonzero(cut)
        counts = np.diff(np.append(groups, len(x)))
        fresh = classes + np.arange(len(groups))
        classes += len(groups)
        if classes > len(start):
            start, size = (np.concatenate([a, np.zeros(len(a), np.int64)]) for a in (start, size))
        of[x] = np.repeat(fresh, counts)
        start[fresh], size[fresh] = tail[groups], counts
        size[old] = rest
        _linked(x, cut, after, before)
        # Next round looks at all parts of a split but the largest one.
        per = np.add.reduceat(cut, firsts, dtype=np.int64)
        which = np.repeat(np.arange(len(firsts)), per)
        most = np.maximum.reduceat(counts, np.cumsum(per) - per)
        small = np.ones(len(groups), bool)
        by_group = most > rest  # the largest part is one of the new classes
        candidates = np.flatnonzero((counts == most[which]) & by_group[which])
        small[candidates[np.unique(which[candidates], return_index=True)[1]]] = False
        whole = by_group & (rest > 0)
        moved = np.concatenate([x[np.repeat(small, counts)], elements[flat_gather(start[old[whole]], rest[whole])]])
        period += 1
        # New gaps that fall due before the next look at all of them.
        for changed in (x, left[has_left]):
            to = after[changed]
            gap = to - changed
            due = changed[(to >= 0) & (gap >= period) & (gap <= (period - 1) // ROUNDS * ROUNDS + ROUNDS) & (changed + 2 * gap <= ends[changed])]
            if len(due):
                near = np.concatenate([near, due])


def runs(words: np.ndarray, counts: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``start, length, period`` of all runs of ``least`` words or more, and how many each text has.

    ``words`` are hashes, ``counts`` the words of each text; runs are in order of start, then period.
    """
    texts, total = len(counts), len(words)
    bounds = np.cumsum(counts) + np.arange(1, texts + 1)  # one past each text's closing letter
    starts = bounds - counts - 1
    text = np.repeat(np.arange(texts), counts)
    at = np.arange(total) + text
    letters = np.empty(total + texts, np.uint64)
    with np.errstate(over="ignore"):
        letters[at] = mix64(words ^ mix64(text.astype(np.uint64) + np.uint64(1)))
        letters[bounds - 1] = mix64(np.arange(texts, dtype=np.uint64) + np.uint64(1 << 40))
    ends = np.repeat(bounds - 1, counts + 1)
    found = []
    for period, places in squares(letters, ends) if total else ():
        new = np.ones(len(places), bool)
        new[1:] = places[1:] != places[:-1] + 1
        first = places[new]
        length = places[np.append(new[1:], True)] - first + 2 * period
        enough = length >= least
        if enough.any():
            first, length = first[enough], length[enough]
            found.append(np.stack([first, length, np.full(len(first), period)], axis=1))
    if not found:
        return np.zeros((0, 3), np.int64), np.zeros(texts, np.int64)
    out = np.concatenate(found)
    out = out[np.lexsort((out[:, 2], out[:, 0]))]
    whose = np.searchsorted(bounds, out[:, 0], side="right")
    out[:, 0] -= starts[whose]
    return out, np.bincount(whose, minlength=texts)


def _collapsed(text: bytes, found: np.ndarray) -> bytes:
    """The words of ``text`` with one blank between, without those that repeat a run's root."""
    words = text.split()  # of bytes: at 0x20 and 0x09-0x0D alone
    if len(found):
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, found[:, 0] + found[:, 2], 1)
        np.add.at(edge, found[:, 0] + found[:, 1], -1)
        kept = np.cumsum(edge[:-1]) == 0
        words = [w for w, k in zip(words, kept.tolist(), strict=True) if k]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (start, length, period; by start, then period) and ``collapsed``.

    ``collapsed`` is the text without the words that a run has after its first period.
    """
    own = {"n_words", "runs", "collapsed"}
    kept = [f"`{c}`" for c in docs.columns if c.lower() not in own]
    rows = docs.select(*kept)
    schema = T.StructType([*rows.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
    at = rows.columns.index("text")
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches):
        forget_caches()
        for batch in batches:
            if batch.num_rows > 1:  # long texts take many rounds: let them take them together
                batch = batch.take(pc.sort_indices(pc.binary_length(batch.column(at)), sort_keys=[("", "descending")]))
            for a, b, data, offsets in utf8_parts(batch.column(at), PART):
                starts, ends, counts = word_spans(data, offsets)
                found, many = runs(word_hashes(data, starts, ends), counts, least)
                edges = np.append(0, np.cumsum(many))
                raw = data.tobytes()
                texts = [_collapsed(raw[offsets[i] : offsets[i + 1]], found[edges[i] : edges[i + 1]]).decode("utf-8", "replace") for i in range(b - a)]
                values = pa.StructArray.from_arrays([pa.array(found[:, k], pa.int64()) for k in range(3)], fields=list(kind))
                lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), values)
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(counts, pa.int64()), lists, pa.array(texts, pa.string())], schema.names)

    return rows.mapInArrow(run, schema)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with a stretch of some texts made periodic, by their ids' checksums; a null id changes nothing.

    With h the unsigned crc32 of the id in decimal and g its tenth: where 10 divides h, words from a = g mod n on become
    the words from there repeated every 1 + (n - a) div (3 + g mod 8).
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    return docs.withColumn("text", F.when(h % 10 == 0, _periodic(words, F.floor(h / 10))).otherwise(F.col("text")))


def _periodic(words: Column, g: Column) -> Column:
    def of(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.when(n > 0, F.array_join(F.transform(w, lambda x, i: F.get(w, place(i))), " ")).otherwise("")

    return F.transform(F.array(words), of)[0]


def digests(docs: DataFrame) -> DataFrame:
    """A row a document: number of runs, the longest one, digests of all runs and of the collapsed text."""
    found = periodic_runs(docs.select("doc_id", "text"))
    best = F.try_element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))), F.lit(1))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    found = found.withColumn("best", best)
    length = -F.col("best.less")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * length / F.col("best.period")).alias("exponent_milli"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
