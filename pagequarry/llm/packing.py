"""Best-fit packing by patterns: non-negative least squares over a length histogram.

Documents longer than a sequence are cut into full pieces and a rest. The pieces' lengths form
a histogram with one entry a length, so the plan depends on the sequence size, not on the
corpus: patterns of up to three documents are enumerated over coarse length classes, their
repeat counts are fitted to the histogram by non-negative least squares and rounded down, and
the pieces left over go, longest first, to the open sequence with the least room that holds
them. The fit ends when no pattern could lessen its error, or after ``ROUNDS`` rounds; what it has
then is rounded down and packed all the same, and the rest goes by best fit. The plan lists, for every length, ranges of ranks and where they go; each piece finds its
place from its rank among the pieces of its length.

Defined cases: null text is an empty document (the end id alone); a text of any length is cut and
packed whole; repeated rows are packed each
on their own; null ``doc_id`` is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.llm import word_tokens
from pagequarry.llm.common import written

SEQUENCE = 4096
CLASSES = 128  # of lengths, for the fit only
ROUNDS = 400
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"


def patterns(classes: int) -> np.ndarray:
    """All multisets of one to three classes whose upper ends fill a sequence, one a column."""
    found = [(classes,)]
    found += [(a, classes - a) for a in range(1, classes // 2 + 1)]
    found += [(a, b, classes - a - b) for a in range(1, classes // 3 + 1) for b in range(a, (classes - a) // 2 + 1)]
    out = np.zeros((classes, len(found)))
    for i, one in enumerate(found):
        for c in one:
            out[c - 1, i] += 1
    return out


def non_negative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """x >= 0 that makes |a x - b| least, by an active set; stops after ``rounds`` at the latest."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[active] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= 1e-7 * (1 + np.abs(b).max()):
            break
        active[best] = True
        while active.any():
            at = np.flatnonzero(active)
            fit = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if fit.min() > 0:
                x[:] = 0
                x[at] = fit
                break
            low = fit <= 0
            step = np.min(x[at][low] / np.maximum(x[at][low] - fit[low], 1e-300))
            x[at] += step * (fit - x[at])
            active[at[(x[at] <= 1e-12) & low]] = False
            x[~active] = 0
            if step == 0 and not active[best]:
                break
    return x


def plan(histogram: dict[int, int], size: int = SEQUENCE, classes: int = CLASSES) -> tuple[dict[str, np.ndarray], int]:
    """Ranges of pieces and their places, and how many sequences there are.

    Each range: pieces of ``length`` with ranks from ``rank`` on, ``count`` of them, go to
    sequences from ``sequence`` on, one each, at ``offset``.
    """
    classes = max(1, min(classes, size))
    left = {k: v for k, v in histogram.items() if v > 0}
    taken: dict[int, int] = defaultdict(int)
    ranges: list[tuple[int, int, int, int, int]] = []
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> [(first sequence, count)]
    order: list[int] = []
    sequences = 0

    def place(length: int, count: int, sequence: int, offset: int) -> None:
        ranges.append((length, taken[length], count, sequence, offset))
        taken[length] += count
        left[length] -= count

    def open_room(room: int, sequence: int, count: int) -> None:
        if room and count:
            if not rooms[room]:
                bisect.insort(order, room)
            rooms[room].append((sequence, count))

    upper = lambda length: -(-length * classes // size)  # noqa: E731  the class whose upper end holds it
    members: dict[int, list[int]] = defaultdict(list)
    for length in sorted(left):
        members[upper(length)].append(length)
    lengths = sorted(left)
    counts = np.array([float(sum(left[x] for x in members[c + 1])) for c in range(classes)])
    if counts.any():
        a = patterns(classes)
        repeats = np.floor(non_negative_least_squares(a, counts) + 1e-6).astype(np.int64)
        for i in np.argsort(-repeats, kind="stable"):
            if repeats[i] <= 0:
                break
            slots = [c + 1 for c in np.flatnonzero(a[:, i]) for _ in range(int(a[c, i]))][::-1]
            need = int(repeats[i])
            while need > 0:
                # The longest pieces of each class; last, the longest piece of any class that
                # still fits. In runs of equal lengths.
                use: dict[int, int] = defaultdict(int)
                chosen = []
                for c in slots[:-1] or slots:
                    length = next((x for x in reversed(members[c]) if left[x] > use.get(x, 0)), 0)
                    use[length] += 1
                    chosen.append(length)
                if 0 in use:
                    break
                if slots[1:]:
                    at = bisect.bisect_right(lengths, size - sum(chosen)) - 1
                    while at >= 0 and left[lengths[at]] <= use.get(lengths[at], 0):
                        if not left[lengths[at]]:
                            lengths.pop(at)
                        at -= 1
                    if at < 0:
                        break
                    use[lengths[at]] += 1
                    chosen.append(lengths[at])
                run = min(need, *(left[x] // use[x] for x in use))
                offset = 0
                for length in chosen:
                    place(length, run, sequences, offset)
                    offset += length
                open_room(size - offset, sequences, run)
                sequences += run
                need -= run
    for length in sorted(left, reverse=True):
        while left[length] > 0:
            i = bisect.bisect_left(order, length)
            if i == len(order):
                fresh = -(-left[length] // (size // length))
                rooms_before = left[length]
                place(length, min(fresh, rooms_before), sequences, 0)
                open_room(size - length, sequences, min(fresh, rooms_before))
                sequences += fresh
                continue
            room = order[i]
            first, count = rooms[room].pop()
            if not rooms[room]:
                order.pop(i)
            use_n = min(count, left[length])
            place(length, use_n, first, size - room)
            open_room(room - length, first, use_n)
            open_room(room, first + use_n, count - use_n)
    ranges.sort()
    names = ("length", "rank", "count", "sequence", "offset")
    return {k: np.array([r[i] for r in ranges], np.int64) for i, k in enumerate(names)}, sequences


def pieces(docs: DataFrame, path: str, end_id: int = 1, size: int = SEQUENCE) -> DataFrame:
    """Documents cut into pieces; ``part`` and ``place`` number the pieces of each length in a task."""

    def cut(batches):
        from pyspark import TaskContext

        enc, part, seen = word_tokens.encoder(path), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            names = batch.column(0).to_pylist()
            rows: list[tuple] = []
            for name, ids in zip(names, enc.documents(["" if t is None else t for t in batch.column(1).to_pylist()], end_id), strict=True):
                raw = ids.astype("<u4").tobytes()
                for k, start in enumerate(range(0, len(ids), size)):
                    n = min(size, len(ids) - start)
                    rows.append((name, k, start, n, zlib.crc32(raw[4 * start : 4 * (start + n)]), part, int(seen[n])))
                    seen[n] += 1
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def pack(docs: DataFrame, path: str | None = None, end_id: int = 1, size: int = SEQUENCE) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``: a row a piece."""
    spark = docs.sparkSession
    cut = written(pieces(docs, path or word_tokens.default_path(), end_id, size), "pieces")
    # A row for each task and length; ranks run over the tasks in turn.
    counts = written(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row a length
    ranges, _ = plan(histogram, size)
    shared = spark.sparkContext.broadcast(ranges)  # follows the sequence size

    def placed(batches):
        r = shared.value
        keys = r["length"] << 48 | r["rank"]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            i = np.searchsorted(keys, length << 48 | rank, side="right") - 1
            out = [*batch.columns[:5], pa.array(r["sequence"][i] + rank - r["rank"][i], pa.int64()), pa.array(r["offset"][i], pa.int64())]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    # Both sides grow with the input, so neither is ever broadcast.
    ranked = cut.join(before.hint("merge"), ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("place") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(placed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
