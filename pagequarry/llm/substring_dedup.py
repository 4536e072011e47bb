"""Substring dedup by hashed units: lines, paragraphs, or windows of words.

Units are normalised (A-Z as a-z, white space as nothing but a divider of words), digested,
grouped over all documents; the occurrence with the least rank (``doc_id``, place) stays, and the
words of all others are removed. The digest has 96 bits out of two independent hashes.

With ``unit="line"`` or ``"paragraph"`` (blank lines between) a unit is what stands between line
breaks, of ``least_words`` words at least. That finds no passage which starts or ends within a
line, so the default unit is a window of ``run_words`` words. Which windows of a text are taken
depends on its words alone: those that start where a sentence or line starts, those that end
where one ends, and of every ``NEAR`` windows in succession the one of least hash, with starts of
sentences before others. So a repeat finds its windows wherever it stands: one of whole sentences
or lines from ``run_words`` words on and to its exact ends, any other from ``run_words + NEAR``
words on. Of a repeat that starts or ends within a sentence up to ``NEAR`` words at that end may
stay; a common line or sentence of fewer words by itself stays. In scripts without blanks a
character counts as a word.

The result keeps the spans that were removed as code point offsets into the original text, each
with the document that keeps the first unit of the run.

Defined cases: null and empty texts are unchanged; rows with a null ``doc_id`` take no part and
are unchanged; equal rows (same ``doc_id`` and text) count once and are treated alike, rows with
one ``doc_id`` and different texts are ranked by a hash of the text; a window that overlaps its
own first occurrence stays; texts of any length are worked on whole; extra columns are kept (one
named ``removed_spans`` is replaced).
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import dropped, forget_caches, mix64, release_shuffles, utf8_parts, written
from pagequarry.llm.words import LOWER, _powers, word_hashes, word_spans

RUN_WORDS, NEAR = 20, 20
SLICES = 8  # bits of a digest that name a slice of the map of repeated ones
_BASES = (0xD1342543DE82EF95, 0x9E6C63D0876A9A47)
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in _BASES)
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True
_STOPS = np.array([0xE38082, 0xEFBC81, 0xEFBC9F])  # the full-width stops
SPANS = "array<struct<start:int,end:int,kept_doc_id:bigint>>"


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words as ``word_spans`` has them, but each character of a script without blanks by itself.

    These are Thai, Lao, Burmese, Khmer, kana, Chinese characters and their full-width marks.
    """
    starts, ends, counts = word_spans(data, offsets)
    at = np.flatnonzero(data >= 0xE0)
    if not len(at):
        return starts, ends, counts
    lead, second = data[at], data[np.minimum(at + 1, len(data) - 1)]
    alone = (lead >= 0xE3) & (lead <= 0xE9) | (lead == 0xE0) & (second >= 0xB8) & (second <= 0xBB) | (lead == 0xE1) & ((second <= 0x82) | (second == 0x9E) | (second == 0x9F))
    alone |= (lead == 0xEF) & ((second == 0xBC) | (second == 0xBD) | (second >= 0xA4) & (second <= 0xAB)) | (lead == 0xF0) & (second >= 0xA0)
    at = at[alone]
    cuts = np.union1d(at, at + np.where(data[at] == 0xF0, 4, 3))
    word = np.searchsorted(starts, cuts, side="right") - 1
    inside = (word >= 0) & (starts[word] < cuts) & (cuts < ends[word])
    starts, ends = np.sort(np.concatenate([starts, cuts[inside]])), np.sort(np.concatenate([ends, cuts[inside]]))
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def _stops(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether words that end there end a sentence."""
    a, b, c = (data[np.maximum(ends - k, 0)].astype(np.int64) for k in (3, 2, 1))
    return _STOP[data[ends - 1]] | np.isin(a << 16 | b << 8 | c, _STOPS)


def _sliding(values: np.ndarray, size: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over each ``size`` values in succession."""
    have = 1
    while have < size:
        step = min(have, size - have)
        values = pick(values[:-step], values[step:])
        have += step
    return values


def _sums(words: np.ndarray, base: int) -> np.ndarray:
    """Running sums of which differences, scaled back, hash any run of words."""
    out = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _powers(base, len(words)), out=out[1:])
    return out


def windows(data: np.ndarray, offsets: np.ndarray, run_words: int = RUN_WORDS, near: int = NEAR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The windows taken of several texts: text, first word within it, two hashes."""
    low = LOWER[data]
    starts, ends, counts = pieces(low, offsets)
    n, many = len(starts), len(starts) - run_words + 1
    if many < 1:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    text = np.repeat(np.arange(len(counts)), counts)
    last = np.ones(n, bool)
    last[:-1] = _stops(data, ends[:-1]) | (lines[starts[1:]] != lines[starts[:-1]]) | (text[1:] != text[:-1])
    first = np.concatenate([[True], last[:-1]])[:many]
    words = word_hashes(low, starts, ends)
    with np.errstate(over="ignore"):
        sums = _sums(words, _BASES[0])
        h1 = mix64((sums[run_words:] - sums[:many]) * _powers(_INVERSES[0], n)[:many])
    whole = text[run_words - 1 :] == text[:many]
    taken = first | last[run_words - 1 :]
    if many >= near:
        order = h1 >> np.uint64(1) | np.where(first, np.uint64(0), np.uint64(1 << 63))
        least = _sliding(order, near, np.minimum)
        least[text[run_words + near - 2 :] != text[: len(least)]] = 0  # of windows of one text only
        side = np.zeros(near - 1, np.uint64)
        taken |= _sliding(np.concatenate([side, least, side]), near, np.maximum) == order
    at = np.flatnonzero(taken & whole)
    with np.errstate(over="ignore"):
        sums = _sums(mix64(words), _BASES[1])
        h2 = mix64((sums[at + run_words] - sums[at]) * _powers(_INVERSES[1], n)[at])
    return text[at], at - (np.cumsum(counts) - counts)[text[at]], h1[at], h2


def lines(data: np.ndarray, offsets: np.ndarray, least_words: int = 1, breaks: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lines (with two ``breaks`` the paragraphs) of several texts: text, first word, words, two hashes."""
    low = LOWER[data]
    starts, ends, counts = pieces(low, offsets)
    n = len(starts)
    text = np.repeat(np.arange(len(counts)), counts)
    breaks_before = np.concatenate([[0], np.cumsum(data == 10)])
    first = np.ones(n, bool)
    first[1:] = (breaks_before[starts[1:]] - breaks_before[ends[:-1]] >= breaks) | (text[1:] != text[:-1])
    at = np.flatnonzero(first)
    size = np.diff(np.append(at, n))
    at, size = at[size >= least_words], size[size >= least_words]
    words, hashes = word_hashes(low, starts, ends), []
    with np.errstate(over="ignore"):
        for k, values in enumerate((words, mix64(words))):
            sums = _sums(values, _BASES[k])
            hashes.append(mix64((sums[at + size] - sums[at]) * _powers(_INVERSES[k], max(n, 1))[at] + size.astype(np.uint64)))
    return text[at], at - (np.cumsum(counts) - counts)[text[at]], size, hashes[0], hashes[1]


UNITS = ("window", "line", "paragraph")


def units(data: np.ndarray, offsets: np.ndarray, unit: str, run_words: int, least_words: int):
    """What is compared of several texts: text, first word, words, two hashes."""
    if unit == "window":
        text, place, h1, h2 = windows(data, offsets, run_words)
        return text, place, np.full(len(text), run_words), h1, h2
    return lines(data, offsets, least_words, 1 + UNITS.index(unit) // 2)


def _digests(docs: DataFrame, unit: str, run_words: int, least_words: int, repeated=None) -> DataFrame:
    """A row a unit; with a broadcast map only units that it marks."""

    def run(batches):
        forget_caches()
        for batch in batches:
            for a, _, data, offsets in utf8_parts(batch.column(2), 1 << 20):
                text, place, size, h1, h2 = units(data, offsets, unit, run_words, least_words)
                if repeated is not None:
                    spot = _spots(h1, len(repeated.value))
                    marked = (repeated.value[spot >> 3] >> (spot & 7).astype(np.uint8) & 1).astype(bool)
                    text, place, size, h1, h2 = text[marked], place[marked], size[marked], h1[marked], h2[marked]
                row = pa.array(text + a)
                out = [pa.array(h1.view(np.int64)), pa.array((h2 >> np.uint64(32)).astype(np.uint32).view(np.int32)), batch.column(0).take(row), batch.column(1).take(row), pa.array(place.astype(np.int32)), pa.array(size.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(out, ["h1", "h2", "doc_id", "th", "place", "size"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text").where("doc_id is not null").mapInArrow(run, "h1 long, h2 int, doc_id long, th long, place int, size int")


def _spots(h1: np.ndarray, size: int) -> np.ndarray:
    """The bits of digests in a map of ``size`` bytes, by their top bits."""
    return (h1 >> np.uint64(64 - (size.bit_length() + 2))).astype(np.int64)


def _repeated_map(digests: DataFrame) -> np.ndarray:
    """A bit map that marks the digests ``h1`` given, of 16 bits a digest within bounds; wrong marks are harmless."""
    bits = min(30, max(20, (16 * digests.count()).bit_length()))
    size = 1 << (bits - 3)
    each = size >> SLICES

    def run(table: pa.Table) -> pa.Table:
        h1 = table["h1"].to_numpy().view(np.uint64)
        flags = np.zeros(each * 8, np.uint8)
        flags[_spots(h1, size) & (each * 8 - 1)] = 1
        return pa.table({"slice": pa.array([int(h1[0] >> np.uint64(64 - SLICES))], pa.int32()), "marks": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(size, np.uint8)
    for row in digests.select("h1").groupBy(F.shiftrightunsigned("h1", 64 - SLICES)).applyInArrow(run, "slice int, marks binary").toLocalIterator():
        out[row["slice"] * each : (row["slice"] + 1) * each] = np.frombuffer(bytes(row["marks"]), np.uint8)
    return out


def repeats(docs: DataFrame, run_words: int = RUN_WORDS, unit: str = "window", least_words: int = 1) -> DataFrame:
    """``doc_id, th, place, size, kept``: units that repeat an earlier one; ``kept`` is its document."""
    release_shuffles(docs.sparkSession)  # of what made ``docs``
    # Half of each digest moves by itself first, then whole units of those that repeat: a second pass over the texts costs less than keeping all.
    several = _digests(docs, unit, run_words, least_words).groupBy("h1").agg(F.count("*").alias("n")).where("n > 1").select("h1")
    several = written(several, "repeated-units")
    release_shuffles(docs.sparkSession)
    marks = docs.sparkSession.sparkContext.broadcast(_repeated_map(several))
    dropped(several)
    # Both sides read one shuffle, since their columns and conditions are the same; its rows are in the order of the texts, which packs better than the order of digests.
    whole = " and ".join(f"{c} is not null" for c in ("h1", "h2", "doc_id", "th"))
    again = _digests(docs, unit, run_words, least_words, marks).where(whole).repartition("h1", "h2")
    first = again.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "th", "place", "size")).alias("first"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "first")
    later = "struct(doc_id, th, place, size) > first and not (doc_id = first.doc_id and th = first.th and place < first.place + size)"
    return again.join(first.hint("merge"), ["h1", "h2"]).where(later).select("doc_id", "th", "place", "size", F.col("first.doc_id").alias("kept"))


def cut(text: str, repeated: dict[int, tuple[int, int]]) -> tuple[str, list[tuple[int, int, int]]]:
    """The text without the words of its repeated units (first word to ``(words, kept)``), and what was removed."""
    raw = np.frombuffer(text.encode(), np.uint8)
    starts, *_ = pieces(LOWER[raw], np.array([0, len(raw)], np.int64))
    runs, n = [], len(starts)
    for a in sorted(repeated):
        end = a + repeated[a][0]
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(end, runs[-1][1])
        else:
            runs.append([a, end])
    if not runs:
        return text, []
    places = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # code points before a byte
    kept, spans, at = [], [], 0
    for a, b in runs:
        start = int(places[starts[a]])
        end = int(places[starts[b]]) if b < n else len(text)
        kept.append(text[at:start])
        spans.append((start, end, repeated[a][1]))
        at = end
    kept.append(text[at:])
    return "".join(kept), spans


def dedup(docs: DataFrame, run_words: int = RUN_WORDS, unit: str = "window", least_words: int = 1) -> DataFrame:
    """``docs`` with the repeats cut from ``text`` and their ``removed_spans`` as a last column."""
    own = {x: f"{x}-{uuid.uuid4().hex}" for x in ("doc_id", "th", "found")}  # names that no column has
    found = repeats(docs, run_words, unit, least_words).repartition("doc_id", "th").distinct().groupBy(F.col("doc_id").alias(own["doc_id"]), F.col("th").alias(own["th"])).agg(F.collect_list(F.struct("place", "size", "kept")).alias(own["found"]))
    docs = docs.drop("removed_spans")
    names = docs.columns
    at = names.index("text")
    same = (docs["doc_id"].cast("long") == F.col(f"`{own['doc_id']}`")) & (F.xxhash64(docs["text"]) == F.col(f"`{own['th']}`"))
    joined = docs.join(found, same, "left").select(*[docs[f"`{x}`"] for x in names], F.col(f"`{own['found']}`"))
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kept_doc_id", pa.int64())]))

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                texts, spans = part.column(at).to_pylist(), []
                for k, given in enumerate(part.column(len(names)).to_pylist()):
                    if not given:
                        spans.append([])
                        continue
                    texts[k], gone = cut(texts[k], {x["place"]: (x["size"], x["kept"]) for x in given})
                    spans.append([{"start": a, "end": b, "kept_doc_id": c} for a, b, c in gone])
                columns = list(part.columns[: len(names)])
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, spans_type)], [*names, "removed_spans"])

    return joined.mapInArrow(run, f"{fields}, removed_spans {SPANS}")
