"""Quality classifier: random Fourier features of document statistics, ridge, isotonic.

Statistics of a whole text (shares of letter cases, digits, marks, repeats, line shapes, ...)
are standardised and mapped to cosines of random projections, which approximate a Gaussian
kernel. Ridge weights solve normal equations that the tasks sum; an isotonic step, fitted by
pooling adjacent violators on a histogram of the scores, turns scores into probabilities.

The fit takes at most about ``max_rows`` labelled documents, chosen by a hash of the id; the
statistics' means, the equations and the histogram cover all of those.

Defined cases: null or empty text has zero statistics and gets a score like any other, and a text
of any length is read whole; a null label takes no part; several labels of a document count each; without labelled documents every
score is 1.0 (nothing is known against a document); with labels of one class only, every score
is that class; a null ``doc_id`` is scored and never trained on; extra columns are passed
through by ``scored`` and ignored by the fit (columns named like its own are replaced).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import dropped, forget_caches, held_out, utf8_parts, written
from pagequarry.llm.words import LOWER, word_hashes, word_spans

FEATURES, RIDGE, BINS, MAX_ROWS, THRESHOLD = 256, 1.0, 2048, 200_000, 0.7
PART = 1 << 18  # bytes of text that a task measures at a time
SLICES = 8  # tasks that sum the equations: the bounded training rows need no more

_CLASSES = np.zeros((9, 256), np.uint8)
for _i, _bytes in enumerate((range(65, 91), range(97, 123), range(48, 58), b".,;:'\"()-", b"!?", b"#$%&*@^~`", b"|<>{}[]\\/=+_", b"\n", range(128, 256))):
    _CLASSES[_i, list(_bytes)] = 1
STATISTICS = 22


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ``STATISTICS`` numbers a text."""
    n = np.diff(offsets)
    sums = np.empty((len(_CLASSES), len(n)))
    for i, one in enumerate(_CLASSES):
        run = np.zeros(len(data) + 1, np.int64)
        np.cumsum(one[data], out=run[1:])
        sums[i] = run[offsets[1:]] - run[offsets[:-1]]
    upper, lower, digit, stop, shout, symbol, table, line, wide = sums
    size, letters = np.maximum(n, 1), np.maximum(upper + lower + wide / 2, 1)
    starts, ends, counts = word_spans(data, offsets)
    words = np.maximum(counts, 1)
    bounds = np.concatenate([[0], np.cumsum(counts)])

    def per_text(values):
        run = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
        return run[bounds[1:]] - run[bounds[:-1]]

    long = (ends - starts).astype(np.float64)
    hashes = word_hashes(LOWER[data], starts, ends)
    text = np.repeat(np.arange(len(n)), counts)

    def same(back):
        out = np.zeros(len(hashes), bool)
        out[back:] = (hashes[back:] == hashes[:-back]) & (text[back:] == text[:-back])
        return per_text(out) / words

    first, last = data[starts] if len(starts) else data[:0], data[ends - 1] if len(ends) else data[:0]
    isup = (first >= 65) & (first <= 90)
    ends_up = (last >= 65) & (last <= 90)
    mark = _CLASSES[5][last] > 0
    point = np.isin(last, np.frombuffer(b".!?", np.uint8))
    lines = line + 1
    columns = [
        np.log1p(n), np.log1p(counts), per_text(long) / words, np.sqrt(np.maximum(per_text(long**2) / words - (per_text(long) / words) ** 2, 0)),
        upper / letters, digit / size, stop / size, shout / size, symbol / size, table / size, line / size, wide / size,
        np.log1p(counts / lines), per_text(isup) / words, per_text(isup & ends_up & (long > 1)) / words, per_text(mark) / words, per_text(point) / words,
        per_text(long <= 2) / words, per_text(long >= 14) / words, same(1), same(2), np.log1p(lines),
    ]
    return np.stack(columns, axis=1)


@dataclass
class QualityModel:
    """All that scoring needs; its size is fixed. ``weights`` None: constant score ``prior``."""

    prior: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    turns: np.ndarray | None = None
    phase: np.ndarray | None = None
    weights: np.ndarray | None = None
    knots: np.ndarray | None = None
    values: np.ndarray | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([np.cos(z @ self.turns + self.phase) * np.sqrt(2 / len(self.phase)), z, np.ones((len(z), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0.0, 1.0)


def isotonic(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The non-decreasing values nearest to ``y`` with weights ``w``."""
    blocks: list[list[float]] = []
    for value, weight in zip(y.tolist(), w.tolist(), strict=True):
        blocks.append([value * weight, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, k, m = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += k
            blocks[-1][2] += m
    return np.repeat([b[0] / b[1] for b in blocks], [int(b[2]) for b in blocks])


def _statistics_rows(rows: DataFrame) -> DataFrame:
    """The statistics of ``text`` beside the label ``y`` and its weight ``w``."""

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in utf8_parts(batch.column(0), PART):
                x = statistics(data, offsets)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a)], ["x", "y", "w"])

    return rows.select("text", "y", "w").mapInArrow(run, "x binary, y double, w double")


def _summed(rows: DataFrame, f, shape: tuple[int, ...]) -> np.ndarray:
    """The sum over ``SLICES`` tasks of ``f(x, y, w)``; rows are bounded, so are the partial sums."""

    def run(batches):
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(v.as_py() for v in batch.column(0))).reshape(-1, STATISTICS)
                total += f(x, *(batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2)))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    parts = rows.coalesce(SLICES).mapInArrow(run, "total binary").collect()
    return sum((np.frombuffer(bytes(p["total"])).reshape(shape) for p in parts), np.zeros(shape))


def fit(docs: DataFrame, labels: DataFrame, features: int = FEATURES, ridge: float = RIDGE, max_rows: int = MAX_ROWS, seed: int = 7) -> QualityModel:
    """Learn from rows of ``labels`` (``doc_id``, ``quality``) that are not held out."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y"))
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id", "y").agg(F.count("*").cast("double").alias("w"))
    labelled = known = written(known, "quality-labels")
    n = known.count()
    if n > max_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_rows / n))
    # About ``max_rows`` ids and labels, 24 bytes each: their texts are found before any statistics are made.
    picked = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")
    rows = written(_statistics_rows(picked), "quality-rows")
    dropped(labelled)
    p = STATISTICS
    total = _summed(rows, lambda x, y, w: np.concatenate([[w.sum(), (w * y).sum()], w @ x, w @ x**2]), (2 + 2 * p,))
    n, good = total[:2]
    if n == 0 or good in (0, n):
        return QualityModel(1.0 if n == 0 else float(good / n))
    rng = np.random.default_rng(seed)
    mean = total[2 : 2 + p] / n
    scale = np.sqrt(np.maximum(total[2 + p :] / n - mean**2, 0)) + 1e-9 + 1e-6 * np.abs(mean)
    model = QualityModel(float(good / n), mean, scale, rng.normal(size=(p, features)) / np.sqrt(p), rng.uniform(0, 2 * np.pi, features))
    d = features + p + 1

    def equations(x, y, w):
        z = model.features(x)
        return np.concatenate([z.T @ (z * w[:, None]), (z.T @ (w * y))[:, None]], axis=1)

    sums = _summed(rows, equations, (d, d + 1))
    penalty = np.full(d, ridge)
    penalty[-1] = 0
    model.weights = np.linalg.solve(sums[:, :d] + np.diag(penalty) + 1e-9 * np.eye(d), sums[:, d])
    edges = np.linspace(-0.5, 1.5, BINS + 1)

    def histogram(x, y, w):
        raw = model.raw(x)
        at = np.clip(np.searchsorted(edges, raw, side="right") - 1, 0, BINS - 1)
        return np.stack([np.bincount(at, w * v, minlength=BINS) for v in (1.0, y, raw)])

    count, hits, place = _summed(rows, histogram, (3, BINS))
    dropped(rows)
    has = count > 0
    model.knots = np.maximum.accumulate(place[has] / count[has])
    model.values = isotonic(hits[has] / count[has], count[has])
    return model


def scored(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD, only_good: bool = False) -> DataFrame:
    """``docs`` with ``quality_score`` (0 to 1) and ``quality_predicted`` after its columns.

    With ``only_good`` the rows that the classifier rejects go, and no column is added.
    """
    if not only_good:
        docs = docs.drop("quality_score", "quality_predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches):
        forget_caches()
        for batch in batches:
            for a, b, data, offsets in utf8_parts(batch.column(at), PART):
                score = shared.value.score(statistics(data, offsets))
                part = batch.slice(a, b - a)
                if only_good:
                    yield part.filter(pa.array(score >= threshold))
                else:
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*part.schema.names, "quality_score", "quality_predicted"])

    return docs.mapInArrow(run, fields if only_good else f"{fields}, quality_score double, quality_predicted int")
