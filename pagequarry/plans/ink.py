"""Pages as bitmaps of their characters: marks, runs, skew, blur, word lines.

The tables hold no pictures, so a page's rows of characters stand for rows of pixels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.operators import ink
from pagequarry.plans.registry import query
from pagequarry.sources.views import LINES_A_PAGE, LINES_SQL, ROW, table

TOGETHER = 256  # pages in one tall bitmap


def page_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, page, lines``: every page of a document as one row, without a shuffle."""
    cut = f"transform(sequence(0, cast((size(l) - 1) div {LINES_A_PAGE} as int)), k -> slice(l, k * {LINES_A_PAGE} + 1, {LINES_A_PAGE}))"
    return docs.where("text is not null").select("doc_id", F.split("text", "\n", -1).alias("l")).select("doc_id", F.posexplode(F.expr(cut)).alias("page", "lines"))


def bitmap(lines: list[str]) -> np.ndarray:
    """Characters of a page as ink, in rows of a page's width."""
    rows = [line[i : i + ROW].ljust(ROW) for line in lines for i in range(0, max(len(line), 1), ROW)]
    return (np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32) != 32).reshape(len(rows), ROW)


def each_batch(docs: DataFrame, schema: str, make) -> DataFrame:
    """``doc_id, page`` and what ``make`` says of batches of pages: page numbers in the batch, then columns."""
    names, kinds = zip(*(part.split() for part in schema.split(", ")), strict=True)
    types = [{"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[k] for k in kinds]

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(i, TOGETHER)
                at, *columns = make(part.column(2).to_pylist())
                rows = pa.array(at)
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), *[pa.array(c).cast(t) for c, t in zip(columns, types, strict=True)]], ["doc_id", "page", *names])

    return page_texts(docs).mapInArrow(run, f"doc_id long, page int, {schema}")


@query()
def ink_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks of touching ink on every page, with bounds and sizes."""
    return each_batch(table(spark, sf_dir, "documents"), "l long, t long, r long, b long, pixels long", lambda pages: ink.Sheets([bitmap(x) for x in pages]).blobs().T)


_PIXELS_SQL = f"""{LINES_SQL}, cut AS (SELECT doc_id, page, line, k, rpad(substring(text, k * {ROW} + 1, {ROW}), {ROW}, ' ') AS text FROM lines, LATERAL (SELECT unnest(range(greatest(CAST(ceil(length(text) / {ROW}.0) AS BIGINT), 1))) AS k)),
 rws AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY line, k) - 1 AS y, text FROM cut)"""


@query(f"""WITH {_PIXELS_SQL}, px AS (SELECT doc_id, page, y, x, substring(text, x + 1, 1) <> ' ' AS ink FROM rws, range({ROW}) r(x)), e AS (SELECT *, coalesce(lag(ink) OVER (PARTITION BY doc_id, page, y ORDER BY x), false) AS left_ink, coalesce(lag(ink) OVER (PARTITION BY doc_id, page, x ORDER BY y), false) AS above FROM px)
 SELECT doc_id, page::INT AS page, count(*) FILTER (ink AND NOT left_ink) AS row_runs, count(*) FILTER (ink AND NOT above) AS column_runs, count(*) FILTER (ink) AS pixels FROM e GROUP BY doc_id, page""")
def ink_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of ink along rows and columns, and pixels of ink, of every page."""

    def measures(pages):
        s = ink.Sheets([bitmap(x) for x in pages])
        down = s.ink & ~np.roll(s.ink, 1, axis=0)  # the row before a page is blank
        of = lambda rows, weight=None: np.bincount(s.page[rows], weight, minlength=s.pages).astype(np.int64)
        every = np.arange(len(s.ink))
        return np.arange(s.pages), of(s.runs()[0]), of(every, down.sum(axis=1)), of(every, s.ink.sum(axis=1))

    return each_batch(table(spark, sf_dir, "documents"), "row_runs long, column_runs long, pixels long", measures)


def _scores_sql(name: str, middle: str, by: int, reach: int) -> str:
    return f"""{name} AS (SELECT doc_id, page, slope, sum(n * n) AS score FROM (SELECT p.doc_id, p.page, {middle} + o.v AS slope, CAST(floor((y * 10000 - x * ({middle} + o.v)) / 10000) AS BIGINT) AS at, count(*) AS n FROM pts p {"JOIN c0 m USING (doc_id, page)" if "m." in middle else ""}, (SELECT unnest(range({-(reach // by) * by}, {reach + 1}, {by})) AS v) o GROUP BY ALL) GROUP BY ALL)"""


@query(f"""WITH {_PIXELS_SQL}, nx AS (SELECT *, coalesce(lead(text) OVER (PARTITION BY doc_id, page ORDER BY y), '') AS below FROM rws),
 every AS (SELECT doc_id, page, y, x FROM nx, range({ROW}) r(x) WHERE substring(text, x + 1, 1) <> ' ' AND substring(below, x + 1, 1) IN (' ', '')),
 pts AS (SELECT * FROM every QUALIFY count(*) OVER (PARTITION BY doc_id, page) >= {ink.LEAST_SAMPLES}),
 {_scores_sql("s0", "0", ink.COARSE, ink.MOST_SLOPE)}, c0 AS (SELECT doc_id, page, slope FROM s0 QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY score DESC, slope) = 1),
 {_scores_sql("s1", "m.slope", ink.FINE, ink.COARSE)}, c1 AS (SELECT doc_id, page, slope FROM s1 QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY score DESC, slope) = 1)
 SELECT DISTINCT doc_id, page::INT AS page, coalesce(slope, 0) AS slope FROM rws LEFT JOIN c1 USING (doc_id, page)""")
def page_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slope of every page's lines, in ten-thousandths."""

    def measures(pages):
        s = ink.Sheets([bitmap(x) for x in pages])
        return np.arange(s.pages), s.slopes()

    return each_batch(table(spark, sf_dir, "documents"), "slope long", measures)


@query()
def page_ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greyest place of every page after a blur, and the median height of its marks of eight pixels or more."""

    def measures(pages):
        bitmaps = [bitmap(x) for x in pages]
        blobs = ink.Sheets(bitmaps).blobs(8)
        darkest = [int(ink.box_blur(np.where(b, 0, 255).astype(np.uint8), 2).min()) for b in bitmaps]
        height, page = blobs[:, 4] - blobs[:, 2] + 1, blobs[:, 0]
        order = np.lexsort((height, page))
        counts = np.bincount(page, minlength=len(pages))
        middle = np.cumsum(counts) - counts + counts // 2
        heights = np.where(counts > 0, np.append(height[order], 0)[np.minimum(middle, len(order))], 0)
        return np.arange(len(pages)), np.array(darkest), heights

    return each_batch(table(spark, sf_dir, "documents"), "darkest long, height long", measures)


@query()
def recognised_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every page back in lines, by their boxes alone; boxes lean by a unit a word."""

    def lines_of(pages):
        at, number, words, left, top = [], [], [], [], []
        for page, lines in enumerate(pages):
            boxes = []
            for y, line in enumerate(lines):
                x = 0
                for k, w in enumerate(line.split(" ")):
                    if w:
                        boxes.append((10.0 * x, 16.0 * y + k % 4, 10.0 * (x + len(w)), 16.0 * y + k % 4 + 12))
                    x += len(w) + 1
            if boxes:
                boxes = np.array(boxes)
                line = ink.word_lines(boxes, 12.0)
                first = np.lexsort((boxes[:, 0], line))[np.flatnonzero(np.diff(np.sort(line), prepend=-1))]
                at += [page] * len(first)
                number += range(len(first))
                words += np.bincount(line).tolist()
                left += boxes[first, 0].tolist()
                top += boxes[first, 1].tolist()
        return at, number, words, left, top

    return each_batch(table(spark, sf_dir, "documents"), "line int, n_words int, l double, t double", lines_of)
