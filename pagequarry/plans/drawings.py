"""Vector regions as pictures (S12), figures among marks of ink."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.operators import ink, raster
from pagequarry.operators.spatial import near_groups
from pagequarry.plans.ink import bitmap, each_batch
from pagequarry.plans.registry import query
from pagequarry.sources.views import table

SIDE = 40
#: Dots an inch, points that parts of one drawing lie apart at most, and what is worth a picture at least.
DPI, REACH, LEAST_SIDE, LEAST_PARTS = 300, 12.0, 12.0, 2
#: Pixels of a glyph at least, and of a mark that says how high glyphs are; how much larger, wider or sparser than a glyph a drawing is, in hundredths.
LEAST_GLYPH, SOUND_MARK, TALL, WIDE, SPARSE, BOTH = 4, 8, 260, 900, 22, 130
#: Rows of labels from which on a figure is text, and glyphs that a figure is wide and high at least, alone or in parts.
LABEL_ROWS, ALONE, PARTS = 4, (6, 4), (3, 2)
#: Drawings that are filled together.
TOGETHER = 256


@query(f"""WITH c AS (SELECT l_orderkey AS drawing, l_linenumber AS n, l_partkey % {SIDE} AS x, l_suppkey * 7 % {SIDE} AS y FROM lineitem),
 e AS (SELECT drawing, x AS x0, y AS y0, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x1, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y1 FROM c WINDOW w AS (PARTITION BY drawing ORDER BY n, x, y)),
 p AS (SELECT e.drawing, px, py, CASE WHEN y1 > y0 THEN 1 ELSE -1 END AS d FROM e, range({SIDE}) b(py), range({SIDE}) a(px) WHERE least(y0, y1) <= py + 0.5 AND greatest(y0, y1) > py + 0.5 AND x0 + (py + 0.5 - y0) * (x1 - x0)::DOUBLE / nullif(y1 - y0, 0) <= px + 0.5),
 w AS (SELECT drawing, px, py, sum(d) AS w FROM p GROUP BY ALL)
 SELECT drawing, count(*) AS pixels, CAST(sum(px) AS BIGINT) AS sum_x, CAST(sum(py) AS BIGINT) AS sum_y FROM w WHERE CASE WHEN drawing % 2 = 1 THEN w % 2 <> 0 ELSE w <> 0 END GROUP BY drawing""")
def filled_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of closed paths, by the even-odd rule for odd orders and the non-zero rule for others; an order's lines are the corners."""
    corner = F.struct(F.col("l_linenumber").alias("n"), (F.col("l_partkey") % SIDE).alias("x"), (F.col("l_suppkey") * 7 % SIDE).alias("y"))
    paths = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("drawing")).agg(F.array_sort(F.collect_list(corner)).alias("corners"))  # an order's few lines

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                lists = part.column(1)
                counts = np.diff(lists.offsets.to_numpy())
                corners = lists.flatten()
                points = np.stack([corners.field(k).to_numpy().astype(np.float64) for k in (1, 2)], axis=1)
                owner = np.repeat(np.arange(part.num_rows), counts)
                sums = np.zeros((3, part.num_rows), np.int64)
                for top, seen in raster.bands(raster.edges_of(points, owner), owner, part.column(0).to_numpy() % 2 == 1, part.num_rows, SIDE, SIDE):
                    rows = np.arange(top, top + seen.shape[1])
                    sums += np.stack([seen.sum(axis=(1, 2)), (seen * np.arange(SIDE)[None, None]).sum(axis=(1, 2)), (seen * rows[None, :, None]).sum(axis=(1, 2))])
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, sums)], ["drawing", "pixels", "sum_x", "sum_y"])

    return paths.mapInArrow(run, "drawing long, pixels long, sum_x long, sum_y long").where("pixels > 0")


def pictures(objects: DataFrame, dpi: int = DPI) -> DataFrame:
    """``path, page, nth, l, t, r, b, png``: the drawings of pages (``objects`` of page files), each as a picture.

    Paths that nearly touch are one drawing, in their order; one of a single small path is none. Rules and filled rectangles by
    themselves are carried as data. Pages go by their own, so a page's paths travel to one place.
    """
    kinds = "path string, page int, nth int, l double, t double, r double, b double, png binary"

    def run(batches):
        for batch in batches:
            for path, page, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = near_groups([(p["l"], p["t"], p["r"], p["b"]) for p in parts], REACH)
                nth = 0
                for (left, top, right, bottom), members in sorted(found, key=lambda g: (g[0][1], g[0][0])):
                    if len(members) < LEAST_PARTS and min(right - left, bottom - top) < LEAST_SIDE:
                        continue
                    png = raster.png(drawn([parts[m] for m in sorted(members)], (left, top, right, bottom), dpi))
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((path, page, nth, left, top, right, bottom, png), (pa.string(), pa.int32(), pa.int32(), *[pa.float64()] * 4, pa.binary()), strict=True)], [k.split()[0] for k in kinds.split(", ")])
                    nth += 1

    one = F.struct("idx", "l", "t", "r", "b", "fill", "line", "width", "rule", "shape")
    pages = objects.where("kind = 'path' and shape is not null").groupBy("path", "page").agg(F.array_sort(F.collect_list(one)).alias("parts"))
    return pages.mapInArrow(run, kinds)


def drawn(parts: list[dict], box: tuple[float, float, float, float], dpi: int) -> np.ndarray:
    """Parts in their order and colours on white."""
    scale = dpi / 72
    left, top, right, bottom = box
    width, height = (max(1, round((b - a) * scale)) for a, b in ((left, right), (top, bottom)))
    out = np.full((height, width, 3), 255, np.uint8)
    for part in parts:
        shape = np.array(part["shape"], np.float64).reshape(-1, 2)
        breaks = np.isnan(shape[:, 0])
        pieces, points = np.cumsum(breaks)[~breaks], (shape[~breaks] - (left, top)) * scale
        colour = lambda c: (c >> 16, c >> 8 & 255, c & 255)
        if part["fill"] is not None:
            out[raster.filled(raster.edges_of(points, pieces), width, height, part["rule"] == "even-odd")] = colour(part["fill"])
        if part["line"] is not None:
            out[raster.filled(raster.stroked(points, pieces, max(part["width"] * scale, 1.0)), width, height)] = colour(part["line"])
    return out


def glyph_size(blobs: np.ndarray) -> int:
    """The upper median height of marks (``l, t, r, b, pixels``, ends included), ten where none is large enough to say."""
    heights = np.sort((blobs[:, 3] - blobs[:, 1] + 1)[blobs[:, 4] >= SOUND_MARK])
    return max(LEAST_GLYPH, int(heights[len(heights) // 2]) if len(heights) else 10)


def is_text(area: tuple, lines: np.ndarray, glyph: int) -> bool:
    """Whether what looks like a figure is ink over text, as a line runs far through it, or is full of rows of text."""
    left, top, right, bottom = area
    shared = np.minimum(lines[:, 2], right) > np.maximum(lines[:, 0], left)
    high = np.minimum(lines[:, 3], bottom) - np.maximum(lines[:, 1], top)
    there = lines[shared & (high > 0) & (2 * high >= lines[:, 3] - lines[:, 1])]
    beyond = np.maximum(left - there[:, 0], 0) + np.maximum(there[:, 2] - right, 0)
    if (2 * beyond > right - left).any():
        return True
    rows: list[float] = []
    for middle in ((there[:, 1] + there[:, 3]) / 2).tolist():
        if not any(abs(r - middle) < glyph for r in rows):
            rows.append(middle)
            if len(rows) >= LABEL_ROWS:
                return True
    return False


def figures(blobs: np.ndarray, lines: np.ndarray) -> list[tuple]:
    """``l, t, r, b, parts, labels, text`` of a page's figures: groups of marks that are no glyphs, two glyphs apart at most.

    ``labels`` counts the marks within a figure, its own parts among them; ``lines`` are the boxes of lines of text. From the top down.
    """
    glyph = glyph_size(blobs)
    wide, high = blobs[:, 2] - blobs[:, 0] + 1, blobs[:, 3] - blobs[:, 1] + 1
    sparse = (100 * blobs[:, 4] < SPARSE * wide * high) & (100 * high > BOTH * glyph) & (100 * wide > BOTH * glyph)
    drawing = blobs[(100 * high > TALL * glyph) | (100 * wide > WIDE * glyph) | sparse]
    out = []
    for (left, top, right, bottom), members in near_groups([(a, b, c + 1, d + 1) for a, b, c, d, _ in drawing.tolist()], 2 * glyph, home="last"):
        w, h = right - left, bottom - top
        if w < PARTS[0] * glyph or h < PARTS[1] * glyph or (len(members) < 2 and w < ALONE[0] * glyph and h < ALONE[1] * glyph):
            continue
        inside = (blobs[:, 0] >= left) & (blobs[:, 1] >= top) & (blobs[:, 2] < right) & (blobs[:, 3] < bottom)
        out.append((left, top, right, bottom, len(members), int(inside.sum()), is_text((left, top, right, bottom), lines, glyph)))
    return sorted(out, key=lambda f: f[1])


@query()
def page_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures among the marks of every page, and whether they are text after all; a page's rows are its lines."""

    def measures(pages):
        bitmaps = [bitmap(x) for x in pages]
        blobs = ink.Sheets(bitmaps).blobs()
        page, found = [], []
        for i, seen in enumerate(bitmaps):
            rows = np.flatnonzero(seen.any(axis=1))
            lines = np.stack([seen[rows].argmax(axis=1), rows, seen.shape[1] - seen[rows][:, ::-1].argmax(axis=1), rows + 1], axis=1) if len(rows) else np.zeros((0, 4), np.int64)
            for f in figures(blobs[blobs[:, 0] == i, 1:], lines):
                page.append(i)
                found.append(f)
        return (np.array(page, np.int64), *np.array(found, np.int64).reshape(-1, 7).T)

    return each_batch(table(spark, sf_dir, "documents"), "l long, t long, r long, b long, parts long, labels long, text long", measures).withColumn("text", F.col("text") == 1)
