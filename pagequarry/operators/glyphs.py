"""Visual lines of glyphs on the fixed grid, a batch of lines of text as one array of code points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagequarry.sources.views import HIGH, PITCH, ROW, WIDE

#: Bytes of text that are worked on at a time, unless one line is longer.
TOGETHER = 1 << 22


def code_points(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts as ``(first row, code points, how many each text has)``."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + TOGETHER, side="right")) - 1)
        part = data[offsets[at] : offsets[end]]
        starts = np.append(0, np.cumsum((part & 0xC0) != 0x80))  # code points before each byte
        points = np.frombuffer(part.tobytes().decode().encode("utf-32-le"), "<u4")
        yield at, points, np.diff(starts[offsets[at : end + 1] - offsets[at]])
        at = end


def breaks(boxes: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Where a new visual line starts among boxes (rows of left, top, right, bottom) in order of ``line``.

    A glyph stays with the one before it if they share three tenths of the lesser height, or stand
    close above one another with half of the lesser width shared.
    """
    left, top, right, bottom = (boxes[:, k] for k in range(4))
    p, x = slice(None, -1), slice(1, None)
    low, high, wide = bottom - top, np.minimum(bottom[p], bottom[x]) - np.maximum(top[p], top[x]), right - left
    beside = 10 * high >= 3 * np.minimum(low[p], low[x])
    shared = np.minimum(right[p], right[x]) - np.maximum(left[p], left[x])
    stacked = (2 * shared >= np.minimum(wide[p], wide[x])) & (np.maximum(top[x] - bottom[p], top[p] - bottom[x]) < np.maximum(low[p], low[x]))
    fresh = np.zeros(len(boxes), bool)
    fresh[1:] = (line[1:] == line[:-1]) & ~beside & ~stacked
    return fresh


def placed_lines(lines_: DataFrame) -> DataFrame:
    """``doc_id, page, line, visual_line, start, n, l, t, r, b``: visual lines of lines of text; no shuffle.

    A blank has no box: it belongs to the visual line before it and breaks none; a line of blanks has no bounds.
    """

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            for first, points, counts in code_points(batch.column(3)):
                starts = np.cumsum(counts) - counts
                line = np.repeat(np.arange(len(counts)), counts)
                index = np.arange(len(points)) - starts[line]
                seen = np.flatnonzero(points != 0x20)
                column, row = index[seen] % ROW, index[seen] // ROW
                boxes = np.stack([column * WIDE, row * PITCH, (column + 1) * WIDE, row * PITCH + HIGH], axis=1)
                begin = np.sort(np.concatenate([starts[counts > 0], seen[breaks(boxes, line[seen])]]))
                n = np.diff(np.append(begin, len(points)))
                of = line[begin]
                low, high = np.searchsorted(seen, begin), np.searchsorted(seen, begin + n)
                some = high > low
                bounds = np.zeros((len(begin), 4), np.int64)
                if some.any():
                    for k, f in enumerate((np.minimum, np.minimum, np.maximum, np.maximum)):
                        bounds[some, k] = f.reduceat(boxes[:, k], low[some])
                nth = np.arange(len(begin)) - np.searchsorted(of, of)
                rows = pa.array(first + of)
                numbers = [pa.array(x, pa.int64()) for x in (nth, index[begin], n)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(rows) for k in range(3)), *numbers, *(pa.array(bounds[:, k], pa.int64(), mask=~some) for k in range(4))], ["doc_id", "page", "line", "visual_line", "start", "n", "l", "t", "r", "b"])

    return lines_.where("text <> ''").select("doc_id", "page", "line", "text").mapInArrow(run, "doc_id long, page long, line long, visual_line long, start long, n long, l long, t long, r long, b long")
