"""Scanned pages as pixel arrays, a batch of pages at a time: marks of ink, runs, blur, skew, words in lines.

The pages of a batch stand below each other in one tall bitmap with a blank row after each, so
that every step works on all of them at once and nothing touches across pages.
"""

from __future__ import annotations

import math

import numpy as np

#: Pixels a mark needs, points a page's skew is measured from.
LEAST_PIXELS, LEAST_SAMPLES = 4, 200
#: Slopes that are tried, in ten-thousandths: up to about six degrees, in wide steps and then in narrow ones.
MOST_SLOPE, COARSE, FINE = 1050, 70, 9


class Sheets:
    """Bitmaps of several pages, stacked. ``ink`` has a blank row after each page; ``first`` its first row."""

    def __init__(self, bitmaps: list[np.ndarray]) -> None:
        heights = np.array([len(b) for b in bitmaps], np.int64)
        width = max((b.shape[1] for b in bitmaps if len(b)), default=0)
        self.first = np.cumsum(heights + 1) - heights - 1
        self.heights, self.pages = heights, len(bitmaps)
        self.ink = np.zeros((int((heights + 1).sum()), width), bool)
        for b, at in zip(bitmaps, self.first.tolist(), strict=True):
            self.ink[at : at + len(b), : b.shape[1]] = b
        self.page = np.repeat(np.arange(self.pages), heights + 1)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of ink along the rows: row, first and last column, in reading order."""
        edges = np.diff(np.pad(self.ink, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        rows, first = np.nonzero(edges == 1)
        return rows, first, np.nonzero(edges == -1)[1] - 1

    def blobs(self, least: int = LEAST_PIXELS) -> np.ndarray:
        """Marks of ink that touch, corners included: rows of page, left, top, right, bottom (inclusive), pixels.

        Runs of neighbouring rows that meet are edges of a graph; the least run number spreads
        along them, with pointers halved each round, until nothing changes.
        """
        rows, first, last = self.runs()
        if not len(rows):
            return np.zeros((0, 6), np.int64)
        width = self.ink.shape[1] + 2
        # The runs of the row above that reach into this run's columns, one to each side, follow one another.
        low = np.searchsorted(rows * width + last, (rows - 1) * width + first - 1, side="left")
        high = np.searchsorted(rows * width + first, (rows - 1) * width + last + 1, side="right")
        many = np.maximum(high - low, 0)
        below = np.repeat(np.arange(len(rows)), many)
        above = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        label = np.arange(len(rows))
        while True:
            fresh = label.copy()
            meet = np.minimum(label[below], label[above])
            np.minimum.at(fresh, label[below], meet)
            np.minimum.at(fresh, label[above], meet)
            fresh = fresh[fresh]
            if np.array_equal(fresh, label):
                break
            label = fresh
        _, at = np.unique(label, return_inverse=True)
        order = np.argsort(at, kind="stable")
        cuts = np.flatnonzero(np.diff(at[order], prepend=-1))
        of = lambda f, v: f.reduceat(v[order], cuts)
        pixels = of(np.add, last - first + 1)
        page = self.page[of(np.minimum, rows)]
        found = np.stack([page, of(np.minimum, first), of(np.minimum, rows) - self.first[page], of(np.maximum, last), of(np.maximum, rows) - self.first[page], pixels], axis=1)
        return found[pixels >= least]

    def slopes(self) -> np.ndarray:
        """The slope of each page's lines in ten-thousandths, down to the right; 0 with too few points.

        Points are the lower ends of ink along columns. A slope's score is the sum of squared
        counts of points on rows sheared by it; the greatest wins, of equal ones the least slope:
        first among wide steps, then among narrow ones around that.
        """
        y, x = np.nonzero(self.ink & ~np.roll(self.ink, -1, axis=0))  # a page's blank last row ends all runs
        page = self.page[y]
        y = y - self.first[page]
        enough = np.bincount(page, minlength=self.pages) >= LEAST_SAMPLES
        use = enough[page]
        page, y, x = page[use], y[use], x[use]
        best = np.zeros(self.pages, np.int64)
        if not len(page):
            return best
        for around, by, reach in ((best.copy(), COARSE, MOST_SLOPE), (None, FINE, COARSE)):
            middle = best if around is None else around
            offsets = np.arange(-(reach // by) * by, reach + 1, by)
            scores = np.empty((len(offsets), self.pages))
            for k, offset in enumerate(offsets.tolist()):
                at = (y * 10_000 - x * (middle[page] + offset)) // 10_000
                at -= at.min()
                counts = np.unique(page * (int(at.max()) + 1) + at, return_counts=True)
                scores[k] = np.bincount(counts[0] // (int(at.max()) + 1), counts[1].astype(np.float64) ** 2, minlength=self.pages)
            best = np.where(enough, middle + offsets[scores.argmax(axis=0)], 0)
        return best


def box_blur(grey: np.ndarray, radius: int) -> np.ndarray:
    """Means over squares, along rows and then columns, whole division, edges repeated."""
    radius = max(1, min(radius, min(grey.shape) // 2))
    out = grey
    for axis in (1, 0):
        pads = [(0, 0), (0, 0)]
        pads[axis] = (radius + 1, radius)
        sums = np.cumsum(np.pad(out.astype(np.int64), pads, mode="edge"), axis=axis)
        wide = 2 * radius + 1
        upper, lower = np.take(sums, np.arange(wide, sums.shape[axis]), axis), np.take(sums, np.arange(sums.shape[axis] - wide), axis)
        out = ((upper - lower) // wide).astype(np.uint8)
    return out


def word_lines(boxes: np.ndarray, glyph: float, column: np.ndarray | None = None) -> np.ndarray:
    """The line of each word, numbered by their first words from the left; ``boxes`` has left, top, right, bottom.

    A word goes on with the line of its ``column`` whose end shares most of the lesser height with it, over half of
    it, unless it starts more than half a glyph before that end. Open ends lie in strips by height, so that a
    word meets those at its own height only.
    """
    line, ends, strips = np.zeros(len(boxes), np.int64), [], {}
    strip = 2 * max(glyph, 1e-9)
    across = lambda top, bottom: range(math.floor(top / strip), math.floor(bottom / strip) + 1)
    rows, columns = boxes.tolist(), [0] * len(boxes) if column is None else column.tolist()
    for i in np.argsort(boxes[:, 0], kind="stable").tolist():
        left, top, _, bottom = rows[i]
        own = columns[i]
        best, most = len(ends), 0.5
        for k in sorted({k for y in across(top, bottom) for k in strips.get((own, y), ())}):
            _, top0, right0, bottom0 = ends[k]
            lesser = min(bottom - top, bottom0 - top0)
            if left >= right0 - glyph / 2 and lesser > 0 and (part := (min(bottom, bottom0) - max(top, top0)) / lesser) > most:
                best, most = k, part
        if best == len(ends):
            ends.append(rows[i])
        else:
            for y in across(ends[best][1], ends[best][3]):
                strips[own, y].discard(best)
            ends[best] = rows[i]
        for y in across(top, bottom):
            strips.setdefault((own, y), set()).add(best)
        line[i] = best
    return line
