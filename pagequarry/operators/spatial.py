"""Boxes by place: a grid of levels, groups of near boxes, boxes kept apart.

A box lies in the level whose cells are at least as large as it, so in four cells at most; a
question looks into the cells that it covers on each level in use. What a group of boxes is
depends on the order that they come in, so they are taken in that order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame

Box = tuple[float, float, float, float]


class Grid:
    """Numbered boxes, found by what they meet."""

    def __init__(self) -> None:
        self.boxes: dict[int, Box] = {}
        self.levels: dict[int, dict[tuple[int, int], set[int]]] = {}
        self.count: dict[int, int] = {}

    @staticmethod
    def _cells(box: Box, level: int) -> Iterator[tuple[int, int]]:
        a, b, c, d = (math.floor(math.ldexp(x, -level)) for x in box)
        return ((x, y) for x in range(a, c + 1) for y in range(b, d + 1))

    @staticmethod
    def _level(box: Box) -> int:
        return math.frexp(max(box[2] - box[0], box[3] - box[1], 1e-9))[1]

    def add(self, number: int, box: Box) -> None:
        level = self._level(box)
        self.boxes[number] = box
        cells = self.levels.setdefault(level, {})
        self.count[level] = self.count.get(level, 0) + 1
        for cell in self._cells(box, level):
            cells.setdefault(cell, set()).add(number)

    def remove(self, number: int) -> Box:
        box = self.boxes.pop(number)
        level = self._level(box)
        cells = self.levels[level]
        self.count[level] -= 1
        for cell in self._cells(box, level):
            cells[cell].discard(number)
            if not cells[cell]:
                del cells[cell]
        if not self.count[level]:
            del self.levels[level], self.count[level]
        return box

    def near(self, box: Box, touching: bool = False) -> list[int]:
        """Numbers, ascending, of the boxes that share area with ``box``, or with ``touching`` an edge at least."""
        found: set[int] = set()
        for level, cells in self.levels.items():
            a, b, c, d = (math.floor(math.ldexp(x, -level)) for x in box)
            if (c - a + 1) * (d - b + 1) > len(cells):  # a question wider than all that is there
                for (x, y), numbers in cells.items():
                    if a <= x <= c and b <= y <= d:
                        found |= numbers
            else:
                for x in range(a, c + 1):
                    for y in range(b, d + 1):
                        found |= cells.get((x, y), set())
        meet = meets_or_touches if touching else meets
        return sorted(n for n in found if meet(self.boxes[n], box))


def meets(a: Box, b: Box) -> bool:
    return a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3]


def meets_or_touches(a: Box, b: Box) -> bool:
    return a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]


def inflated(box: Box, by: float) -> Box:
    return box[0] - by, box[1] - by, box[2] + by, box[3] + by


def union(*boxes: Box) -> Box:
    left, top, right, bottom = zip(*boxes, strict=True)
    return min(left), min(top), max(right), max(bottom)


def near_groups(boxes: list[Box], reach: float, kinds: list | None = None, home: str = "first", touching: bool = False) -> list[tuple[Box, list[int]]]:
    """Groups of boxes with their bounds and members: a box joins the groups whose bounds it comes within ``reach`` of.

    Boxes are taken in the order given; groups are not compared again once they have grown. ``home`` says
    which group takes the others in: the ``first`` of those near, the ``last`` one, or a ``new`` one at
    the end of the list. A new one grows while the groups before it are looked at from the last to the first, so it
    also takes what only the grown bounds come near. Groups hold boxes of one kind, if ``kinds`` are given.
    """
    grids: dict = {}
    members: dict[int, list[int]] = {}
    bounds: dict[int, Box] = {}
    number = 0
    for i, box in enumerate(boxes):
        grid = grids.setdefault(kinds[i] if kinds else None, Grid())
        if home == "new":
            now, held, before = box, [i], number
            while taken := [k for k in grid.near(inflated(now, reach), touching) if k < before]:
                before = taken[-1]
                now = union(now, grid.remove(before))
                held = members.pop(before) + held
                del bounds[before]
            grid.add(number, now)
            bounds[number], members[number] = now, held
            number += 1
            continue
        near = grid.near(inflated(box, reach), touching)
        if not near:
            grid.add(number, box)
            bounds[number], members[number] = box, [i]
            number += 1
            continue
        to = near[0] if home == "first" else near[-1]
        others = [k for k in near if k != to]
        now = union(box, *(grid.remove(k) for k in near))
        members[to] = members[to] + [i] + [m for k in others for m in members.pop(k)]
        for k in others:
            del bounds[k]
        grid.add(to, now)
        bounds[to] = now
    return [(bounds[k], members[k]) for k in sorted(members)]


def kept_apart(boxes: DataFrame, key: str, order: list[str], always: Column) -> DataFrame:
    """The boxes (``l, t, r, b``) of each ``key`` that are kept: in ``order``, those of ``always`` and those that meet none kept before.

    A key's boxes stream past its grid; nothing is gathered, and what is held are the kept ones.
    """
    names = [key, *order, "l", "t", "r", "b"]
    schema = boxes.select(*names).schema

    def run(batches):
        now, first, grid = None, True, Grid()
        for batch in batches:
            kept = []
            for i, (k, free, *box) in enumerate(zip(*(batch.column(j).to_pylist() for j in (0, len(names), *range(len(names) - 4, len(names)))), strict=True)):
                if first or k != now:
                    now, first, grid = k, False, Grid()
                if free or not grid.near(tuple(box)):
                    grid.add(len(grid.boxes), tuple(box))
                    kept.append(i)
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], names).take(pa.array(kept, pa.int64()))

    rows = boxes.select(*names, always.alias("free")).repartition(key).sortWithinPartitions(key, *order)
    return rows.mapInArrow(run, schema)
