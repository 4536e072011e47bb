"""Rectangles and points as columns. A rectangle is a struct ``l, t, r, b``; y grows downwards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rect(left, top, right, bottom) -> Column:
    return F.struct(left.alias("l"), top.alias("t"), right.alias("r"), bottom.alias("b"))


def width(x: Column) -> Column:
    return x["r"] - x["l"]


def height(x: Column) -> Column:
    return x["b"] - x["t"]


def is_empty(x: Column) -> Column:
    return (width(x) <= 0) | (height(x) <= 0)


def centre_in(x: Column, y: Column) -> Column:
    """Whether the centre of ``x`` is in ``y``, borders included; doubled to stay whole."""
    cx, cy = x["l"] + x["r"], x["t"] + x["b"]
    return cx.between(2 * y["l"], 2 * y["r"]) & cy.between(2 * y["t"], 2 * y["b"])


def contains(x: Column, px: Column, py: Column, tolerance=0) -> Column:
    """Closed on all sides, with a tolerance."""
    return px.between(x["l"] - tolerance, x["r"] + tolerance) & py.between(x["t"] - tolerance, x["b"] + tolerance)


def intersects(x: Column, y: Column) -> Column:
    """Open: touching is not meeting, and empty rectangles meet nothing."""
    return ~is_empty(x) & ~is_empty(y) & (x["l"] < y["r"]) & (y["l"] < x["r"]) & (x["t"] < y["b"]) & (y["t"] < x["b"])


def union(x: Column, y: Column) -> Column:
    """The rectangle around both; an empty one adds nothing."""
    both = rect(F.least(x["l"], y["l"]), F.least(x["t"], y["t"]), F.greatest(x["r"], y["r"]), F.greatest(x["b"], y["b"]))
    return F.when(is_empty(x), y).when(is_empty(y), x).otherwise(both)


def intersection(x: Column, y: Column) -> Column:
    return rect(F.greatest(x["l"], y["l"]), F.greatest(x["t"], y["t"]), F.least(x["r"], y["r"]), F.least(x["b"], y["b"]))


def inflate(x: Column, by) -> Column:
    return rect(x["l"] - by, x["t"] - by, x["r"] + by, x["b"] + by)


def distance2(x: Column, px: Column, py: Column) -> Column:
    """Squared distance of a point from a rectangle."""
    dx = F.greatest(x["l"] - px, px - x["r"], F.lit(0))
    dy = F.greatest(x["t"] - py, py - x["b"], F.lit(0))
    return dx * dx + dy * dy


def rotated(x: Column, quarter_turns: Column, w: Column, h: Column) -> Column:
    """A rectangle of a page of ``w`` by ``h`` after clockwise quarter turns."""
    k = F.pmod(quarter_turns, F.lit(4))
    return (
        F.when(k == 1, rect(h - x["b"], x["l"], h - x["t"], x["r"]))
        .when(k == 2, rect(w - x["r"], h - x["b"], w - x["l"], h - x["t"]))
        .when(k == 3, rect(x["t"], w - x["r"], x["b"], w - x["l"]))
        .otherwise(x)
    )
