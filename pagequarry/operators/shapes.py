"""Plan shapes that several queries share: islands, as-of lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], order: list[str], starts: Column, name: str = "island") -> DataFrame:
    """Number runs of rows within ``keys``; ``starts`` is true where a run begins."""
    over = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(over.rowsBetween(Window.unboundedPreceding, 0)))


def as_of(points: DataFrame, marks: DataFrame, keys: list[str], at: str, order: list[str], values: list[str]) -> DataFrame:
    """For each point the last mark at or before it (``at`` on both sides), null if none.

    Marks and points are ordered together within ``keys``, so no pair of them is ever joined;
    ``order`` breaks ties among marks, the later one wins.
    """
    rest = [c for c in points.columns if c not in keys and c != at]
    m = marks.select(*keys, at, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.struct(*values).alias("_v"), F.lit(0).alias("_point"), *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in rest])
    q = points.select(*keys, at, *[F.lit(None).cast(marks.schema[c].dataType).alias(f"_o{i}") for i, c in enumerate(order)], F.lit(None).cast(m.schema["_v"].dataType).alias("_v"), F.lit(1).alias("_point"), *rest)
    over = Window.partitionBy(*keys).orderBy(at, "_point", *[f"_o{i}" for i in range(len(order))]).rowsBetween(Window.unboundedPreceding, 0)
    found = m.unionByName(q).withColumn("_v", F.last("_v", ignorenulls=True).over(over)).where("_point = 1")
    return found.select(*keys, at, *rest, *[F.col("_v")[v].alias(v) for v in values])
