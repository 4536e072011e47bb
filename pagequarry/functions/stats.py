"""Exact order statistics as aggregates. Ranks are chosen as stated, never interpolated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sorted(v: Column) -> Column:
    return F.array_sort(F.collect_list(v))


def upper_median(v: Column) -> Column:
    """Element n div 2 of the ascending values, from 0."""
    return F.get(_sorted(v), F.floor(F.count(v) / 2).cast("int"))


def lower_median(v: Column) -> Column:
    """Element (n - 1) div 2 of the ascending values, from 0."""
    return F.get(_sorted(v), F.floor((F.count(v) - 1) / 2).cast("int"))


def nearest_rank(v: Column, share: float) -> Column:
    """Element (n - 1) * share, rounded half to even."""
    return F.get(_sorted(v), F.bround((F.count(v) - 1) * share).cast("int"))


def ranked_groups(df, keys: list[str], value: str, picks: dict[str, Column], count: str | None = None):
    """One value a group and pick, by rank instead of a list of a group's values.

    ``picks`` maps a name to a rank (from 0) as an expression of ``n``, the group's size, which ``count`` may name as well. Values
    are counted first, so a group of any size costs one row a distinct value, and only running
    counts over distinct values are kept in order.
    """
    from pyspark.sql import Window

    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    over = Window.partitionBy(*keys)
    ranked = counts.withColumn("_end", F.sum("_c").over(over.orderBy(value))).withColumn("n", F.sum("_c").over(over))
    hit = [F.max(F.when((F.col("_end") > rank) & (F.col("_end") - F.col("_c") <= rank), F.col(value))).alias(name) for name, rank in picks.items()]
    return ranked.groupBy(*keys).agg(*hit, *([F.max("n").alias(count)] if count else []))
