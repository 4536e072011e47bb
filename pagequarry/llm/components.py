"""Connected components of links by alternating stars, in DataFrames only.

Each round hangs every node's larger neighbours on its least neighbour and then flattens what is
left; the number of rounds grows with the logarithm of the longest chain, and links that are stars
already take none. Every round's edges are written to the shared folder, so a lost executor costs
one round at most; those of the round before go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import dropped, written


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")


def _large_star(edges: DataFrame) -> DataFrame:
    both = _both(edges)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    hung = joined.select(F.explode(F.array(F.col("v"), F.col("u"))).alias("u"), F.col("m").alias("v"))
    return hung.where("u <> v").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node that hangs on another (``u`` on ``v``) is in that one edge alone."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("hangs")), F.struct(F.col("v").alias("id"), F.lit(0).alias("hangs")))).alias("e")).select("e.*")
    return ends.groupBy("id").agg(F.max("hangs").alias("hangs"), F.count("*").alias("edges")).where("hangs = 1 and edges > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``id, component`` for each node of ``links`` (``u``, ``v`` longs) but the least ones."""
    edges = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while not _stars(edges):
        old, edges = edges, written(_small_star(_large_star(edges)), "stars")
        dropped(old)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
