"""Trees as rows with parents: depths and ancestors by doubling, a logarithm of joins whatever the tree's shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The deepest level kept: outlines end there.
DEEPEST = 64


def depths(nodes: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """``node, parent, depth`` of the nodes that hang on a root (parent null), ``deepest`` levels below it at most.

    Each round doubles how far a node has looked up; nodes of a cycle reach no root and go.
    """
    walk = nodes.select("node", "parent", F.col("parent").alias("at"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth"))
    for _ in range(deepest.bit_length()):
        up = walk.select(F.col("node").alias("_node"), F.col("at").alias("_at"), F.col("depth").alias("_depth"))
        walk = walk.join(up, F.col("at") == F.col("_node"), "left").select("node", "parent", F.when(F.col("_node").isNotNull(), F.col("_at")).otherwise(F.col("at")).alias("at"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"))
    return walk.where(F.col("at").isNull() & (F.col("depth") <= deepest)).select("node", "parent", "depth")


def nearest_ancestor(nodes: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """``node, ancestor``: the nearest meaningful one above, else null.

    ``nodes`` has ``node, parent, meaningful``. Each round joins what a node has reached with
    what that one has reached, so ``deepest`` levels take its logarithm of joins.
    """
    up = nodes.select("node", "parent", "meaningful")
    first = up.alias("n").join(up.select(F.col("node").alias("p"), F.col("meaningful").alias("good")), F.col("n.parent") == F.col("p"), "left")
    walk = first.select("node", F.when(F.col("good"), F.col("p")).alias("ancestor"), F.when(~F.col("good"), F.col("p")).alias("at"))
    for _ in range(deepest.bit_length()):
        above = walk.select(F.col("node").alias("_node"), F.col("ancestor").alias("_ancestor"), F.col("at").alias("_at"))
        walk = walk.join(above, F.col("at") == F.col("_node"), "left").select("node", F.coalesce("ancestor", "_ancestor").alias("ancestor"), F.col("_at").alias("at"))
    return walk.select("node", "ancestor")
