"""Connected components of an edge table, by contraction along minimum neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node of each node's component. Nulls and loops in edges link nothing.

    Each round sends a node to its least neighbour's least neighbour, contracts what has met, and goes on with the
    edges that are left between different nodes; these shrink fast, and the rounds grow as the logarithm of a
    component's width. Each round is written to the shared folder.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct()
    pairs = materialize(pairs.union(pairs.select("b", "a")).distinct())
    labels = None
    while pairs.limit(1).count():
        least = pairs.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("least"))
        least = materialize(least)
        jump = materialize(least.join(least.select(F.col("node").alias("least"), F.col("least").alias("to")), "least").select("node", "to"))
        if labels is None:
            labels = jump.select("node", F.col("to").alias("label"))
        else:
            labels = materialize(labels.join(jump.select(F.col("node").alias("label"), "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label")))
        left = pairs.join(jump.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").select("x", "b")
        left = left.where("x <> b").join(jump.select(F.col("node").alias("b"), F.col("to").alias("y")), "b").where("x <> y")
        pairs = materialize(left.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("label")) if labels is None else labels
