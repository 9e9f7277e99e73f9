"""Connected components of an edge table, by minimum hooking, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges(a, b)`` of any orderable type -> ``(node, root)`` for every node with an edge to another.

    Each round every node hooks to its smallest neighbour, the pointers are shortened, and the edges
    are contracted onto the roots; a star of any size vanishes in one round.  Only smallest-neighbour
    aggregates (combined before the shuffle) and joins are used, so that no neighbourhood is gathered,
    and each round is written to the shared folder.  An empty edge table gives an empty result.
    """
    live = scratch.write(edges.select("a", "b").where("a <> b").distinct())
    labels = None
    while not live.isEmpty():
        both = live.union(live.select("b", "a"))
        hook = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("p")).select("node", F.least("node", "p").alias("p"))
        hook = scratch.write(hook)
        for _ in range(2):
            up = hook.select(F.col("node").alias("p"), F.col("p").alias("pp"))
            hook = hook.join(up, "p").select("node", F.col("pp").alias("p"))
        hook = scratch.write(hook)
        if labels is None:
            labels = hook.withColumnRenamed("p", "root")
        else:
            moved = labels.join(hook.withColumnRenamed("node", "root"), "root", "left")
            labels = moved.select("node", F.coalesce("p", "root").alias("root"))
        labels = scratch.write(labels)
        to_a = hook.select(F.col("node").alias("a"), F.col("p").alias("pa"))
        to_b = hook.select(F.col("node").alias("b"), F.col("p").alias("pb"))
        live = live.join(to_a, "a").join(to_b, "b").where("pa <> pb")
        live = scratch.write(live.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    if labels is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
