"""Connected components of an edge table, by distributed hooking and jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querywright.llm.common import drop_written, spread_join, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node it can reach.

    A round finds the least label next to each node, gives it to the node and also to
    the node that its label names, then replaces each label by that one's own label.
    As roots are hooked too, whole trees move and not only their rims: a path of 2000
    nodes in random order takes nine rounds.  Rounds go on until no node has a
    neighbour with a smaller label; labels only fall, so that comes, and then all of a
    component have the label of its smallest node.  Each round is written in the shared
    folder, and the round before it is deleted.  The edges of a hub, or the nodes of one
    label, don't meet in one task: both joins are spread.  Nodes are longs; edges to
    oneself and repeated edges do no harm.
    """
    spark = edges.sparkSession
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(edges.select(F.col(b).alias("x"), F.col(a).alias("y")))
    both = written(both.distinct(), "cc-edges")
    labels = written(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("l"), F.count(F.lit(1)).alias("n")), "cc-labels")
    sums = labels.agg(F.count(F.lit(1)).alias("nodes"), F.coalesce(F.sum("n"), F.lit(0)).alias("ends")).first()
    nodes, ends = sums["nodes"], sums["ends"]
    while nodes:
        told = labels.select(F.col("x").alias("y"), "l", "n")
        near = spread_join(both, told, "y", "n", ends).groupBy("x").agg(F.min("l").alias("m"))
        seen = written(labels.join(near, "x").select("x", "l", "m", "n"), "cc-seen")
        lower = seen.where(F.col("m") < F.col("l"))
        if lower.isEmpty():
            drop_written(spark, seen, both)
            return labels.select(F.col("x").alias("node"), F.col("l").alias("root"))
        hooks = lower.groupBy(F.col("l").alias("x")).agg(F.min("m").alias("h"))
        step = written(seen.join(hooks, "x", "left").select("x", F.least("l", "m", "h").alias("l"), "n"), "cc-step")
        held = step.groupBy("l").agg(F.count(F.lit(1)).alias("k"))
        jump = step.select(F.col("x").alias("l"), F.col("l").alias("ll")).join(held, "l")
        after = written(spread_join(step, jump, "l", "k", nodes).select("x", F.least("l", "ll").alias("l"), "n"), "cc-labels")
        drop_written(spark, seen, step, labels)
        labels = after
    return labels.select(F.col("x").alias("node"), F.col("l").alias("root"))
