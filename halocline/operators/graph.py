"""Connected components of an undirected graph, by labels that fall to the least reachable node."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import unwritten, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label).  Every round takes the least label of a node's neighbours and then the label of that label, so long
    paths shorten by half; rounds are cut by written tables, of which each replaces the one before, and end when no label changes."""
    both = written(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(edges.select(F.col(b).alias("x"), F.col(a).alias("y"))).distinct(), "both")
    labels = written(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label")).withColumnRenamed("x", "node"), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("y"), "label"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("m"))
        low = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        jump = low.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = written(low.join(jump, "label", "left").select("node", "was", F.least(F.col("label"), F.coalesce("further", F.col("label"))).alias("label")), "new")
        unwritten(labels)
        labels = new.select("node", "label")
        if new.where("label <> was").limit(1).count() == 0:
            unwritten(both)
            return labels
