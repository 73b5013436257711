"""Connected components of an edge table by minimum labels and pointer jumping, all on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, root) for every node that has an edge; root is the smallest node of its component.

    Each round takes the smallest label among a node's neighbours, then the label's own label, so
    chains shorten by half at least; rounds are checkpointed.  An empty table gives an empty result.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("root").alias("far"))
        new = cut(step.join(jump, "mid", "left").select("node", "old", F.least("mid", F.coalesce("far", "mid")).alias("root")))
        moved = new.where("root <> old").limit(1).count()
        labels = new.select("node", "root")
        if not moved:
            return labels
