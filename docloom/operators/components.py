"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.sources.workspace import cut_lineage


def connected_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """nodes(node), edges(a, b) to (node, root): root is the least node of its component.

    Each round takes the least label among neighbours and then the label of that label, so that long chains halve;
    rounds are checkpointed to the shared folder, and the loop ends when no label changes.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = cut_lineage(both)
    labels = cut_lineage(nodes.select("node").distinct().withColumn("root", F.col("node")))
    for _ in range(max_rounds):
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        better = labels.join(near, F.col("node") == F.col("a"), "left").select("node", "root", F.least("root", "near").alias("low"))
        jump = better.select(F.col("node").alias("_n"), F.col("low").alias("_l"))
        after = cut_lineage(better.join(jump, F.col("low") == F.col("_n"), "left").select("node", "root", F.least("low", "_l").alias("low")))
        changed = after.filter("low < root").limit(1).count()
        labels = after.select("node", F.col("low").alias("root"))
        if not changed:
            return labels
    raise RuntimeError("components did not settle")
