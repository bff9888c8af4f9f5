"""Connected components over a table of links, as joins and aggregations.

Every node holds the least node it knows of. A round takes the least label among a node's neighbours and then the
label of that label, so that stars settle at once and chains halve. Labels and links are written tables: a join of two
plain tables lets Spark split the rows of a hub, and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import Workspace

MAX_ROUNDS = 60


def components(work: Workspace, links: DataFrame, name: str) -> DataFrame:
    """links(a, b) to (node, root): the least node of its component for each node that has a link."""
    pairs = links.filter("a <> b").select("a", "b")
    both = work.write(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-both")
    labels, at = work.write(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")), f"{name}-0"), f"{name}-0"
    for i in range(1, MAX_ROUNDS):
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        known = labels.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        low = near.join(labels, F.col("a") == F.col("node")).select("node", "root", F.least("near", "root").alias("low"))
        after = low.join(known, F.col("low") == F.col("_n")).select("node", F.least("low", "_r").alias("root"), (F.least("low", "_r") < F.col("root")).alias("moved"))
        after = work.write(after, f"{name}-{i}")
        moved = after.filter("moved").limit(1).count()
        work.drop(at)
        labels, at = after.select("node", "root"), f"{name}-{i}"
        if not moved:
            return labels
    raise RuntimeError("components did not settle")
