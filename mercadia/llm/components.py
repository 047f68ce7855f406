"""Connected components of links: labels move along edges and are then shortened, until none changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercadia.llm._common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node reachable.

    Every round is written to the shared folder. A round takes the least label among a node's neighbours
    and then the label of that label, which halves the way to the root.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("low"))
        moved = labels.join(near, labels["node"] == near["a"]).select("node", "root", F.least("root", "low").alias("new"))
        moved = stored(moved, "moved")
        jump = moved.select(F.col("node").alias("new"), F.col("new").alias("next"))
        done = stored(moved.join(jump, "new", "left").select("node", F.coalesce("next", "new").alias("root"), (F.coalesce("next", "new") != F.col("root")).alias("changed")), "labels")
        labels = done.select("node", "root")
        if not done.where("changed").limit(1).count():
            return labels
