"""Connected components by smallest label, with pointer jumping; every round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b); the component is its smallest node.

    A round takes the smallest label among neighbours and then the label's own
    label, so the rounds grow with the logarithm of the longest path.
    """
    both = scratch.keep(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = scratch.keep(labels.join(near, "node").select("node", F.col("component").alias("before"), F.least("component", "near").alias("component")))
        ahead = lower.select(F.col("node").alias("component"), F.col("component").alias("ahead"))
        after = scratch.keep(lower.join(ahead, "component").select("node", "before", F.col("ahead").alias("component")))
        changed = not after.where("component < before").isEmpty()
        scratch.drop(labels)
        scratch.drop(lower)
        labels = after.select("node", "component")
        labels._scratch_path = after._scratch_path
        if not changed:
            scratch.drop(both)
            return labels
