"""Connected components as a loop of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epistola.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of edges(a, b): label is the smallest node of the component.

    Each round takes the least label among a node and its neighbours, then the label of that
    label (pointer jumping), and writes the labels to the shared folder, so lineage stays
    short; it ends with the first round that changes nothing.
    """
    both = edges.select("a", "b").where("a != b")
    both = materialize(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("l")), "b").groupBy(F.col("a").alias("node")).agg(F.min("l").alias("near"))
        least = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        after = materialize(least.join(jump, "label", "left").select("node", F.least("label", "far").alias("label"), "was"), "labels")
        labels = after.select("node", "label")
        if after.where("label != was").isEmpty():
            return labels
