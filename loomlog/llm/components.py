"""Connected components of a table of links, by joins that shrink the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.batches import cut, drop


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): label is the smallest node of each component; nodes without links don't appear.

    Each round gives every node the smallest label among itself and its
    neighbours, then follows labels twice (pointer jumping), so long chains
    take a logarithmic number of rounds.  Labels are cut each round.
    """
    edges = cut(links.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(links.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct())
    labels = cut(edges.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("label")))
    while True:
        near = edges.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        step = cut(labels.join(near, "node").select("node", F.col("label").alias("before"), F.least("label", "near").alias("label")))
        # the label that the label's own node has, and that one's: a hot label is only looked up
        hop = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
        before, labels = labels, cut(step.join(hop, "label", "left").select("node", "before", F.coalesce("next", "label").alias("label")))
        drop(before, step)
        if labels.filter("label != before").isEmpty():
            drop(edges)
            return labels.select("node", "label")
