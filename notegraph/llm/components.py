"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL_ROWS, cut, fewer


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of ``links`` (a, b): the smallest node reachable.

    Each round takes the least label among neighbours, then the label of the label, so
    that chains halve; a star ends in two rounds.  Labels never leave the executors.
    Self-links and repeated links are harmless; no links give an empty table.  The labels
    of a small graph are copied to the tasks, so a round shuffles one table.
    """
    both = cut(links.select("a", "b").union(links.select("b", "a")).distinct())
    both = fewer(both, fewer(both).count())
    labels = cut(both.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")))
    nodes = fewer(labels).count()
    copied = F.broadcast if nodes <= SMALL_ROWS else lambda df: df
    while True:
        labels = fewer(labels, nodes)
        near = both.join(copied(labels.withColumnRenamed("node", "b")), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("least"))
        lower = fewer(cut(near.join(copied(labels), "node").select("node", F.col("component").alias("old"), F.least("component", "least").alias("component"))), nodes)
        jump = lower.select(F.col("node").alias("component"), F.col("component").alias("root"))
        moved = cut(lower.join(copied(jump), "component").select("node", "old", F.col("root").alias("component")))
        labels = moved.select("node", "component")
        if moved.where("component < old").isEmpty():
            return labels
