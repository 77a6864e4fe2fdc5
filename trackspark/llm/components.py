"""Connected components of a link table, without gathering any component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of the links (a, b: longs), label being the smallest node reachable.

    Each round a node takes the smallest label among its neighbours and then its label's label, so that distances
    halve; rounds end when no label changes. Every round is a table in the shared folder. A node with very many links
    is only a join key, whose rows can be split over tasks.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = written(both, "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).select("node", F.least("node", "label").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("least"))
        moved = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "least").alias("label"))
        parents = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        moved = moved.join(parents, "label", "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label"))
        moved = written(moved, "labels")
        labels = moved.select("node", "label")
        if moved.filter("label <> old").isEmpty():
            return labels
