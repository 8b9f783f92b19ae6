"""Connected components of a graph of edges, by spreading the smallest label and following it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantis.session import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of (a, b): equal labels within a component, the smallest node.

    Each round is stored; labels also jump to their own label's label, so that the number of rounds
    grows with the logarithm of a component's width.
    """
    both = stored(edges.union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).select(
        "node", F.least("node", "label").alias("label")
    ), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(near, F.col("node") == F.col("a")).select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        target = labels.select(F.col("node").alias("at"), F.col("label").alias("further"))
        moved = stored(
            spread.join(target, F.col("label") == F.col("at")).select("node", "old", F.least("label", "further").alias("label")),
            "labels",
        )
        labels = moved.select("node", "label")
        if moved.filter("label != old").isEmpty():
            return labels
