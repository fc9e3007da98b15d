"""Connected components of a graph given as edges, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node. No edges give no rows.

    Labels spread to neighbours and are then replaced by the label of the label, so long chains take few rounds. Minima
    are pre-aggregated on the map side; every round is written to the shared folder, which cuts the lineage.
    """
    both = staged(edges.filter(F.col(a) != F.col(b)).select(F.col(a).alias("src"), F.col(b).alias("dst")).unionByName(
        edges.filter(F.col(a) != F.col(b)).select(F.col(b).alias("src"), F.col(a).alias("dst"))).distinct(), "edges")
    labels = staged(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("label")), "labels")
    while True:
        near = both.join(labels, both.src == labels.node).groupBy("dst").agg(F.min("label").alias("m"))
        spread = labels.join(near, labels.node == near.dst).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        spread = staged(spread, "spread")
        jump = spread.select(F.col("node").alias("at"), F.col("label").alias("further"))
        moved = spread.join(jump, F.col("label") == F.col("at"), "left").select("node", "old", F.least("label", "further").alias("label"))
        moved = staged(moved, "labels")
        if moved.filter("old <> label").isEmpty():
            return moved.select("node", F.col("label").alias("component"))
        labels = moved.select("node", "label")
