"""Connected components of an edge table, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``; root is the smallest node reachable. Nulls are left out; no edges, no rows.

    Each round takes the least label of the neighbours and then the label's own label, so rounds grow with the logarithm of
    a component's width; each is written to the shared folder, which keeps lineage short.
    """
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x is not null and y is not null")
    both = written(e.union(e.select("y", "x")).distinct(), "edges")
    labels = written(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("root")), "labels")
    while True:
        near = both.join(labels, both.y == labels.node).groupBy("x").agg(F.min("root").alias("m"))
        step = labels.join(near, labels.node == near.x).select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        jump = step.select(F.col("node").alias("via"), F.col("root").alias("to"))
        new = written(step.join(jump, step.root == jump.via, "left").select("node", "old", F.coalesce("to", "root").alias("root")), "labels")
        forget(labels)
        if new.filter("old <> root").isEmpty():
            return new.select("node", "root")
        labels = new.select("node", "root")
