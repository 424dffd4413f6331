"""Connected components of a graph given by its edges, as joins and aggregates over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node with an edge; a component is named by its smallest node.

    Every round takes the smallest label among neighbours and then the label's own label, so a path of n nodes takes about log(n)
    rounds. Nothing but the number of changed labels reaches the driver.
    """
    both = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).where("u != v").distinct(), "edges", release=False)
    labels = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("component")), "labels", release=False)
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), F.col("component").alias("c")), "v").groupBy("u").agg(F.min("c").alias("c"))
        met = labels.join(near, labels["node"] == near["u"], "left").select("node", F.col("component").alias("old"), F.least("component", "c").alias("c"))
        jump = labels.select(F.col("node").alias("j"), F.col("component").alias("jc"))
        new = written(met.join(jump, met["c"] == jump["j"], "left").select("node", "old", F.least("c", "jc").alias("component")), "labels", release=False)
        dropped(labels)
        labels = new.select("node", "component")
        if not new.where("component != old").limit(1).count():
            dropped(both)
            return labels
