"""Connected components by hash-to-min with pointer jumping, a written table a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, tag: str = "cc") -> DataFrame:
    """``node, comp`` for every node of edges ``a, b``; comp is the smallest node of its component.

    A round takes for each node the smallest label among its own and its neighbours', then the label of
    that label. Minima are pre-aggregated, so a hub's links are spread; rounds grow with the logarithm of
    the longest path. Nothing but a count of changes reaches the driver.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    links = scratch.save(both, f"{tag}-links")
    labels = scratch.save(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), f"{tag}-0")
    step = 0
    while True:
        near = links.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("m")), "b").groupBy(F.col("a").alias("node")).agg(F.min("m").alias("m"))
        stepped = labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "m").alias("low"))
        jumped = stepped.join(labels.select(F.col("node").alias("low"), F.col("comp").alias("far")), "low").select("node", "was", F.least("low", "far").alias("comp"))
        new = scratch.save(jumped, f"{tag}-{step + 1}")
        done = new.filter("was <> comp").isEmpty()
        scratch.drop(f"{tag}-{step}")
        labels, step = new.select("node", "comp"), step + 1
        if done:
            return labels
