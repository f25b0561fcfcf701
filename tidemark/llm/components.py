"""Connected components of a link table, on the executors only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import settle


def components(links: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) of every node of links(a, b).

    Each round takes the least label among a node's neighbours and then the label's own label, so
    that paths halve; labels are written to the shared folder after each round. Self-links and
    repeated links do no harm; no links give an empty result.
    """
    both = settle(links.select(F.col("a").alias("v"), F.col("b").alias("w")).union(links.select("b", "a")).distinct(), "links")
    labels = settle(both.groupBy("v").agg(F.min("w").alias("least")).select("v", F.least("v", "least").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("v", "w"), "w").groupBy("v").agg(F.min("label").alias("near"))
        step = labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("v").alias("label"), F.col("label").alias("higher"))
        labels = settle(step.join(up, "label", "left").select("v", "old", F.least("label", "higher").alias("label")), "labels")
        if labels.filter("old <> label").isEmpty():
            return labels.select(F.col("v").alias("node"), F.col("label").alias("component"))
