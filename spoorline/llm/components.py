"""Connected components of an edge table, as Spark joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoorline.session import stored


def components(edges: DataFrame) -> DataFrame:
    """(key, label) of every node of ``edges(a, b)``: the smallest key it is linked to.

    Each round a node takes the smallest label around it and then that label's own
    label, so distances shrink by halves. Labels live in a scratch table between rounds.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both.where("a <> b"), "links")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("key"), F.least("a", "b").alias("label")), "labels")
    while True:
        around = both.join(labels.select(F.col("key").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        nearer = labels.join(around.withColumnRenamed("a", "key"), "key").select("key", F.col("label").alias("old"), F.least("label", "near").alias("via"))
        jump = labels.select(F.col("key").alias("via"), F.col("label").alias("jump"))
        new = stored(nearer.join(jump, "via").select("key", "old", F.least("via", "jump").alias("label")), "labels")
        changed = new.where("old <> label").limit(1).count()
        labels = new.select("key", "label")
        if not changed:
            return labels
