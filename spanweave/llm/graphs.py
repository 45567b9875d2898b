"""Connected components of undirected links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

ROWS = 100_000

def components(links: DataFrame) -> DataFrame:
    """id and label (the least id that links reach) for every end of ``links`` (a, b).

    Each round takes the least label of an id's neighbours and then the label
    of that label, so that long chains shrink by half; it stops at a fixed
    point. Minima are partial before the shuffle, so a hub costs no one task
    more. Tables are kept in partitions of about ROWS rows.
    """
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    parts = both.count() // ROWS + 1
    both = both.coalesce(parts)
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")).coalesce(parts))
    while True:
        told = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("told"))
        nearer = labels.join(told, labels.id == told.a).select("id", F.least("label", "told").alias("next"), F.col("label").alias("was"))
        upper = labels.select(F.col("id").alias("next"), F.col("label").alias("above"))
        step = cut(nearer.join(upper, "next", "left").select("id", F.least("next", F.coalesce("above", "next")).alias("label"), "was").coalesce(parts))
        if step.where("label <> was").limit(1).count() == 0:
            return step.select("id", "label")
        labels = step.select("id", "label")
