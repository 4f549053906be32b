"""Times that were anchored outside, or wait to be."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending(anchors: DataFrame, attempts: DataFrame) -> DataFrame:
    """Pending anchors that no later attempt has settled."""
    done = attempts.where("succeeded").select("anchor_id").distinct()
    return anchors.where("status = 'pending'").join(done, "anchor_id", "left_anti")


def effective(anchors: DataFrame, attempts: DataFrame) -> DataFrame:
    """Anchors overlaid by their last successful attempt."""
    last = attempts.where("succeeded").groupBy("anchor_id").agg(F.max(F.struct("at", "instant")).alias("l")).select("anchor_id", F.col("l.instant").alias("settled"))
    j = anchors.join(last, "anchor_id", "left")
    return j.withColumn("instant", F.coalesce("settled", "instant")).withColumn("status", F.when(F.col("settled").isNotNull(), "registered").otherwise(F.col("status"))).drop("settled")
