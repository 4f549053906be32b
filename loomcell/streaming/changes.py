"""Change logs as streams: counts per window, current state, leases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomcell.runtime import latest


def windowed_counts(events: DataFrame, at: str, kind: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Tumbling counts and sums; events later than the watermark are dropped."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), kind, "n", "total")


def sessions(events: DataFrame, at: str, user: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions per user that end after a gap."""
    return events.withWatermark(at, late).groupBy(user, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n_events")).select(user, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n_events")


def keep_current(changes: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str], values: list[str]) -> StreamingQuery:
    """Append each micro-batch's latest changes as a run; a batch that is run again
    overwrites its own run, so every change lands once. Read with current_runs."""

    def write(batch: DataFrame, epoch: int) -> None:
        latest(batch, keys, order, values).write.mode("overwrite").parquet(f"{path}/run={epoch}")

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_runs(spark, path: str, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    return latest(spark.read.parquet(path), keys, order, values)


def leases(claims: DataFrame, item: str, at: str, expires: str, now) -> DataFrame:
    """The last claim of each item: active, or expired if it ends at or before now."""
    last = claims.groupBy(item).agg(F.max(F.struct(at, "claim_id", expires)).alias("c")).select(item, "c.claim_id", f"c.{expires}")
    return last.withColumn("state", F.when(F.col(expires) <= F.lit(now), "expired").otherwise("active"))
