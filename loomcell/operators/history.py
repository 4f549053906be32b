"""History of a changing attribute: the periods in which each value held.

A key's observations are cut into chunks of bounded size along (key, time); each
chunk is a sorted struct array folded by a higher-order function that appends a
version only upon change; the chunks' ends are then stitched. A key with a third
of all rows is thus spread over many tasks, and only its chunks' summaries, one
row per chunk, meet in one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomcell.runtime import has_hot_key, spool, spread_next, spread_previous

#: Observations folded in one array (a power of two).
CHUNK_BITS = 8


def history(obs: DataFrame, key: str, at: str, tie: str, value: str, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """Periods of one value per key, from observations in any order.

    Observations without a key or value are ignored; of those of one key at one
    instant only the one with the highest tie column counts (nulls lowest), which
    also drops copies. A null instant comes before all others. Returns key, value,
    opened_by, closed_by (tie of the opening and closing observation, null while
    open), opened_at, closed_at. No rows in, no rows out; other columns are ignored.
    """
    kt, vt = dict(obs.dtypes)[key], dict(obs.dtypes)[value]
    o = obs.select(F.col(key).alias("k"), F.col(at).alias("t"), F.col(tie).alias("i"), F.col(value).alias("v")).where("k is not null and v is not null")
    o = o.groupBy("k", "t").agg(F.max(F.struct("i", "v")).alias("iv")).select("k", "t", "iv.i", "iv.v")
    # range partitions along (key, time): a hot key spans several; within them blocks of bounded size
    ordered = o.repartitionByRange("k", "t").sortWithinPartitions("k", "t")
    chunks = ordered.withColumn("chunk", F.shiftright(F.monotonically_increasing_id(), chunk_bits))
    folded = chunks.groupBy("k", "chunk").agg(F.sort_array(F.collect_list(F.struct("t", "i", "v"))).alias("s"))
    none = F.array().cast(f"array<struct<t:{dict(o.dtypes)['t']},i:{dict(o.dtypes)['i']},v:{vt}>>")
    folded = folded.select("k", "chunk", F.aggregate("s", none, lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["v"] == x["v"]), acc).otherwise(F.concat(acc, F.array(x)))).alias("vs"))
    folded = spool(folded)  # chunk numbers must be the same for both uses below
    ends = folded.select("k", "chunk", F.element_at("vs", 1).alias("head"), F.element_at("vs", -1)["v"].alias("last_v"), F.when(F.size("vs") > 1, F.element_at("vs", 2)).alias("second"))
    if has_hot_key(ends, "k"):  # even its chunks are too many for one task
        ends = spread_previous(ends, "k", ["chunk"], "last_v").withColumnRenamed("prev", "before").drop("nth")
    else:
        ends = ends.withColumn("before", F.lag("last_v").over(Window.partitionBy("k").orderBy("chunk")))
    ends = ends.withColumn("goes_on", F.coalesce(F.col("before") == F.col("head.v"), F.lit(False)))
    # a chunk that only goes on opens nothing, and nothing in it needs an end
    ends = ends.withColumn("opens", F.when(~F.col("goes_on"), F.col("head")).otherwise(F.col("second"))).where("opens is not null")
    if has_hot_key(ends, "k"):
        ends = spread_next(ends, "k", ["chunk"], "opens", "next_open")
    else:
        ends = ends.withColumn("next_open", F.lead("opens").over(Window.partitionBy("k").orderBy("chunk")))
    ends = ends.select("k", "chunk", "goes_on", "next_open")
    joined = folded.join(ends, ["k", "chunk"])
    kept = F.when(F.col("goes_on"), F.slice("vs", 2, F.greatest(F.size("vs") - 1, F.lit(0)))).otherwise(F.col("vs"))
    joined = joined.select("k", "next_open", kept.alias("vs"))
    periods = joined.select("k", F.explode(F.transform("vs", lambda x, n: F.struct(x.alias("a"), F.coalesce(F.get("vs", n + 1), F.col("next_open")).alias("b")))).alias("p"))
    return periods.select(F.col("k").cast(kt).alias(key), F.col("p.a.v").alias(value), F.col("p.a.i").alias("opened_by"), F.col("p.b.i").alias("closed_by"), F.col("p.a.t").alias("opened_at"), F.col("p.b.t").alias("closed_at"))


def as_of(periods: DataFrame, key: str, instant) -> DataFrame:
    """The version of each key in force at an instant."""
    t = F.lit(instant)
    return periods.where(((F.col("opened_at") <= t) | F.col("opened_at").isNull()) & (F.col("closed_at").isNull() | (F.col("closed_at") > t)))
