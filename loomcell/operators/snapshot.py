"""Plans from comparing a source with the store, and gated writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomcell.functions import scalars as S
from loomcell.runtime import remove


def cell_states(source: DataFrame, stored: DataFrame) -> DataFrame:
    """source and stored cells (entity_id, field_key, value_json[, source]) side by
    side: add, same, value_mismatch, source_mismatch, not_in_source."""
    s = source.select("entity_id", "field_key", F.col("value_json").alias("v1"), F.col("source").alias("s1"), F.lit(True).alias("in1"))
    t = stored.select("entity_id", "field_key", F.col("value_json").alias("v2"), F.col("source").alias("s2"), F.lit(True).alias("in2"))
    j = s.join(t, ["entity_id", "field_key"], "full_outer")
    state = (F.when(F.col("in2").isNull(), "add").when(F.col("in1").isNull(), "not_in_source").when(~F.col("v1").eqNullSafe(F.col("v2")), "value_mismatch")
             .when(~F.col("s1").eqNullSafe(F.col("s2")), "source_mismatch").otherwise("same"))
    return j.select("entity_id", "field_key", state.alias("state"))


def entity_plan(source: DataFrame, stored: DataFrame, source_cells: DataFrame, stored_cells: DataFrame) -> DataFrame:
    """One state per entity of (id, kind, label) tables: new, enrich, unchanged,
    conflict (a value, source, kind or label differs, or a stored value is gone
    from the source), missing (in the store only)."""
    c = cell_states(source_cells, stored_cells).groupBy("entity_id").agg(F.count_if(F.col("state") == "add").alias("n_add"), F.count_if(F.col("state").isin("value_mismatch", "source_mismatch", "not_in_source")).alias("n_bad"))
    s = source.select(F.col("id").alias("entity_id"), F.struct("kind", "label").alias("h1"))
    t = stored.select(F.col("id").alias("entity_id"), F.struct("kind", "label").alias("h2"))
    j = s.join(t, "entity_id", "full_outer").join(c, "entity_id", "left")
    state = (F.when(F.col("h2").isNull(), "new").when(F.col("h1").isNull(), "missing").when(~F.col("h1").eqNullSafe(F.col("h2")) | (F.coalesce("n_bad", F.lit(0)) > 0), "conflict")
             .when(F.coalesce("n_add", F.lit(0)) > 0, "enrich").otherwise("unchanged"))
    return j.select("entity_id", state.alias("state"), F.coalesce("n_add", F.lit(0)).alias("n_add"), F.coalesce("n_bad", F.lit(0)).alias("n_bad"))


def partition_plan(source: DataFrame, stored: DataFrame, key: str, partition: str, value: str) -> DataFrame:
    """Records by partition (such as a month): new, unchanged, changed, reassigned
    (the same record in another partition), missing."""
    s = source.select(F.col(key).alias("k"), F.col(partition).alias("p1"), F.col(value).alias("v1"), F.lit(True).alias("in1"))
    t = stored.select(F.col(key).alias("k"), F.col(partition).alias("p2"), F.col(value).alias("v2"), F.lit(True).alias("in2"))
    j = s.join(t, "k", "full_outer")
    state = (F.when(F.col("in2").isNull(), "new").when(F.col("in1").isNull(), "missing").when(~F.col("p1").eqNullSafe(F.col("p2")), "reassigned").when(~F.col("v1").eqNullSafe(F.col("v2")), "changed").otherwise("unchanged"))
    return j.select(F.col("k").alias(key), F.coalesce("p1", "p2").alias(partition), state.alias("state"))


def file_plan(seen: DataFrame, known: DataFrame) -> DataFrame:
    """Files (path, sha) against those known: unchanged, content_changed (same path),
    moved (its content stood under one other path, now gone), first_seen, missing."""
    j = seen.select("path", F.col("sha").alias("s1")).join(known.select("path", F.col("sha").alias("s2")), "path", "full_outer")
    gone = j.where("s1 is null").groupBy(F.col("s2").alias("s")).agg(F.count("*").alias("n_gone"), F.min("path").alias("was"))
    fresh = j.where("s2 is null").groupBy(F.col("s1").alias("s")).agg(F.count("*").alias("n_new"))
    pair = gone.join(fresh, "s").where("n_gone = 1 and n_new = 1").select("s", "was")
    j = j.withColumn("s", F.coalesce("s1", "s2")).join(pair, "s", "left")
    state = (F.when(F.col("s1").isNull(), F.when(F.col("was").isNotNull(), "moved_away").otherwise("missing")).when(F.col("s2").isNull(), F.when(F.col("was").isNotNull(), "moved").otherwise("first_seen"))
             .when(F.col("s1") == F.col("s2"), "unchanged").otherwise("content_changed"))
    return j.select("path", state.alias("state"), F.when(F.col("s2").isNull(), F.col("was")).alias("was_path"))


def contract(have: DataFrame, want: DataFrame) -> DataFrame:
    """Registry fields (key, value_type, normalized_key) against declared ones:
    ok, missing, mismatch, normalized_key_collision (another key, same normal form)."""
    h = have.select("key", F.col("value_type").alias("t1"))
    n = have.groupBy("normalized_key").agg(F.min("key").alias("other"))
    j = want.select("key", F.col("value_type").alias("t2"), S.field_key("key").alias("normalized_key")).join(h, "key", "left").join(n, "normalized_key", "left")
    state = F.when(F.col("t1") == F.col("t2"), "ok").when(F.col("t1").isNotNull(), "mismatch").when(F.col("other").isNotNull(), "normalized_key_collision").otherwise("missing")
    return j.select("key", state.alias("state"))


def set_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only, with that side."""
    return a.select(*keys).distinct().join(b, keys, "left_anti").withColumn("side", F.lit("left")).unionByName(b.select(*keys).distinct().join(a, keys, "left_anti").withColumn("side", F.lit("right")))


def merge_maps(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Two map columns `m` merged per key: values, which side gave each, conflicts."""
    j = a.select(key, F.col("m").alias("ma")).join(b.select(key, F.col("m").alias("mb")), key, "full_outer")
    empty = F.create_map().cast("map<string,string>")
    j = j.select(key, F.coalesce("ma", empty).alias("ma"), F.coalesce("mb", empty).alias("mb"))
    merged = F.map_zip_with("ma", "mb", lambda k, x, y: F.coalesce(x, y))
    side = F.map_zip_with("ma", "mb", lambda k, x, y: F.when(y.isNull(), "left").when(x.isNull(), "right").otherwise("both"))
    bad = F.map_keys(F.map_filter(F.map_zip_with("ma", "mb", lambda k, x, y: x.isNotNull() & y.isNotNull() & (x != y)), lambda k, v: v))
    return j.select(key, merged.alias("merged"), side.alias("sides"), F.array_sort(bad).alias("conflicts"))


def changed_cells(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Only the cells whose value differs from the stored one or that are new (added)."""
    return new.join(stored.select("entity_id", "field_key", F.col("value_json").alias("old"), F.lit(True).alias("have")), ["entity_id", "field_key"], "left").where(F.col("have").isNull() | ~F.col("value_json").eqNullSafe(F.col("old"))).withColumn("added", F.col("have").isNull()).drop("old", "have")


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """A digest of all rows that doesn't depend on their order or partitioning and
    counts repeated rows: a SHA-256 per row, its eight 32-bit words summed, the sums
    hashed. No row leaves its task."""
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    words = [F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)") for i in range(8)]
    sums = df.agg(F.count("*").alias("n_rows"), *[F.sum(w).alias(f"w{i}") for i, w in enumerate(words)])
    return sums.select("n_rows", F.sha2(F.concat_ws(",", "n_rows", *[F.coalesce(F.col(f"w{i}"), F.lit(0)).cast("string") for i in range(8)]), 256).alias("digest"))


def ordered_digest(df: DataFrame, order: list[str], text: F.Column) -> DataFrame:
    """SHA-256 of a bounded table's rows in order, one line each (registry slices)."""
    return df.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text.alias("__t")))), lambda x: x["__t"]), "\n"), 256).alias("digest"))


class Blocked(RuntimeError):
    """The plan has conflicts or missing records; nothing was written."""


def apply_plan(spark: SparkSession, plan: DataFrame, rows: DataFrame, path: str) -> int:
    """Write rows beside the target, read them back, compare, then move them in;
    refused while the plan has conflict or missing states. Returns rows written.
    An empty batch writes nothing, so a replay is a no-op."""
    if plan.where(F.col("state").isin("conflict", "missing")).limit(1).count():
        raise Blocked("conflict or missing records")
    staged = f"{path}.staged"
    rows.write.mode("overwrite").parquet(staged)
    back = spark.read.schema(rows.schema).parquet(staged)
    a, b = fingerprint(back, back.columns).first(), fingerprint(rows, rows.columns).first()
    if a != b:
        remove(spark, staged)
        raise RuntimeError("what was read back differs from what was written")
    if a["n_rows"]:
        back.write.mode("append").parquet(path)
    remove(spark, staged)
    return a["n_rows"]


def immutable_append(batch: DataFrame, stored: DataFrame, key: str, content: str) -> tuple[DataFrame, int]:
    """(rows to add, conflicts): rows that are known and equal are left out; a known
    key with other content is a conflict, on which the caller writes nothing."""
    j = batch.join(stored.select(key, F.col(content).alias("__c")), key, "left")
    bad = j.where(F.col("__c").isNotNull() & (F.col("__c") != F.col(content))).count()
    return j.where("__c is null").drop("__c"), bad


def chain_gaps(stream: DataFrame, key: str, sequence: str, parent: str, sha: str) -> DataFrame:
    """Breaks of hash chains: a sequence that doesn't follow or a parent that isn't
    the digest of the record before."""
    w = Window.partitionBy(key).orderBy(sequence)
    s = stream.withColumn("__n", F.row_number().over(w) - 1).withColumn("__p", F.lag(sha).over(w))
    return s.where((F.col(sequence) != F.col("__n")) | ~F.col(parent).eqNullSafe(F.col("__p"))).select(key, sequence)


def chain_head(stream: DataFrame, key: str, sequence: str, sha: str) -> DataFrame:
    return stream.groupBy(key).agg(F.max(F.struct(sequence, sha)).alias("h")).select(key, f"h.{sequence}", f"h.{sha}")
