"""The store: entities, fields and cells, reads and append-only changes.

A store's tables are change logs; what holds is the latest row of a key, so every
mutation is an append and every read a plan. `latest` pre-aggregates before the
shuffle; no operator collects a key's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomcell.functions import scalars as S
from loomcell.runtime import HOT_ROWS, has_hot_key, latest, lookup_join, spread_previous

ENTITY = ["kind", "label", "created_at"]
FIELD = ["key", "label", "value_type", "description", "status", "created_at", "namespace", "normalized_key"]


def entities(df: DataFrame) -> DataFrame:
    """Current entities: id, kind, label, created_at, updated_at."""
    return latest(df.where("id is not null"), ["id"], ["updated_at"], ENTITY).select("id", *ENTITY, "updated_at")


def fields(df: DataFrame) -> DataFrame:
    """Current registry rows."""
    return latest(df.where("id is not null"), ["id"], ["updated_at"], FIELD).select("id", *FIELD, "updated_at")


def cells(df: DataFrame) -> DataFrame:
    """Current cells: one row per (entity_id, field_id)."""
    return latest(df.where("entity_id is not null and field_id is not null"), ["entity_id", "field_id"], ["updated_at"], ["value_json", "source", "confidence"])


def named_cells(c: DataFrame, f: DataFrame, keys: list[str] | None = None, namespace: str | None = None) -> DataFrame:
    """Cells with their field's key; keys and namespace prune the fields before the join."""
    f = f.where(F.col("namespace") == namespace) if namespace else f
    f = f.where(F.col("key").isin(keys)) if keys else f
    return lookup_join(c, f.select(F.col("id").alias("field_id"), F.col("key").alias("field_key"), "value_type"), "field_id", spread=F.col("entity_id"))


def get_entity(e: DataFrame, c: DataFrame, f: DataFrame, entity_id: str) -> DataFrame:
    """One entity with the map of its values and their sources; no row if missing."""
    mine = named_cells(c.where(F.col("entity_id") == entity_id), f)
    vals = mine.groupBy("entity_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field_key", "value_json")))).alias("values"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("field_key", "source")))).alias("sources"))
    return e.where(F.col("id") == entity_id).join(vals, e["id"] == vals["entity_id"], "left").drop("entity_id")


def page(df: DataFrame, order: list, limit: int, offset: int = 0, most: int = 10_000) -> DataFrame:
    """A page of rows in a total order; the limit is clamped to 1..most."""
    return df.orderBy(*order).offset(max(0, offset)).limit(max(1, min(limit, most)))


def get_field(f: DataFrame, ref: str) -> DataFrame:
    return f.where((F.col("id") == ref) | (F.col("key") == ref))


def changes(df: DataFrame, keys: list[str], seq: list[str], op: str, values: list[str]) -> DataFrame:
    """Current state of a change log: the latest change per key, deletions dropped."""
    return latest(df, keys, seq, [op, *values]).where(F.col(op) != "delete").select(*keys, *values)


def set_cells(batch: DataFrame, path: str) -> None:
    """Append cells (upsert on entity and field by updated_at) to a Parquet log."""
    batch.write.mode("append").parquet(path)


def new_fields(batch: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused with reason) of fields to create: a key known anywhere, a
    normalised key known in the namespace, or either twice in the batch is refused."""
    b = batch.withColumn("normalized_key", S.field_key("key"))
    seen_key = registry.select("key").distinct().withColumn("k1", F.lit(True))
    seen_norm = registry.select("namespace", "normalized_key").distinct().withColumn("k2", F.lit(True))
    many_key = b.groupBy("key").agg(F.count("*").alias("n1"))
    many_norm = b.groupBy("namespace", "normalized_key").agg(F.count("*").alias("n2"))
    j = b.join(seen_key, "key", "left").join(seen_norm, ["namespace", "normalized_key"], "left").join(many_key, "key").join(many_norm, ["namespace", "normalized_key"], "left")
    why = (F.when(F.col("normalized_key").isNull(), "empty_key").when(F.col("k1"), "duplicate_key").when(F.col("k2"), "duplicate_normalized_key")
           .when(F.col("n1") > 1, "duplicate_in_batch").when(F.col("n2") > 1, "normalized_duplicate_in_batch"))
    j = j.withColumn("reason", why).drop("k1", "k2", "n1", "n2")
    return j.where("reason is null").drop("reason"), j.where("reason is not null")


def audit_transitions(events: DataFrame, key: str, at: list[str], status: str, allowed: list[tuple[str, str]], hot: int = HOT_ROWS) -> DataFrame:
    """Consecutive statuses of a key, in the total order `at`, against a table of
    allowed moves; a key with more than `hot` rows is spread over tasks."""
    if has_hot_key(events, key, hot):
        e = spread_previous(events, key, at, status).withColumnRenamed("prev", "previous").drop("nth")
    else:
        e = events.withColumn("previous", F.lag(status).over(Window.partitionBy(key).orderBy(*at)))
    moves = F.array(*[F.lit(f"{a}>{b}") for a, b in allowed])
    return e.where("previous is not null").withColumn("legal", F.array_contains(moves, F.concat_ws(">", "previous", status)))


def next_ordinals(batch: DataFrame, existing: DataFrame, key: str, order: list[str], ordinal: str, hot: int = HOT_ROWS) -> DataFrame:
    """Number a batch's rows per key in a total order, from one past the greatest
    used (0 if none); a key with more than `hot` rows is spread over tasks."""
    top = existing.groupBy(key).agg(F.max(ordinal).alias("__top"))
    if has_hot_key(batch, key, hot):
        numbered = spread_previous(batch, key, order, order[0]).withColumnRenamed("nth", "__r").drop("prev")
    else:
        numbered = batch.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)
    return numbered.join(top, key, "left").withColumn(ordinal, F.coalesce(F.col("__top") + 1, F.lit(0)) + F.col("__r")).drop("__r", "__top")


def resolve(refs: DataFrame, f: DataFrame, aliases: DataFrame) -> DataFrame:
    """refs (namespace, ref) to fields: by id, key, normalised key in the namespace,
    alias in it, in this order; more than one hit of a kind is ambiguous.
    Columns: namespace, ref, field_id, matched_by (null if nothing)."""
    r = refs.select("namespace", "ref").distinct().withColumn("norm", S.field_key("ref"))
    by_id = f.select(F.col("id").alias("ref"), F.col("id").alias("i1"))
    by_key = f.groupBy(F.col("key").alias("ref")).agg(F.min("id").alias("i2"))
    by_norm = f.groupBy("namespace", F.col("normalized_key").alias("norm")).agg(F.min("id").alias("i3"), F.count_distinct("id").alias("n3"))
    by_alias = aliases.groupBy("namespace", F.col("normalized_alias").alias("norm")).agg(F.min("field_id").alias("i4"), F.count_distinct("field_id").alias("n4"))
    j = r.join(by_id, "ref", "left").join(by_key, "ref", "left").join(by_norm, ["namespace", "norm"], "left").join(by_alias, ["namespace", "norm"], "left")
    how = (F.when(F.col("i1").isNotNull(), "id").when(F.col("i2").isNotNull(), "key").when(F.col("n3") > 1, "ambiguous").when(F.col("n3") == 1, "normalized")
           .when(F.col("n4") > 1, "ambiguous").when(F.col("n4") == 1, "alias"))
    return j.select("namespace", "ref", F.when(how != "ambiguous", F.coalesce("i1", "i2", "i3", "i4")).alias("field_id"), how.alias("matched_by"))


def decide_proposals(p: DataFrame, f: DataFrame) -> DataFrame:
    """What accepting each proposal would do: alias the field of its namespace that
    has its normalised key, else create one."""
    n = p.select("id", "namespace", S.field_key("key").alias("normalized_key")).distinct()
    have = f.groupBy("namespace", "normalized_key").agg(F.min("id").alias("target_field_id"))
    j = n.join(have, ["namespace", "normalized_key"], "left")
    return j.select("id", "namespace", F.when(F.col("target_field_id").isNotNull(), "alias_existing").otherwise("created").alias("outcome"), "target_field_id")


def add_aliases(batch: DataFrame, aliases: DataFrame) -> DataFrame:
    """Each alias of a batch (namespace, alias, field_id) as new, same (nothing to
    do) or conflict (another field has it)."""
    b = batch.select("namespace", "alias", "field_id", S.field_key("alias").alias("normalized_alias"))
    have = aliases.groupBy("namespace", "normalized_alias").agg(F.min("field_id").alias("held_by"))
    j = b.join(have, ["namespace", "normalized_alias"], "left")
    return j.withColumn("state", F.when(F.col("held_by").isNull(), "new").when(F.col("held_by") == F.col("field_id"), "same").otherwise("conflict"))


def versions(definitions: DataFrame, key: str, at: list[str], values: list[str]) -> DataFrame:
    """Versions of definitions: a row per change of any value, numbered from 1."""
    w = Window.partitionBy(key).orderBy(*at)
    d = definitions.select(key, *at, *values).distinct().withColumn("__v", F.struct(*values))
    changed = F.coalesce(~F.col("__v").eqNullSafe(F.lag("__v").over(w)), F.lit(True)) | (F.row_number().over(w) == 1)
    return d.where(F.col(key).isNotNull()).withColumn("__c", changed).where("__c").withColumn("version", F.row_number().over(w)).drop("__v", "__c")


def merge_fields(sources: DataFrame, target: str, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lineage edges, registry with the sources' status `merged`); cells stay."""
    edges = sources.select(F.col("id").alias("parent_field_id"), F.lit(target).alias("child_field_id"), F.lit("merged_into").alias("relation")).where(F.col("parent_field_id") != target).distinct()
    ids = edges.select(F.col("parent_field_id").alias("id"), F.lit(True).alias("__m"))
    r = registry.join(ids, "id", "left").withColumn("status", F.when(F.col("__m"), "merged").otherwise(F.col("status"))).drop("__m")
    return edges, r


def split_field(source: str, children: DataFrame) -> DataFrame:
    """Lineage edges of a split; the caller sees to two or more children."""
    return children.select(F.lit(source).alias("parent_field_id"), F.col("id").alias("child_field_id"), F.lit("split_into").alias("relation")).distinct()


def lineage(edges: DataFrame, field_id: str) -> DataFrame:
    """Edges on which a field stands at either end."""
    return edges.where((F.col("parent_field_id") == field_id) | (F.col("child_field_id") == field_id))


def merged_cells(c: DataFrame, edges: DataFrame) -> DataFrame:
    """Cells read under the fields their own were merged into, own cells first."""
    e = edges.where("relation = 'merged_into'").groupBy(F.col("parent_field_id").alias("field_id")).agg(F.min("child_field_id").alias("into"))
    j = lookup_join(c, e, "field_id", "left", spread=F.col("entity_id"))
    j = j.withColumn("own", F.col("into").isNull().cast("int")).withColumn("field_id", F.coalesce("into", "field_id")).drop("into")
    return latest(j, ["entity_id", "field_id"], ["own", "updated_at"], ["value_json", "source", "confidence"]).drop("own")


def current(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """All columns of the latest row per key."""
    return latest(df, keys, order, [c for c in df.columns if c not in (*keys, *order)]).select(*df.columns)


def rank_within(df: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first `most` rows per key in a total order (a top-k report)."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= most)
