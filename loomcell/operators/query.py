"""Reads over the store: task views, filters, search, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcell.functions import scalars as S
from loomcell.operators.store import page
from loomcell.runtime import lookup_join


def make_view(f: DataFrame, keys: list[str]) -> DataFrame:
    """An ordered field subset: field_id, key, ordinal; the first of repeated keys."""
    spark = f.sparkSession
    order = spark.createDataFrame([(k, i) for i, k in enumerate(dict.fromkeys(k.strip() for k in keys if k.strip()))], "key string, ordinal int")
    return f.select(F.col("id").alias("field_id"), "key", "value_type", "status").join(F.broadcast(order), "key").select("field_id", "key", "value_type", "status", "ordinal")


def view_matrix(view: DataFrame, e: DataFrame, c: DataFrame, field_offset: int = 0, field_limit: int = 25, entity_offset: int = 0, entity_limit: int = 1000) -> DataFrame:
    """A page of a task view: entities in (created_at, id) order, each with a column
    per field of the window; absent cells are null, JSON nulls the text `null`.

    The window's keys (200 at most) are collected to pivot on them; cells are
    filtered by field before anything is joined."""
    window = page(view, ["ordinal", "field_id"], field_limit, field_offset, 200).select("field_id", "key").collect()
    rows = page(e.select("id", "kind", "label", "created_at"), ["created_at", "id"], entity_limit, entity_offset, 5000)
    ids = [r["field_id"] for r in window]
    # the page is bounded to 5000 rows, so it is the side to send to the cells
    mine = c.where(F.col("field_id").isin(ids)).join(F.broadcast(rows.select(F.col("id").alias("entity_id"))), "entity_id", "left_semi")
    wide = mine.groupBy(F.col("entity_id").alias("id")).agg(*[F.max(F.when(F.col("field_id") == r["field_id"], F.col("value_json"))).alias(r["key"]) for r in window])
    return rows.join(wide, "id", "left")


def filter_fields(f: DataFrame, needle: str = "", status: str | None = None) -> DataFrame:
    hit = S.contains_ci(F.col("key"), needle) | S.contains_ci(F.col("label"), needle) | S.contains_ci(F.col("description"), needle)
    return f.where(hit & (F.col("status") == status) if status else hit)


def find(e: DataFrame, c: DataFrame, f: DataFrame, equals: dict[str, str], kind: str | None = None) -> DataFrame:
    """Entities whose cells equal all the canonical JSON texts: one pass over the
    cells with a conditional aggregate, however many filters."""
    keys = f.where(F.col("key").isin(list(equals))).select(F.col("id").alias("field_id"), "key")
    pairs = reduce(lambda a, b: a | b, [(F.col("key") == k) & (F.col("value_json") == v) for k, v in equals.items()])
    # as many registry rows as filters
    hits = c.join(F.broadcast(keys), "field_id").where(pairs).groupBy("entity_id").agg(F.count_distinct("key").alias("n")).where(F.col("n") == len(equals))
    out = e.where(F.col("kind") == kind) if kind else e
    return out.join(hits.select(F.col("entity_id").alias("id")), "id", "left_semi")


def find_null_safe(e: DataFrame, c: DataFrame, f: DataFrame, key: str, value: str | None) -> DataFrame:
    """Entities whose cell equals a value, where an absent cell equals JSON null."""
    ids = f.where(F.col("key") == key).select(F.col("id").alias("field_id"))
    mine = c.join(F.broadcast(ids), "field_id", "left_semi").select(F.col("entity_id").alias("id"), F.when(F.col("value_json") != "null", F.col("value_json")).alias("v"))
    return e.join(mine, "id", "left").where(F.col("v").eqNullSafe(F.lit(value))).drop("v")


def search(f: DataFrame, e: DataFrame, c: DataFrame, needle: str, limit: int = 100) -> DataFrame:
    """Fields, then entities, then cells that contain a text, cut at the limit as a
    whole. Each branch is cut by itself first, so no more than the limit is sorted.
    An empty needle finds nothing. Columns: type, id, label, key, rank."""
    limit = max(1, min(limit, 500))
    needle = needle.strip()
    has = (lambda col: S.contains_ci(F.col(col), needle)) if needle else (lambda col: F.lit(False))
    a = f.where(has("key") | has("label") | has("description")).select(F.lit("field").alias("type"), "id", "label", "key", F.col("key").alias("o1"), F.col("id").alias("o2"), F.lit(0).alias("o0"))
    b = e.where(has("id") | has("label")).select(F.lit("entity").alias("type"), "id", "label", F.lit(None).cast("string").alias("key"), F.col("label").alias("o1"), F.col("id").alias("o2"), F.lit(1).alias("o0"))
    named = c.where(has("value_json")).join(f.select(F.col("id").alias("field_id"), "key"), "field_id").join(e.select(F.col("id").alias("entity_id"), "label"), "entity_id")
    d = named.select(F.lit("cell").alias("type"), F.col("entity_id").alias("id"), "label", "key", F.concat_ws("\x1f", "label", "key").alias("o1"), F.col("entity_id").alias("o2"), F.lit(2).alias("o0"))
    order = ["o0", "o1", "o2"]
    parts = [x.orderBy(*order).limit(limit) for x in (a, b, d)]
    return reduce(DataFrame.unionByName, parts).orderBy(*order).limit(limit).select("type", "id", "label", "key")


def store_stats(f: DataFrame, e: DataFrame, c: DataFrame, p: DataFrame) -> DataFrame:
    """Counts, logical capacity (fields x entities) and density (0 when that is 0)."""
    one = F.lit(1).alias("k")
    fa = f.agg(F.count("*").alias("fields"), F.count_if(F.col("status") == "active").alias("active_fields"), F.count_if(F.col("status") == "converged").alias("converged_fields")).select(one, "*")
    rest = [e.agg(F.count("*").alias("entities")).select(one, "*"), c.agg(F.count("*").alias("cells")).select(one, "*"), p.agg(F.count("*").alias("proposals")).select(one, "*")]
    j = reduce(lambda a, b: a.join(b, "k"), [fa, *rest]).drop("k").withColumn("logical_capacity", F.col("fields") * F.col("entities"))
    return j.withColumn("density", F.when(F.col("logical_capacity") > 0, F.col("cells") / F.col("logical_capacity")).otherwise(0.0))


def coverage(c: DataFrame) -> DataFrame:
    """Cells and latest change per field."""
    return c.groupBy("field_id").agg(F.count("*").alias("n_cells"), F.max("updated_at").alias("latest"))


def redundancy(candidates: DataFrame) -> DataFrame:
    """Per field, at either end of a scored pair: the greatest score and how many
    other fields."""
    both = candidates.select(F.col("source_ref").alias("field_id"), F.col("candidate_field_id").alias("other"), "score").unionByName(candidates.select(F.col("candidate_field_id").alias("field_id"), F.col("source_ref").alias("other"), "score"))
    return both.where("field_id <> other").groupBy("field_id").agg(F.max("score").alias("redundancy"), F.count_distinct("other").alias("n_others"))


def histogram(c: DataFrame, field_id: str) -> DataFrame:
    """Value counts of one field; strings bare, True, False and None by name."""
    return c.where(F.col("field_id") == field_id).groupBy(S.text_of_value(F.col("value_json")).alias("value")).agg(F.count("*").alias("n"))


def histograms(df: DataFrame, columns: list[str]) -> DataFrame:
    """Value counts of several columns and the total in one pass over the rows."""
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])).alias("s"))
    return stacked.groupBy("s.column_name", "s.value").agg(F.count("*").alias("n"))


def numeric_summary(c: DataFrame, within: float = float("inf")) -> DataFrame:
    """Count, mean, least and greatest of a field's JSON numbers; strings and
    booleans don't count as numbers. The mean is of those smaller than `within`, so
    that a few absurd values don't swallow the others' digits."""
    kind = S.json_kind(F.col("value_json"))
    n = c.where(kind.isin("integer", "number")).withColumn("x", F.col("value_json").try_cast("double"))
    return n.groupBy("field_id").agg(F.count("x").alias("n"), F.avg(F.when(F.abs("x") < within, F.col("x"))).alias("mean"), F.min("x").alias("least"), F.max("x").alias("greatest"))


def slots(c: DataFrame, view: DataFrame, ids: DataFrame) -> DataFrame:
    """Five-valued reads of entities over a registry slice: view (field_id,
    loaded): present, blank (JSON null), absent (no cell), unloaded (not selected)."""
    # every asked entity has every field of the view: the view goes to the entities,
    # by broadcast if it is small, spread over copies of it otherwise
    v = view.groupBy("field_id").agg(F.max("loaded").alias("loaded")).withColumn("__one", F.lit(1))
    grid = lookup_join(ids.select("entity_id").withColumn("__one", F.lit(1)), v, "__one", spread=F.col("entity_id")).drop("__one")
    j = grid.join(c.select("entity_id", "field_id", "value_json"), ["entity_id", "field_id"], "left")
    state = F.when(~F.col("loaded"), "unloaded").when(F.col("value_json").isNull(), "absent").when(F.col("value_json") == "null", "blank").otherwise("present")
    return j.select("entity_id", "field_id", state.alias("state"), F.when(state == "present", F.col("value_json")).alias("value_json"))
