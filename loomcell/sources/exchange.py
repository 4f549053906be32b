"""CSV and JSON Lines in and out; blank, null and false stay apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcell.functions import scalars as S

HEAD = ("id", "kind", "label")


def value_type(c: Column) -> Column:
    """Declared type inferred from a JSON text: booleans before integers, null json."""
    k = S.json_kind(c)
    return F.when(k == "null", "json").otherwise(k)


def read_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, cells, rejected lines) of lines {id, kind, label, values}. Blank
    lines are skipped; a line that isn't an object or has no label is rejected. A
    missing id is made from the line, a missing kind is `record`."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    v = F.try_parse_json("value")
    p = lines.select("value", F.try_variant_get(v, "$.id", "string").alias("id"), F.coalesce(F.try_variant_get(v, "$.kind", "string"), F.lit("record")).alias("kind"), F.trim(F.try_variant_get(v, "$.label", "string")).alias("label"))
    good = p.where(F.coalesce(F.col("label"), F.lit("")) != "").withColumn("id", F.coalesce("id", F.substring(F.sha2("value", 256), 1, 32)))
    raw = F.get_json_object("value", "$.values")
    each = good.select(F.col("id").alias("entity_id"), F.explode(F.from_json(raw, "map<string,variant>")).alias("field_key", "v"))
    cells = each.select("entity_id", "field_key", F.coalesce(F.to_json("v"), F.lit("null")).alias("value_json"))
    return good.select(*HEAD), cells, p.where(F.coalesce(F.col("label"), F.lit("")) == "").select("value")


def json_or_text(c: Column) -> Column:
    """A CSV cell: itself if it is JSON, else a JSON string of it ("007" is text);
    empty is no value."""
    return F.when(c.isNull() | (c == ""), F.lit(None)).when(F.try_parse_json(c).isNotNull() & ~c.rlike(r"^\s*-?0\d"), c).otherwise(F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'^\{"v":(.*)\}$', 1))


def read_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entities, cells) of a wide file whose header has id, kind and label; every
    other column is a field, an empty cell no cell."""
    df = spark.read.csv(path, header=True, escape='"', multiLine=True)
    if not set(HEAD) <= set(df.columns):
        raise ValueError("the header must have id, kind and label")
    others = [c for c in df.columns if c not in HEAD]
    stacked = df.select(F.col("id").alias("entity_id"), F.explode(F.array(*[F.struct(F.lit(c).alias("field_key"), json_or_text(F.col(f"`{c}`")).alias("value_json")) for c in others])).alias("s")) if others else None
    cells = stacked.select("entity_id", "s.*").where("value_json is not null") if stacked is not None else spark.createDataFrame([], "entity_id string, field_key string, value_json string")
    return df.select(*HEAD), cells


def jsonl(e: DataFrame, cells: DataFrame) -> DataFrame:
    """One canonical line per entity, members by key; entities without cells too."""
    pair = F.concat(F.regexp_extract(F.to_json(F.struct(F.col("field_key").alias("v"))), r'^\{"v":(.*)\}$', 1), F.lit(":"), F.col("value_json"))
    vals = cells.groupBy(F.col("entity_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("field_key", pair.alias("p")))), lambda x: x["p"]), ",").alias("vals"))
    head = F.regexp_replace(F.to_json(F.struct("id", "kind", "label")), r"\}$", "")
    return e.join(vals, "id", "left").select(F.concat(head, F.lit(',"values":{'), F.coalesce("vals", F.lit("")), F.lit("}}")).alias("value"))


def write_jsonl(e: DataFrame, cells: DataFrame, path: str) -> None:
    jsonl(e, cells).write.mode("overwrite").text(path)


def wide(e: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """id, kind, label and a JSON text column per key; blank where there is no cell."""
    w = cells.where(F.col("field_key").isin(keys)).groupBy(F.col("entity_id").alias("id")).agg(*[F.max(F.when(F.col("field_key") == k, F.col("value_json"))).alias(k) for k in keys])
    return e.select(*HEAD).join(w, "id", "left")


def write_csv(e: DataFrame, cells: DataFrame, keys: list[str], path: str) -> None:
    wide(e, cells, keys).write.mode("overwrite").csv(path, header=True, escape='"')


def melt(df: DataFrame, table: str, key: str, columns: list[str], label: str) -> tuple[DataFrame, DataFrame]:
    """(entities, cells) of a wide table; only the asked columns are read and made
    into cells, null gives no cell."""
    ent = F.concat(F.lit(f"{table}:"), F.col(key).cast("string"))
    e = df.select(ent.alias("id"), F.lit(table).alias("kind"), F.col(label).cast("string").alias("label"))
    types = dict(df.dtypes)

    def text(c: str) -> Column:
        if types[c] == "string":
            return F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v"))), r'^\{"v":(.*)\}$', 1)
        return F.col(c).cast("string")

    one = df.select(ent.alias("entity_id"), F.explode(F.array(*[F.struct(F.lit(c).alias("field_key"), F.when(F.col(c).isNotNull(), text(c)).alias("value_json")) for c in columns])).alias("s"))
    return e, one.select("entity_id", "s.*").where("value_json is not null")
