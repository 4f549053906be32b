"""Discovery of fields in records, consensus, decisions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomcell.functions import jsontext as J
from loomcell.functions import scalars as S
from loomcell.operators import nested
from loomcell.runtime import ship

_TYPE = {"object": "object", "array": "array", "string": "text", "boolean": "boolean", "null": "null"}


def leaf_paths(records: DataFrame) -> DataFrame:
    """records (record_id, value) to discovered leaves: record_id, field_path (names
    joined by underscore; items of `records` and of arrays are repetitions, whose
    number isn't part of it), value_type, pointer. Arrays of scalars are leaves;
    broken JSON gives nothing."""
    ship(records.sparkSession)
    s = pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for rid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    x = J.parse(text) if text is not None else {}
                except J.NotJson:
                    continue
                todo = [(x, (), "#")]
                while todo:
                    v, path, at = todo.pop()
                    if isinstance(v, dict):
                        for k, w in v.items():
                            named = () if not path and k == "records" and isinstance(w, list) else (*path, k)
                            todo.append((w, named, f"{at}/{k.replace('~', '~0').replace('/', '~1')}"))
                    elif isinstance(v, list) and any(isinstance(w, dict) for w in v):
                        todo += [(w, path, f"{at}/{i}") for i, w in enumerate(v) if isinstance(w, dict)]
                    elif path:
                        kind = nested._kind(v)
                        out.append((rid, J.safe("_".join(path)), _TYPE.get(kind) or ("integer" if J.whole(v) is not None and "." not in str(v) and "E" not in str(v) else "number"), J.safe(at)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, s) for c in zip(*out, strict=True)], ["record_id", "field_path", "value_type", "pointer"])

    return records.select(F.col("record_id").cast("string"), "value").mapInArrow(run, "record_id string, field_path string, value_type string, pointer string")


def discover(records: DataFrame) -> DataFrame:
    """Fields suggested by JSON records: key, value_type (json if types differ),
    confidence (1 or 0.65), n_values, first pointer."""
    g = leaf_paths(records).where("value_type <> 'null'").groupBy(S.field_key("field_path").alias("key")).agg(F.min("value_type").alias("lo"), F.max("value_type").alias("hi"), F.count("*").alias("n_values"), F.min("pointer").alias("evidence"))
    same = F.col("lo") == F.col("hi")
    return g.where("key is not null").select("key", F.when(same, F.col("lo")).otherwise("json").alias("value_type"), F.when(same, 1.0).otherwise(0.65).alias("confidence"), "n_values", "evidence")


def outcomes(suggestions: DataFrame, registry_keys: DataFrame, pending_keys: DataFrame, budget: int) -> DataFrame:
    """suggestions (run_id, ordinal, key): what executing them in order would do:
    duplicate in the run, already represented, already pending, created, or over
    the run's budget of creations."""
    first = F.row_number().over(Window.partitionBy("run_id", "key").orderBy("ordinal"))
    j = suggestions.withColumn("nth", first).join(registry_keys.select("key", F.lit(True).alias("have")).distinct(), "key", "left").join(pending_keys.select("key", F.lit(True).alias("wait")).distinct(), "key", "left")
    fresh = (F.col("nth") == 1) & F.col("have").isNull() & F.col("wait").isNull()
    made = F.sum(fresh.cast("int")).over(Window.partitionBy("run_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0))
    out = (F.when(F.col("nth") > 1, "skipped_duplicate").when(F.col("have"), "skipped_represented").when(F.col("wait"), "skipped_pending").when(made > budget, "budget_exhausted").otherwise("created"))
    return j.select("run_id", "ordinal", "key", out.alias("outcome"))


def consensus(signals: DataFrame, conflicts: DataFrame) -> DataFrame:
    """signals (key, run_id, backend, root, basis, value_type, ordinal; the first per
    run and key counts) and conflicts (key, n_conflicts) to one status per key.
    Support is independent where backend and root together differ."""
    w = Window.partitionBy("run_id", "key").orderBy("ordinal")
    s = signals.withColumn("nth", F.row_number().over(w)).where("nth = 1")
    g = s.groupBy("key").agg(F.count("*").alias("raw_support"), F.count_distinct("backend", "root").alias("independent_support"), F.count_distinct("backend").alias("n_backends"), F.count_distinct("root").alias("n_roots"), F.count_distinct("basis").alias("n_bases"), F.count_distinct("value_type").alias("n_types"))
    g = g.join(conflicts, "key", "left")
    ind = F.col("independent_support")
    status = (F.when(F.col("n_bases") > 1, "basis_incompatible").when(F.col("n_types") > 1, "incompatible").when((F.col("raw_support") >= 2) & (ind <= 1), "insufficient_independence")
              .when(F.coalesce("n_conflicts", F.lit(0)) > 0, "disputed").when((ind >= 2) & (F.col("n_backends") >= 2) & (F.col("n_roots") >= 2), "strong_agreement")
              .when(ind >= 2, "weak_agreement").otherwise("insufficient_independence"))
    return g.select("key", "raw_support", "independent_support", "n_backends", "n_roots", "n_types", status.alias("status"))


def first_match(df: DataFrame, name: str, rules: list[tuple[Column, str]], otherwise: str) -> DataFrame:
    """A decision table: the result of the first rule that holds (null doesn't)."""
    out = None
    for cond, result in rules:
        out = F.when(cond, result) if out is None else out.when(cond, result)
    return df.withColumn(name, out.otherwise(otherwise) if out is not None else F.lit(otherwise))


def rates(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """Share of the rows with each flag; 0 of no rows."""
    n = F.count("*")
    return df.agg(n.alias("n"), *[F.when(n > 0, F.count_if(c) / n).otherwise(0.0).alias(k) for k, c in flags.items()])


def greedy_fill(ranked: DataFrame, group: str, order: list[str], cost: str, budget: int, most: int) -> DataFrame:
    """Walk each group's candidates in order, taking those that still fit into the
    budget (others are passed over), until `most` are taken. A group's candidates
    are the bounded result of a ranking."""
    row = F.struct(*order, *[c for c in ranked.columns if c not in order])
    kind = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in ranked.select(row.alias("r")).schema["r"].dataType)
    start = F.struct(F.lit(float(budget)).alias("left"), F.lit(0).alias("taken"), F.array().cast(f"array<struct<{kind}>>").alias("kept"))

    def step(acc, x):
        ok = (acc["taken"] < most) & (x[cost] <= acc["left"])
        kept = F.struct((acc["left"] - x[cost]).cast("double").alias("left"), (acc["taken"] + 1).alias("taken"), F.concat(acc["kept"], F.array(x)).alias("kept"))
        return F.when(ok, kept).otherwise(acc)

    g = ranked.groupBy(F.col(group).alias("__g")).agg(F.sort_array(F.collect_list(row)).alias("s"))
    return g.select(F.explode(F.aggregate("s", start, step)["kept"]).alias("x")).select("x.*").select(*ranked.columns)
