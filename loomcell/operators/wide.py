"""Attribute-value rows into wide rows: log-structured upserts.

Batches of cells become runs of sparse wide deltas (one row per entity and batch,
its cells with their versions, sorted), and runs are compacted by the latest
version per cell. Compaction shuffles on (entity, field), pre-aggregated before
the shuffle, so neither an entity, a field nor a cell with a third of all rows
lands in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcell.functions import jsontext as J
from loomcell.runtime import latest, lookup_join, ship

_CELL_BITS = [("field_id", pa.string()), ("version", pa.int64()), ("bits", pa.int32())]
_CELL_TYPED = [*_CELL_BITS, ("text", pa.string()), ("whole", pa.int64()), ("number", pa.float64()), ("truth", pa.bool_()), ("json", pa.string())]
_DDL = {pa.string(): "string", pa.int64(): "bigint", pa.int32(): "int", pa.float64(): "double", pa.bool_(): "boolean"}
#: The version of a cell without a time: older than all others.
_NEVER = -(2**63)


def _run(batch: pa.RecordBatch, with_values: bool) -> pa.RecordBatch:
    """One batch of cells as sparse wide deltas, sorted by entity and field."""
    entity, field, value, version = batch.columns
    bits, values = [], []
    for s in value.to_pylist():
        try:
            x = J.parse(s) if s is not None else None
        except J.NotJson:
            bits.append(0)
            values.append((None, None, None, None, s))
        else:
            # a cell without text isn't JSON; it fits nothing, like broken text
            bits.append(J.fit_bits(x) if s is not None else 0)
            values.append((J.typed(x) if s is not None else (None,) * 5) if with_values else ())
    cols = {"entity_id": entity, "field_id": field, "version": pc.fill_null(version, _NEVER), "bits": pa.array(bits, pa.int32())}
    spec = _CELL_TYPED if with_values else _CELL_BITS
    if with_values:
        for i, (name, kind) in enumerate(spec[3:]):
            cols[name] = pa.array([v[i] for v in values], kind)
    order = [("entity_id", "ascending"), ("field_id", "ascending"), ("version", "ascending"), ("bits", "ascending")]
    t = pa.table(cols).sort_by(order + ([("json", "ascending")] if with_values else [])).combine_chunks()
    n = len(t)

    def changes(*names: str) -> list[int]:
        """Row numbers at which a new group of these columns begins."""
        new = pa.array([False] * (n - 1), pa.bool_())
        for c in names:
            col = t[c].combine_chunks()
            new = pc.or_(new, pc.not_equal(col.slice(1), col.slice(0, n - 1)))
        return [0, *[i + 1 for i, x in enumerate(new.to_pylist()) if x]]

    last = [i - 1 for i in changes("entity_id", "field_id")[1:]] + [n - 1]  # the latest version within the batch
    t = t.take(pa.array(last, pa.int64())).combine_chunks()
    n = len(t)
    first = changes("entity_id")
    cell = pa.StructArray.from_arrays([t[name].combine_chunks() for name, _ in spec], [name for name, _ in spec])
    cells = pa.ListArray.from_arrays(pa.array([*first, n], pa.int32()), cell)
    return pa.RecordBatch.from_arrays([t["entity_id"].combine_chunks().take(pa.array(first, pa.int64())), cells], ["entity_id", "cells"])


def delta_runs(cells: DataFrame, with_values: bool = True) -> DataFrame:
    """cells (entity_id, field_id, value_json, updated_at) as runs of sparse wide
    deltas: entity_id, cells (array of field_id, version, bits and typed values),
    one row per entity and Arrow batch, each cell in its latest version there.

    bits: the value types that the value fits (jsontext.TYPE_BITS), IS_NULL for
    JSON null, IS_JSON if it is JSON at all; 0 for broken and SQL-null values.
    Cells without an entity or a field are no cells and are left out. A null
    updated_at is older than any other. Other columns of the input are ignored.
    """
    ship(cells.sparkSession)
    spec = _CELL_TYPED if with_values else _CELL_BITS
    schema = f"entity_id string, cells array<struct<{', '.join(f'{n}:{_DDL[t]}' for n, t in spec)}>>"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield _run(b, with_values)

    return (cells.select("entity_id", "field_id", "value_json", F.unix_micros(F.col("updated_at").cast("timestamp")).alias("version"))
            .where("entity_id is not null and field_id is not null").mapInArrow(build, schema))


def compact(runs: DataFrame) -> DataFrame:
    """Any number of runs to the current cells: entity_id, field_id, version and
    the cell's columns, the latest version per cell. Equal versions with different
    contents: the greatest contents win, whatever the order of the runs."""
    cells = runs.select("entity_id", F.explode("cells").alias("c")).select("entity_id", "c.*")
    rest = [c for c in cells.columns if c not in ("entity_id", "field_id", "version")]
    return latest(cells, ["entity_id", "field_id"], ["version"], rest)


def append_runs(cells: DataFrame, path: str) -> None:
    """Upsert: append a batch's runs to a store of runs."""
    delta_runs(cells).write.mode("append").parquet(path)


def compact_store(spark, path: str, target: str) -> DataFrame:
    """Compact a store's runs into one base run per entity, written to target in
    the same form, so that later upserts append to it; returns the base run."""
    cur = compact(spark.read.parquet(path))
    rest = [c for c in cur.columns if c != "entity_id"]
    base = cur.groupBy("entity_id").agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("cells"))
    base.sortWithinPartitions("entity_id").write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def field_types(fields: DataFrame) -> DataFrame:
    """fields as field_id, value_type, key, namespace of their current rows."""
    one = latest(fields.where("id is not null"), ["id"], ["updated_at"], ["value_type", "normalized_key", "key", "namespace"])
    return one.select(F.col("id").alias("field_id"), "value_type", F.coalesce("normalized_key", "key").alias("field_key"), "namespace")


def _fits(bits: Column, value_type: Column) -> Column:
    mask = F.coalesce(*[F.when(value_type == t, F.lit(b)) for t, b in J.TYPE_BITS.items()])
    return bits.bitwiseAND(mask) != 0


def unfit_cells(cells: DataFrame, fields: DataFrame) -> DataFrame:
    """Current cells whose value doesn't fit the declared type: entity_id, field_id.

    A field with an unknown or null type, or not in the registry, declares nothing
    that a value could miss; its cells aren't reported."""
    cur = compact(delta_runs(cells, with_values=False)).select("entity_id", "field_id", "bits")
    typed = lookup_join(cur, field_types(fields).select("field_id", "value_type"), "field_id", spread=F.col("entity_id"))
    return typed.where(~_fits(F.col("bits"), F.col("value_type"))).select("entity_id", "field_id")


_TYPED = {"text": "text", "integer": "whole", "number": "number", "boolean": "truth"}
#: Maps of the fields without a column of their own, and the value types they hold.
OTHERS = {"other_texts": "text", "other_integers": "integer", "other_numbers": "number", "other_booleans": "boolean", "others": None}


def _typed_value(t: str | None) -> Column:
    return F.col(_TYPED.get(t, "json"))


def cell_states(cells: DataFrame, fields: DataFrame) -> DataFrame:
    """Current cells with their field's key, type and state: `null` for JSON null,
    `fits`, `unfit`; absent cells have no row."""
    cur = lookup_join(compact(delta_runs(cells)), field_types(fields), "field_id", spread=F.col("entity_id"))
    state = F.when(F.col("bits").bitwiseAND(J.IS_NULL) != 0, "null").when(_fits(F.col("bits"), F.col("value_type")), "fits").otherwise("unfit")
    return cur.withColumn("state", state)


def wide_rows(cells: DataFrame, fields: DataFrame, columns: list[tuple[str, str, str]]) -> DataFrame:
    """One row per entity: a typed column per listed field (field_id, name, type),
    all other fields by field id in maps of their type (`other_texts`,
    `other_integers`, `other_numbers`, `other_booleans`; the rest as canonical JSON
    in `others`), and the field ids of unfit and of JSON-null cells, so that in a null column absent
    (in neither), null and unfit cells stay apart.

    The number of typed columns is the caller's choice and bounded by it; an
    entity's arrays and map are bounded by the number of fields."""
    s = cell_states(cells, fields)
    listed = [i for i, _, _ in columns]
    fits = F.col("state") == "fits"
    picked = [F.max(F.when((F.col("field_id") == i) & fits, _typed_value(t))).alias(n) for i, n, t in columns]
    rest = fits & ~F.col("field_id").isin(listed) if listed else fits

    def other(t: str | None) -> Column:
        mine = F.col("value_type") == t if t else ~F.coalesce("value_type", F.lit("")).isin(*_TYPED)
        return F.map_from_entries(F.sort_array(F.collect_list(F.when(rest & mine, F.struct("field_id", _typed_value(t))))))

    def ids(state: str) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("state") == state, F.col("field_id"))))

    return s.groupBy("entity_id").agg(
        *picked, *[other(t).alias(n) for n, t in OTHERS.items()],
        ids("unfit").alias("unfit_fields"), ids("null").alias("null_fields"), F.count("*").alias("n_cells"))
