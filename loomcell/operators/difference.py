"""Differences between two copies of a dataset.

Both sides are unpivoted to key-field-value rows, united with signed counts and
grouped; what doesn't cancel differs. One shuffle on the key serves all steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcell.functions import jsontext as J
from loomcell.runtime import ship

#: Stands for a text that is not a JSON object; it then is compared as a whole.
WHOLE = "*"


def members(text: str | None) -> list[tuple[str, str]]:
    """The top-level members of an object as (name, canonical value)."""
    if text is None:
        return []
    try:
        x = J.parse(text)
    except J.NotJson:
        return [(WHOLE, "!" + text)]
    if not isinstance(x, dict):
        return [(WHOLE, J.safe(J.canonical(x)))]
    return [(J.safe(k), J.safe(J.canonical(v))) for k, v in x.items()]


def _unpivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
    for b in batches:
        cols = [pa.array([[{"name": n, "value": v} for n, v in members(s)] for s in c.to_pylist()], kind) for c in b.columns[1:3]]
        yield pa.RecordBatch.from_arrays([b.columns[0], *cols, *b.columns[3:]], ["k", "va", "vb", "ha", "hb"])


def side_states(a: DataFrame, b: DataFrame, key: str, at: str, header: list[str], values: str) -> DataFrame:
    """The current state of every key on both sides in one row: k, va, vb (values
    text), ha, hb (header members as struct; null where a side lacks the key)."""

    def side(df: DataFrame, is_a: bool) -> DataFrame:
        return df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.lit(is_a).alias("is_a"), F.struct(F.col(at).alias("t"), F.struct(*header).alias("h"), F.col(values).alias("v")).alias("s"))

    both = side(a, True).unionByName(side(b, False))
    one = both.groupBy("k").agg(F.max(F.when(F.col("is_a"), F.col("s"))).alias("a"), F.max(F.when(~F.col("is_a"), F.col("s"))).alias("b"))
    return one.select("k", F.col("a.v").alias("va"), F.col("b.v").alias("vb"), F.col("a.h").alias("ha"), F.col("b.h").alias("hb"))


def differences(a: DataFrame, b: DataFrame, key: str, at: str, header: list[str], values: str, a_only: str, b_only: str) -> DataFrame:
    """Rows missing on a side and fields that differ: key, side (a_only, b_only or
    `both`), field_name ('' for a missing row), expected (canonical value of side
    a), actual (of side b); null for an absent member.

    The current state of a key is the one with the latest `at` (nulls oldest;
    equal times: the greatest contents). header columns are compared as fields
    `entity.<name>`, a null header equal to null only; members of the JSON object
    in `values` under their names, a null text like an empty object; a text that
    is not an object is compared whole under the name `*`. Rows without a key are
    no rows. Extra columns are ignored."""
    ship(a.sparkSession)
    st = side_states(a, b, key, at, header, values)
    h = f"struct<{','.join(f'{c}:{t}' for c, t in a.select(*header).dtypes)}>"
    flat = st.mapInArrow(_unpivot, f"k {dict(a.dtypes)[key]}, va array<struct<name:string,value:string>>, vb array<struct<name:string,value:string>>, ha {h}, hb {h}")

    def rows(hs: str, vs: str, sign: int) -> F.Column:
        head = F.array(*[F.struct(F.lit(f"entity.{c}").alias("name"), F.col(f"{hs}.{c}").cast("string").alias("value")) for c in header])
        cells = F.transform(F.concat(head, F.col(vs)), lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value"), F.lit(sign).alias("sign")))
        return F.when(F.col(hs).isNotNull(), cells).otherwise(F.array().cast("array<struct<name:string,value:string,sign:int>>"))

    # a row of a key on one side only stands for itself, its cells aren't listed
    lone = flat.where("ha is null or hb is null").select("k", F.when(F.col("hb").isNull(), a_only).otherwise(b_only).alias("side"), F.lit("").alias("field_name"), F.lit(None).cast("string").alias("expected"), F.lit(None).cast("string").alias("actual"))
    signed = flat.where("ha is not null and hb is not null").select("k", F.explode(F.concat(rows("ha", "va", 1), rows("hb", "vb", -1))).alias("c"))
    left = signed.groupBy("k", "c.name", "c.value").agg(F.sum("c.sign").alias("n")).where("n <> 0")
    cells = left.groupBy("k", "name").agg(F.max(F.when(F.col("n") > 0, F.col("value"))).alias("expected"), F.max(F.when(F.col("n") < 0, F.col("value"))).alias("actual"))
    cells = cells.select("k", F.lit("both").alias("side"), F.col("name").alias("field_name"), "expected", "actual")
    return lone.unionByName(cells).withColumnRenamed("k", key)


def unpivoted(df: DataFrame, key: str, values: str) -> DataFrame:
    """The members of each row's object as cells: key, field_key, value_json in
    canonical spelling. A null text has none; what is no object is one under `*`."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, names, made = [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                for n, v in members(text):
                    at.append(i)
                    names.append(n)
                    made.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(names, pa.string()), pa.array(made, pa.string())], [key, "field_key", "value_json"])

    return df.select(key, values).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, field_key string, value_json string")
