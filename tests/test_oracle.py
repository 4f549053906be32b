"""Every query with SQL gives the same rows as DuckDB; the others run."""

import collections
import glob
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


def norm(v):
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (float, np.floating)) or type(v).__name__ == "Decimal":
        return None if math.isnan(v) else round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return collections.Counter(tuple(norm(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


#: The optional subpackage tests its own queries.
CORE = sorted(n for n, q in QUERIES.items() if ".llm" not in q.__module__)


@pytest.mark.parametrize("name", CORE)
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    got = [tuple(r) for r in df.collect()]
    assert len(set(df.columns)) == len(df.columns)
    if name in ORACLE:
        c = duck.execute(ORACLE[name])
        names = [x[0] for x in c.description]
        assert sorted(df.columns) == sorted(names)
        assert rows(df.columns, got) == rows(names, c.fetchall())


def test_entry_and_names():
    assert set(ORACLE) <= set(QUERIES)
    for n in (1, 2, 4, 7):
        assert f"p{n}_found" in QUERIES
