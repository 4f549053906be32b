"""Queries by name, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# Current rows of the store's tables, for use in WITH.
E = "e AS (SELECT * FROM entities QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1)"
FL = "f AS (SELECT * FROM fields QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1)"
C = "c AS (SELECT * FROM cells QUALIFY row_number() OVER (PARTITION BY entity_id, field_id ORDER BY updated_at DESC) = 1)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add
