"""Nested records into flat node tables linked by interval labels.

A depth-first walk gives every node of a JSON value its pre-order and post-order
number. A node encloses another exactly if its pre number is smaller and its post
number greater, so parents, ancestors and subtrees are found by comparing numbers,
without the tree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcell.functions import jsontext as J
from loomcell.runtime import ship

#: pre, post, level, kind, is an array's element, name or index, parent's position, scalar's canonical text
Node = tuple[int, int, int, str, bool, str, int, str | None]


def _kind(x: Any) -> str:
    if isinstance(x, dict):
        return "object"
    if isinstance(x, list):
        return "array"
    if x is None:
        return "null"
    return "boolean" if x is True or x is False else "string" if isinstance(x, str) else "number"


def label(value: Any) -> list[Node]:
    """All nodes of a parsed value in pre-order, labelled; iterative."""
    nodes: list[list] = []
    post = 0
    todo: list[tuple] = [(value, 0, False, "", -1)]
    while todo:
        item = todo.pop()
        if len(item) == 1:  # all below it is done
            nodes[item[0]][1] = post
            post += 1
            continue
        x, level, element, name, parent = item
        kind = _kind(x)
        at = len(nodes)
        nodes.append([at, -1, level, kind, element, name, parent, None if kind in ("object", "array") else J.canonical(x)])
        todo.append((at,))
        if kind == "object":
            for k in reversed(list(x)):
                todo.append((x[k], level + 1, False, k, at))
        elif kind == "array":
            for i in range(len(x) - 1, -1, -1):
                todo.append((x[i], level + 1, True, str(i), at))
    return [tuple(n) for n in nodes]  # type: ignore[misc]


def pointer(nodes: list[Node], at: int) -> str:
    """JSON pointer of a node, made only where it is wanted: those of all nodes of
    a deep value together are longer than the value by its depth."""
    parts = []
    while at > 0:
        parts.append(nodes[at][5].replace("~", "~0").replace("/", "~1"))
        at = nodes[at][6]
    return "".join("/" + p for p in reversed(parts))


def enclosing(nodes: list[Node], among: Callable[[Node], bool]) -> list[int]:
    """For each node the position of the innermost node among the chosen that
    encloses it by its interval, -1 if none; nodes in pre-order."""
    out: list[int] = []
    open_: list[int] = []
    for i, n in enumerate(nodes):
        while open_ and nodes[open_[-1]][1] < n[1]:  # its interval ended
            open_.pop()
        out.append(open_[-1] if open_ else -1)
        if among(n):
            open_.append(i)
    return out


def _is_object(n: Node) -> bool:
    return n[3] == "object"


def _is_case(n: Node) -> bool:
    return n[3] == "object" and n[4]


def _nodes_of(text: str | None) -> list[Node]:
    if text is None:
        return []
    try:
        return label(J.parse(text))
    except J.NotJson:
        return []


_FLUSH = 20_000


def _emit(batches: Iterator[pa.RecordBatch], rows_of: Callable[[str], Iterator[tuple]], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows: list[tuple] = []
        table, record, value = (c.to_pylist() for c in b.columns)
        for t, r, v in zip(table, record, value, strict=True):
            rows.extend((t, r, *x) for x in rows_of(v))
            if len(rows) >= _FLUSH:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names)


def node_rows(records: DataFrame) -> DataFrame:
    """records (source_table, record_id, value) as one row per node: pre, post,
    level, kind, is_element, name, node_path (JSON pointer), value (canonical text
    of scalars), parent_pre (the enclosing object or array, -1 at the root).

    What is not JSON or null yields no rows. Of equally named members the last
    counts. Select by kind for the table of one node type."""
    ship(records.sparkSession)
    s, i, b = pa.string(), pa.int32(), pa.bool_()
    names = ["source_table", "record_id", "pre", "post", "level", "kind", "is_element", "name", "node_path", "value", "parent_pre"]
    types = [s, s, i, i, i, s, b, s, s, s, i]

    def rows_of(text: str) -> Iterator[tuple]:
        nodes = _nodes_of(text)
        for n, p in zip(nodes, enclosing(nodes, lambda n: n[3] in ("object", "array")), strict=True):
            yield (*n[:5], J.safe(n[5]), J.safe(pointer(nodes, n[0])), None if n[7] is None else J.safe(n[7]), p)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _emit(batches, rows_of, names, types)

    return records.select("source_table", "record_id", "value").mapInArrow(
        walk, "source_table string, record_id string, pre int, post int, level int, kind string, is_element boolean, name string, node_path string, value string, parent_pre int")


#: Node tables: the kinds that each holds.
NODE_TABLES = {"objects": ("object",), "arrays": ("array",), "scalars": ("string", "number", "boolean", "null")}


def node_tables(records: DataFrame) -> dict[str, DataFrame]:
    """One table per node type, linked by their interval labels: objects and arrays
    (with the number of their direct children), scalars (with their value). parent_pre
    is the pre of the enclosing object or array of the same record."""
    n = node_rows(records)
    link = ["source_table", "record_id", "pre", "post", "level", "parent_pre", "is_element", "name", "node_path"]
    return {t: n.where(F.col("kind").isin(*kinds)).select(*link, *(["kind", "value"] if t == "scalars" else [])) for t, kinds in NODE_TABLES.items()}


def array_objects(records: DataFrame) -> DataFrame:
    """Objects that are elements of arrays, each linked to the innermost such
    object around it: source_table, record_id, node_path, parent_path ('' if none)."""
    ship(records.sparkSession)
    s = pa.string()

    def rows_of(text: str) -> Iterator[tuple]:
        nodes = _nodes_of(text)
        around = enclosing(nodes, _is_case)
        for n, p in zip(nodes, around, strict=True):
            if _is_case(n):
                yield J.safe(pointer(nodes, n[0])), J.safe(pointer(nodes, p)) if p >= 0 else ""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _emit(batches, rows_of, ["source_table", "record_id", "node_path", "parent_path"], [s, s, s, s])

    return records.select("source_table", "record_id", "value").mapInArrow(walk, "source_table string, record_id string, node_path string, parent_path string")


def subtree(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """The nodes inside the given root nodes of the same record, by interval
    containment: an equi-join on the record with a range on the labels."""
    r = roots.select("source_table", "record_id", F.col("pre").alias("root_pre"), F.col("post").alias("root_post"))
    inside = (F.col("pre") > F.col("root_pre")) & (F.col("post") < F.col("root_post"))
    return nodes.join(r, ["source_table", "record_id"]).where(inside)


def store_records(events: DataFrame, actions: DataFrame, cells: DataFrame, only_objects: bool = True) -> DataFrame:
    """The nested values of the store's three tables as source_table, record_id,
    value; copies once, cells in their current version.

    only_objects: values that can't hold an object in an array are emptied before
    the shuffle (a cell still takes part in the choice of the current one)."""

    def text(c: str) -> F.Column:
        v = F.col(c)
        return F.when(v.contains("[") & v.contains("{"), v) if only_objects else v

    def flat(df: DataFrame, table: str, col: str) -> DataFrame:
        d = df.select(F.col("id").cast("string").alias("record_id"), text(col).alias("value")).where("record_id is not null and value is not null")
        return d.groupBy("record_id").agg(F.max("value").alias("value")).select(F.lit(table).alias("source_table"), "record_id", "value")

    c = cells.where("entity_id is not null and field_id is not null").select("entity_id", "field_id", F.struct("updated_at", text("value_json").alias("value")).alias("v"))
    c = c.groupBy("entity_id", "field_id").agg(F.max("v").alias("v")).where("v.value is not null")
    c = c.select(F.lit("cells").alias("source_table"), F.concat_ws(":", "entity_id", "field_id").alias("record_id"), F.col("v.value").alias("value"))
    return flat(events, "field_events", "evidence_json").unionByName(flat(actions, "field_agent_actions", "output_json")).unionByName(c)
