"""Queries of the general problems: wide rows, nested records, history, differences."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcell.operators import difference, history, nested, wide
from loomcell.runtime import load

#: Namespaces whose fields grow with the data; p1_wide has typed maps for these and a
#: typed column for every field of the fixed ones.
OPEN_NAMESPACES = "lab_"


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return wide.unfit_cells(load(spark, d, "cells"), load(spark, d, "fields"))


def p1_wide(spark: SparkSession, d: str) -> DataFrame:
    fields = load(spark, d, "fields")
    types = wide.field_types(fields).where(~F.coalesce("namespace", F.lit("")).startswith(OPEN_NAMESPACES))
    columns = [(i, n or i, t) for i, n, t in types.select("field_id", "field_key", "value_type").orderBy("field_key", "field_id").collect()]
    taken = Counter([n.lower() for _, n, _ in columns] + ["entity_id", *wide.OTHERS, "unfit_fields", "null_fields", "n_cells"])
    columns = [(i, n if taken[n.lower()] == 1 else f"{n}_{i[:8]}", t) for i, n, t in columns]
    return wide.wide_rows(load(spark, d, "cells"), fields, columns)


def p1_states(spark: SparkSession, d: str) -> DataFrame:
    s = wide.cell_states(load(spark, d, "cells"), load(spark, d, "fields"))
    return s.groupBy("value_type", "state").agg(F.count("*").alias("n_cells"))


def _records(spark: SparkSession, d: str, only_objects: bool) -> DataFrame:
    return nested.store_records(load(spark, d, "field_events"), load(spark, d, "field_agent_actions"), load(spark, d, "cells"), only_objects)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.array_objects(_records(spark, d, True))


def p2_nodes(spark: SparkSession, d: str) -> DataFrame:
    return nested.node_rows(_records(spark, d, False))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    h = history.history(load(spark, d, "field_events"), "field_id", "created_at", "id", "to_status")
    return h.select("field_id", "opened_by", F.coalesce("closed_by", F.lit(0)).alias("closed_by"))


def p4_history(spark: SparkSession, d: str) -> DataFrame:
    return history.history(load(spark, d, "field_events"), "field_id", "created_at", "id", "to_status")


def _difference(spark: SparkSession, d: str) -> DataFrame:
    return difference.differences(load(spark, d, "snapshot_records"), load(spark, d, "store_records"), "entity_id", "observed_at", ["kind", "label"], "values_json", "snapshot_only", "store_only")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _difference(spark, d).select("entity_id", "side", "field_name")


def p7_differences(spark: SparkSession, d: str) -> DataFrame:
    return _difference(spark, d)


# JSON by RFC 8259: json_valid also takes words and trailing commas.
_VALID = r"""json_valid({v}) AND NOT regexp_matches(regexp_replace({v}, '"([^"\\]|\\.)*"', '""', 'g'), ',\s*[\]}}]|[A-DF-Zb-dg-kmo-qv-z]')"""
_SIDES = """a AS (SELECT * FROM snapshot_records QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY observed_at DESC) = 1),
b AS (SELECT * FROM store_records QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY observed_at DESC) = 1)"""
# Members by value: numbers exactly, strings as they are, the rest as compact text.
_MEMBER = """SELECT entity_id, k, CASE WHEN json_type(v) IN ('BIGINT', 'UBIGINT', 'HUGEINT', 'DOUBLE') THEN CAST(CAST(CAST(v AS VARCHAR) AS DECIMAL(38, 12)) AS VARCHAR) WHEN json_type(v) = 'VARCHAR' THEN 's' || (v ->> '$') ELSE CAST(v AS VARCHAR) END AS v
FROM (SELECT entity_id, k, json_extract(values_json, '$."' || k || '"') AS v FROM (SELECT entity_id, values_json, unnest(json_keys(values_json)) AS k FROM {t}))"""

ORACLE = {
    "p1_found": r"""WITH c AS (SELECT * FROM cells QUALIFY row_number() OVER (PARTITION BY entity_id, field_id ORDER BY updated_at DESC) = 1),
f AS (SELECT DISTINCT id, value_type FROM fields),
-- what is no JSON by RFC 8259, though json_valid takes it: words, trailing commas
j AS (SELECT entity_id, field_id, value_type, value_json AS v, json_valid(value_json) AND NOT regexp_matches(regexp_replace(value_json, '"([^"\\\\]|\\\\.)*"', '""', 'g'), ',\s*[\]}]|[A-DF-Zb-dg-kmo-qv-z]') AS ok FROM c JOIN f ON f.id = c.field_id),
k AS (SELECT *, CASE WHEN ok THEN json_type(v) END AS t, trim(CASE WHEN ok AND json_type(v) = 'VARCHAR' THEN json_extract_string(v, '$') ELSE v END, ' ') AS x FROM j),
n AS (SELECT *, regexp_full_match(x, '-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?') AS num, lower(x) IN ('true', 'false') AS truth FROM k)
SELECT entity_id, field_id FROM n WHERE NOT CASE WHEN v IS NULL OR NOT ok THEN false WHEN t = 'NULL' OR value_type = 'json' THEN true
WHEN value_type = 'text' THEN t NOT IN ('ARRAY', 'OBJECT') WHEN value_type = 'array' THEN t = 'ARRAY' WHEN value_type = 'object' THEN t = 'OBJECT'
WHEN value_type = 'boolean' THEN truth AND t IN ('BOOLEAN', 'VARCHAR') WHEN t IN ('ARRAY', 'OBJECT', 'BOOLEAN') THEN false WHEN value_type = 'number' THEN num
ELSE num AND TRY_CAST(x AS DECIMAL(38, 10)) = floor(TRY_CAST(x AS DECIMAL(38, 10))) AND TRY_CAST(x AS DECIMAL(38, 10)) BETWEEN -9223372036854775808 AND 9223372036854775807 END""".replace("\\\\", "\\"),
    "p4_found": """WITH x AS (SELECT field_id, created_at, arg_max(id, id) AS id, arg_max(to_status, id) AS st FROM field_events WHERE to_status IS NOT NULL GROUP BY 1, 2),
y AS (SELECT *, lag(st) OVER (PARTITION BY field_id ORDER BY created_at) AS p FROM x), z AS (SELECT * FROM y WHERE p IS DISTINCT FROM st)
SELECT field_id, id AS opened_by, coalesce(lead(id) OVER (PARTITION BY field_id ORDER BY created_at), 0) AS closed_by FROM z""",
    "p4_history": """WITH x AS (SELECT field_id, created_at, arg_max(id, id) AS id, arg_max(to_status, id) AS st FROM field_events WHERE to_status IS NOT NULL GROUP BY 1, 2),
y AS (SELECT *, lag(st) OVER (PARTITION BY field_id ORDER BY created_at) AS p FROM x), z AS (SELECT * FROM y WHERE p IS DISTINCT FROM st)
SELECT field_id, st AS to_status, id AS opened_by, lead(id) OVER w AS closed_by, created_at AS opened_at, lead(created_at) OVER w AS closed_at FROM z WINDOW w AS (PARTITION BY field_id ORDER BY created_at)""",
}

ORACLE["p2_found"] = f"""WITH RECURSIVE src AS (SELECT 'field_events' AS source_table, CAST(id AS VARCHAR) AS record_id, max(evidence_json) AS v FROM field_events GROUP BY id UNION ALL SELECT 'field_agent_actions', CAST(id AS VARCHAR), max(output_json) FROM field_agent_actions GROUP BY id
UNION ALL SELECT 'cells', entity_id || ':' || field_id, arg_max(value_json, updated_at) FROM cells GROUP BY entity_id, field_id), good AS (SELECT * FROM src WHERE CASE WHEN v IS NULL THEN false ELSE {_VALID.format(v='v')} END),
t AS (SELECT g.source_table, g.record_id, j.id, j.parent, j.key, j.type FROM good g, LATERAL json_tree(g.v) j),
r(source_table, record_id, id, type, ptr, is_case, around) AS (SELECT source_table, record_id, id, type, '', false, '' FROM t WHERE parent IS NULL
UNION ALL SELECT t.source_table, t.record_id, t.id, t.type, r.ptr || '/' || replace(replace(t.key, '~', '~0'), '/', '~1'), t.type = 'OBJECT' AND r.type = 'ARRAY', CASE WHEN r.is_case THEN r.ptr ELSE r.around END FROM r JOIN t ON t.source_table = r.source_table AND t.record_id = r.record_id AND t.parent = r.id)
SELECT source_table, record_id, ptr AS node_path, around AS parent_path FROM r WHERE is_case"""

ORACLE["p7_found"] = f"""WITH {_SIDES}, ma AS ({_MEMBER.format(t='a')}), mb AS ({_MEMBER.format(t='b')}), j AS (SELECT a.entity_id, a.kind IS DISTINCT FROM b.kind AS dk, a.label IS DISTINCT FROM b.label AS dl FROM a JOIN b ON a.entity_id = b.entity_id)
SELECT entity_id, 'snapshot_only' AS side, '' AS field_name FROM a WHERE entity_id NOT IN (SELECT entity_id FROM b) UNION ALL SELECT entity_id, 'store_only', '' FROM b WHERE entity_id NOT IN (SELECT entity_id FROM a)
UNION ALL SELECT entity_id, 'both', 'entity.kind' FROM j WHERE dk UNION ALL SELECT entity_id, 'both', 'entity.label' FROM j WHERE dl
UNION ALL SELECT coalesce(ma.entity_id, mb.entity_id), 'both', coalesce(ma.k, mb.k) FROM ma FULL JOIN mb ON ma.entity_id = mb.entity_id AND ma.k = mb.k WHERE ma.v IS DISTINCT FROM mb.v AND coalesce(ma.entity_id, mb.entity_id) IN (SELECT entity_id FROM j)"""

ORACLE["p1_states"] = ORACLE["p1_found"][: ORACLE["p1_found"].index("SELECT entity_id, field_id FROM n WHERE NOT CASE")] + ", s AS (SELECT value_type, CASE WHEN ok AND t = 'NULL' THEN 'null' WHEN " + ORACLE["p1_found"][ORACLE["p1_found"].index("CASE WHEN v IS NULL") :] + " THEN 'fits' ELSE 'unfit' END AS state FROM n) SELECT value_type, state, count(*) AS n_cells FROM s GROUP BY ALL"


def _table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def q(spark: SparkSession, d: str) -> DataFrame:
        return nested.node_tables(_records(spark, d, False))[name]

    q.__name__ = f"p2_{name}"
    return q


QUERIES = {f.__name__: f for f in (p1_found, p1_wide, p1_states, p2_found, p2_nodes, *map(_table, nested.NODE_TABLES), p4_found, p4_history, p7_found, p7_differences)}
