"""Reads over the store and the driver's tables: sources, filters, joins, aggregates, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomcell.functions import scalars as S
from loomcell.operators import anchors, assess, query as Q, refgraph, store
from loomcell.plans.registry import C, E, FL, query
from loomcell.runtime import latest, load, lookup_join
from loomcell.sources import exchange

# Allowed moves of a field's status.
MOVES = [("proposed", "active"), ("proposed", "deprecated"), ("active", "converged"), ("active", "merged"), ("active", "split"), ("active", "deprecated"),
         ("converged", "active"), ("converged", "merged"), ("converged", "split"), ("converged", "deprecated")]
_MOVES_SQL = ", ".join(f"'{a}>{b}'" for a, b in MOVES)


def E_(s: SparkSession, d: str) -> DataFrame:
    return store.entities(load(s, d, "entities"))


def F_(s: SparkSession, d: str) -> DataFrame:
    return store.fields(load(s, d, "fields"))


def C_(s: SparkSession, d: str) -> DataFrame:
    return store.cells(load(s, d, "cells"))


def _customer(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The customer table as entities, cells and a small registry."""
    cols = ["c_name", "c_acctbal", "c_mktsegment", "c_nationkey"]
    e, c = exchange.melt(load(s, d, "customer"), "customer", "c_custkey", cols, "c_name")
    reg = s.createDataFrame([(k, k, "text", "active") for k in cols], "id string, key string, value_type string, status string")
    e = e.withColumn("created_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    return e, c.withColumnRenamed("field_key", "field_id"), reg


# ---- sources and reads


@query("SELECT 'supplier:' || s_suppkey AS entity_id, u.k AS field_key, u.v AS value_json FROM supplier, LATERAL (VALUES ('s_name', '\"' || s_name || '\"'), ('s_nationkey', CAST(s_nationkey AS VARCHAR)), ('s_acctbal', CAST(s_acctbal AS VARCHAR))) u(k, v) WHERE u.v IS NOT NULL")
def s03_entity_values(s, d):
    return exchange.melt(load(s, d, "supplier"), "supplier", "s_suppkey", ["s_name", "s_nationkey", "s_acctbal"], "s_name")[1]


@query(f"WITH {E} SELECT id, kind, label, created_at FROM e ORDER BY created_at, id LIMIT 200 OFFSET 20")
def s04_entity_page(s, d):
    return store.page(E_(s, d).select("id", "kind", "label", "created_at"), ["created_at", "id"], 200, 20)


@query(f"WITH {FL} SELECT id, key, value_type, status FROM f WHERE id = 'record_title' OR key = 'record_title'")
def s05_field_lookup(s, d):
    return store.get_field(F_(s, d), "record_title").select("id", "key", "value_type", "status")


@query(f"WITH {E} SELECT id FROM e ORDER BY id LIMIT 10000")
def s11_entity_ids(s, d):
    return store.page(E_(s, d).select("id"), ["id"], 10_000)


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def s06_jsonl_roundtrip(s, d):
    """Supplier out as JSON Lines and in again."""
    from loomcell.runtime import shared_dir
    e, c = exchange.melt(load(s, d, "supplier"), "supplier", "s_suppkey", ["s_name", "s_nationkey"], "s_name")
    path = f"{shared_dir(s)}/jsonl-{abs(hash(d)) % 10**9}"
    exchange.write_jsonl(e, c, path)
    e2, c2, _ = exchange.read_jsonl(s, path)
    return _rebuild(e2, c2)


def _rebuild(e: DataFrame, c: DataFrame) -> DataFrame:
    w = c.groupBy(F.col("entity_id").alias("id")).agg(F.max(F.when(F.col("field_key") == "s_name", S.text_of_value(F.col("value_json")))).alias("s_name"), F.max(F.when(F.col("field_key") == "s_nationkey", F.col("value_json").cast("int"))).alias("s_nationkey"))
    return e.join(w, "id").select(F.split("id", ":")[1].cast("bigint").alias("s_suppkey"), "s_name", "s_nationkey")


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def s07_csv_roundtrip(s, d):
    """Supplier out as wide CSV and in again."""
    from loomcell.runtime import shared_dir
    e, c = exchange.melt(load(s, d, "supplier"), "supplier", "s_suppkey", ["s_name", "s_nationkey"], "s_name")
    path = f"{shared_dir(s)}/csv-{abs(hash(d)) % 10**9}"
    exchange.write_csv(e, c, ["s_name", "s_nationkey"], path)
    return _rebuild(*exchange.read_csv(s, path))


@query("SELECT event_id, ev.k AS field_path, ev.t AS value_type FROM (SELECT event_id, unnest(json_keys(props)) AS k0, props FROM events) x, LATERAL (SELECT x.k0 AS k, CASE json_type(json_extract(x.props, '$.' || x.k0)) WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'number' WHEN 'VARCHAR' THEN 'text' END AS t) ev")
def e12_leaf_paths(s, d):
    r = load(s, d, "events").select(F.col("event_id").alias("record_id"), F.col("props").alias("value"))
    return assess.leaf_paths(r).select(F.col("record_id").cast("bigint").alias("event_id"), "field_path", "value_type")


@query()
def e12_discover_fields(s, d):
    r = load(s, d, "field_agent_actions").select(F.col("id").alias("record_id"), F.col("output_json").alias("value"))
    return assess.discover(r)


# ---- changes


@query(f"WITH {C} SELECT entity_id, field_id, value_json, source, confidence, updated_at FROM c")
def k02_current_cells(s, d):
    return C_(s, d).select("entity_id", "field_id", "value_json", "source", "confidence", "updated_at")


@query("SELECT user_id, event_id, value FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) WHERE event_type <> 'error'")
def k03_state_without_deleted(s, d):
    ev = load(s, d, "events").withColumn("op", F.when(F.col("event_type") == "error", "delete").otherwise("set"))
    return store.changes(ev, ["user_id"], ["ts", "event_id"], "op", ["value"]).select("user_id", "value").join(latest(ev, ["user_id"], ["ts", "event_id"], ["op"]).where("op = 'set'").select("user_id", "event_id"), "user_id")


@query(f"""WITH x AS (SELECT DISTINCT id, field_id, to_status, created_at FROM field_events WHERE to_status IS NOT NULL),
y AS (SELECT *, lag(to_status) OVER (PARTITION BY field_id ORDER BY created_at, id) AS previous FROM x)
SELECT id, field_id, previous, to_status, (previous || '>' || to_status) IN ({_MOVES_SQL}) AS legal FROM y WHERE previous IS NOT NULL""")
def k06_transition_audit(s, d):
    ev = load(s, d, "field_events").where("to_status is not null").select("id", "field_id", "to_status", "created_at").distinct()
    return store.audit_transitions(ev, "field_id", ["created_at", "id"], "to_status", MOVES).select("id", "field_id", "previous", "to_status", "legal")


@query()
def k08_decide_proposals(s, d):
    return store.decide_proposals(load(s, d, "field_proposals"), F_(s, d))


@query()
def k09_add_aliases(s, d):
    a = load(s, d, "field_aliases")
    p = load(s, d, "field_proposals").select("namespace", F.col("key").alias("alias"), F.col("id").alias("field_id")).distinct()
    return store.add_aliases(p, a).select("namespace", "alias", "field_id", "state")


@query()
def k04_new_fields(s, d):
    ok, no = store.new_fields(load(s, d, "field_proposals").select("id", "namespace", "key").distinct(), F_(s, d))
    return ok.withColumn("reason", F.lit(None).cast("string")).select("id", "namespace", "key", "reason").unionByName(no.select("id", "namespace", "key", "reason"))


@query("""WITH x AS (SELECT DISTINCT id, status, description, updated_at FROM fields),
y AS (SELECT *, lag(struct_pack(s := status, d := description)) OVER w AS p, row_number() OVER w AS r FROM x WINDOW w AS (PARTITION BY id ORDER BY updated_at)),
z AS (SELECT * FROM y WHERE r = 1 OR p IS DISTINCT FROM struct_pack(s := status, d := description))
SELECT id, status, description, CAST(row_number() OVER (PARTITION BY id ORDER BY updated_at) AS INTEGER) AS version FROM z""")
def k10_versions(s, d):
    return store.versions(load(s, d, "fields"), "id", ["updated_at"], ["status", "description"]).select("id", "status", "description", "version")


@query(f"""WITH {FL}, m AS (SELECT id, (SELECT min(id) FROM f f2 WHERE f2.namespace = f.namespace) AS into_id FROM f WHERE status = 'merged')
SELECT id AS parent_field_id, into_id AS child_field_id, 'merged_into' AS relation FROM m WHERE id <> into_id""")
def k11_merge_edges(s, d):
    f = F_(s, d)
    into = f.groupBy("namespace").agg(F.min("id").alias("child_field_id"))
    e = f.where("status = 'merged'").join(into, "namespace")
    return e.where("id <> child_field_id").select(F.col("id").alias("parent_field_id"), "child_field_id", F.lit("merged_into").alias("relation"))


@query(f"""WITH {C}, {FL}, m AS (SELECT id, (SELECT min(id) FROM f f2 WHERE f2.namespace = f.namespace) AS into_id FROM f WHERE status = 'merged'),
j AS (SELECT c.entity_id, coalesce(m.into_id, c.field_id) AS field_id, c.value_json, c.updated_at, m.into_id IS NULL AS own FROM c LEFT JOIN m ON m.id = c.field_id AND m.id <> m.into_id)
SELECT entity_id, field_id, count(*) AS n FROM (SELECT DISTINCT entity_id, field_id FROM j) GROUP BY ALL""")
def g05_merged_cells(s, d):
    return store.merged_cells(C_(s, d), k11_merge_edges(s, d)).groupBy("entity_id", "field_id").agg(F.count("*").alias("n"))


# ---- projections and filters


@query("SELECT 'customer:' || c_custkey AS id, 'customer' AS kind, c_name AS label, '\"' || c_name || '\"' AS c_name, CAST(c_acctbal AS VARCHAR) AS c_acctbal, '\"' || c_mktsegment || '\"' AS c_mktsegment FROM customer ORDER BY 'customer:' || c_custkey LIMIT 1000 OFFSET 10")
def p01_view_matrix(s, d):
    e, c, reg = _customer(s, d)
    v = Q.make_view(reg, ["c_name", "c_acctbal", "c_mktsegment"])
    return Q.view_matrix(v, e, c, entity_limit=1000, entity_offset=10).drop("created_at")


@query(f"""WITH {E}, {C}, {FL}, w AS (SELECT id FROM e ORDER BY created_at, id LIMIT 2000)
SELECT w.id, f.key AS field_key, c.value_json FROM w JOIN c ON c.entity_id = w.id JOIN f ON f.id = c.field_id WHERE f.namespace = 'global'""")
def p01_store_window(s, d):
    rows = store.page(E_(s, d).select("id", "created_at"), ["created_at", "id"], 2000, 0, 5000)
    named = store.named_cells(C_(s, d), F_(s, d), namespace="global")
    # a page has at most 5000 rows
    return named.join(F.broadcast(rows.select(F.col("id").alias("entity_id"))), "entity_id", "left_semi").select(F.col("entity_id").alias("id"), "field_key", "value_json")


@query(f"WITH {FL} SELECT id, key, status FROM f WHERE (lower(key) LIKE '%snapshot%' OR lower(label) LIKE '%snapshot%' OR lower(description) LIKE '%snapshot%') AND status = 'active'")
def p03_field_search(s, d):
    return Q.filter_fields(F_(s, d), "SnapShot", "active").select("id", "key", "status")


@query("SELECT 'customer:' || c_custkey AS id, c_name AS label FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7")
def p04_find_two_cells(s, d):
    e, c, reg = _customer(s, d)
    return Q.find(e, c, reg, {"c_mktsegment": '"BUILDING"', "c_nationkey": "7"}, "customer").select("id", "label")


@query(f"WITH {E}, {C}, {FL} SELECT e.id FROM e LEFT JOIN (SELECT c.entity_id, c.value_json FROM c JOIN f ON f.id = c.field_id AND f.key = 'record_title') x ON x.entity_id = e.id WHERE x.value_json IS NULL OR x.value_json = 'null'")
def p05_find_null_safe(s, d):
    return Q.find_null_safe(E_(s, d), C_(s, d), F_(s, d), "record_title", None).select("id")


@query("SELECT DISTINCT id, source_ref, candidate_field_id, score FROM semantic_candidates WHERE source_kind = 'proposal' AND status = 'pending'")
def p06_candidates(s, d):
    return load(s, d, "semantic_candidates").where("source_kind = 'proposal' and status = 'pending'").select("id", "source_ref", "candidate_field_id", "score").distinct()


@query("SELECT DISTINCT p.id, p.namespace, p.key FROM field_proposals p WHERE NOT EXISTS (SELECT 1 FROM semantic_candidates c WHERE c.source_ref = p.id)")
def p07_unscored_proposals(s, d):
    p = load(s, d, "field_proposals").select("id", "namespace", "key").distinct()
    return p.join(load(s, d, "semantic_candidates").select(F.col("source_ref").alias("id")), "id", "left_anti")


@query(f"WITH {FL} SELECT id, label FROM f WHERE namespace IN ('paper', 'canon') AND status IN ('active', 'converged') AND value_type = 'text'")
def p08_filtered_registry(s, d):
    return F_(s, d).where(F.col("namespace").isin("paper", "canon") & F.col("status").isin("active", "converged") & (F.col("value_type") == "text")).select("id", "label")


@query("SELECT l_orderkey, l_linenumber, u.slot, u.v AS value FROM lineitem, LATERAL (VALUES (0, CAST(l_quantity AS VARCHAR)), (1, CASE WHEN l_discount = 0 THEN 'nil' ELSE CAST(l_discount AS VARCHAR) END), (2, CAST(l_tax AS VARCHAR))) u(slot, v) WHERE u.v <> 'nil'")
def p14_repeated_groups(s, d):
    li = load(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("m0"), F.when(F.col("l_discount") == 0, "nil").otherwise(F.col("l_discount").cast("string")).alias("m1"), F.col("l_tax").alias("m2"))
    g = refgraph.repeated_groups(li, ["l_orderkey", "l_linenumber"], {"value": "m"}, 3)
    return g.select("l_orderkey", "l_linenumber", F.explode("items").alias("i")).select("l_orderkey", "l_linenumber", "i.slot", "i.value")


@query(f"""WITH {E}, {C}, {FL}, w AS (SELECT id FROM e ORDER BY created_at, id LIMIT 50), v AS (SELECT id, key <> 'record_title' AS hidden FROM f WHERE namespace IN ('global', 'canon'))
SELECT w.id AS entity_id, v.id AS field_id, CASE WHEN v.hidden THEN 'unloaded' WHEN c.value_json IS NULL THEN 'absent' WHEN c.value_json = 'null' THEN 'blank' ELSE 'present' END AS state,
CASE WHEN NOT v.hidden AND c.value_json <> 'null' THEN c.value_json END AS value_json FROM w CROSS JOIN v LEFT JOIN c ON c.entity_id = w.id AND c.field_id = v.id""")
def p15_five_states(s, d):
    v = F_(s, d).where(F.col("namespace").isin("global", "canon")).select(F.col("id").alias("field_id"), (F.col("key") == "record_title").alias("loaded"))
    ids = store.page(E_(s, d).select("id", "created_at"), ["created_at", "id"], 50).select(F.col("id").alias("entity_id"))
    return Q.slots(C_(s, d), v, ids)


@query("SELECT s_suppkey, CAST(row_number() OVER (PARTITION BY s_nationkey % 5 ORDER BY CASE WHEN s_nationkey < 10 THEN 0 ELSE 1 END, s_nationkey, s_suppkey) AS INTEGER) AS rank FROM supplier WHERE s_acctbal > 0 AND s_nationkey <> 3")
def p16_placement_rank(s, d):
    ok = load(s, d, "supplier").where("s_acctbal > 0 and s_nationkey <> 3").withColumn("g", F.col("s_nationkey") % 5)
    return store.rank_within(ok, ["g"], [F.when(F.col("s_nationkey") < 10, 0).otherwise(1), F.col("s_nationkey"), F.col("s_suppkey")], 10**9).select("s_suppkey", "rank")


@query("SELECT doc_id, regexp_matches(text, '[A-Za-z0-9]{28,}') AS long_run FROM documents")
def p20_secret_runs(s, d):
    return load(s, d, "documents").select("doc_id", F.col("text").rlike("[A-Za-z0-9]{28,}").alias("long_run"))


@query(f"WITH {FL} SELECT lower(key) AS folded, count(DISTINCT key) AS n_keys FROM f GROUP BY 1 HAVING count(DISTINCT key) > 1")
def p24_case_collisions(s, d):
    return F_(s, d).groupBy(F.lower("key").alias("folded")).agg(F.count_distinct("key").alias("n_keys")).where("n_keys > 1")


@query(f"""WITH {FL}, {E}, {C}, a AS (SELECT 'field' AS type, id, label, key, 0 AS o0, key AS o1, id AS o2 FROM f WHERE key LIKE '%snapshot%' OR lower(label) LIKE '%snapshot%' OR lower(description) LIKE '%snapshot%'),
b AS (SELECT 'entity' AS type, id, label, NULL AS key, 1, label, id FROM e WHERE lower(id) LIKE '%snapshot%' OR lower(label) LIKE '%snapshot%'),
x AS (SELECT 'cell' AS type, c.entity_id AS id, e.label, f.key, 2, e.label || chr(31) || f.key, c.entity_id FROM c JOIN f ON f.id = c.field_id JOIN e ON e.id = c.entity_id WHERE lower(c.value_json) LIKE '%snapshot%')
SELECT type, id, label, key FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM x) ORDER BY o0, o1, o2 LIMIT 400""")
def x01_search_union(s, d):
    return Q.search(F_(s, d), E_(s, d), C_(s, d), "snapshot", 400)


# ---- joins


@query(f"WITH {C}, {FL} SELECT f.namespace, f.value_type, count(*) AS n FROM c JOIN f ON f.id = c.field_id GROUP BY ALL")
def j01_cells_by_type(s, d):
    f = F_(s, d).select(F.col("id").alias("field_id"), "namespace", "value_type")
    return lookup_join(C_(s, d), f, "field_id", spread=F.col("entity_id")).groupBy("namespace", "value_type").agg(F.count("*").alias("n"))


@query(f"WITH {C}, {FL}, {E} SELECT e.kind, f.namespace, count(*) AS n, count(DISTINCT e.id) AS n_entities FROM c JOIN f ON f.id = c.field_id JOIN e ON e.id = c.entity_id GROUP BY ALL")
def j02_cells_by_kind(s, d):
    f = F_(s, d).select(F.col("id").alias("field_id"), "namespace")
    j = lookup_join(C_(s, d), f, "field_id", spread=F.col("entity_id")).join(E_(s, d).select(F.col("id").alias("entity_id"), "kind"), "entity_id")
    return j.groupBy("kind", "namespace").agg(F.count("*").alias("n"), F.count_distinct("entity_id").alias("n_entities"))


@query(f"WITH {FL} SELECT f.id, f.key, count(DISTINCT a.id) AS n_aliases FROM f LEFT JOIN field_aliases a ON a.field_id = f.id GROUP BY ALL")
def j08_alias_counts(s, d):
    a = load(s, d, "field_aliases").groupBy(F.col("field_id").alias("id")).agg(F.count_distinct(F.col("id")).alias("n"))
    return F_(s, d).join(a, "id", "left").select("id", "key", F.coalesce("n", F.lit(0)).alias("n_aliases"))


@query(f"WITH {E} SELECT id FROM e WHERE NOT EXISTS (SELECT 1 FROM documents x WHERE x.entity_id = e.id)")
def j13_entities_without_documents(s, d):
    return E_(s, d).select("id").join(load(s, d, "documents").select(F.col("entity_id").alias("id")), "id", "left_anti")


@query("SELECT source_ref, arg_max(candidate_field_id, struct_pack(s := score, c := candidate_field_id)) AS best FROM (SELECT * FROM semantic_candidates QUALIFY row_number() OVER (PARTITION BY source_kind, source_ref, candidate_field_id ORDER BY created_at DESC) = 1) WHERE score IS NOT NULL GROUP BY 1")
def j06_best_candidate(s, d):
    c = latest(load(s, d, "semantic_candidates"), ["source_kind", "source_ref", "candidate_field_id"], ["created_at"], ["score"]).where("score is not null")
    return c.groupBy("source_ref").agg(F.max(F.struct("score", "candidate_field_id")).alias("b")).select("source_ref", F.col("b.candidate_field_id").alias("best"))


@query("SELECT source_kind AS relation_type, source_ref AS source, candidate_field_id AS target, count(DISTINCT id) AS n FROM semantic_candidates GROUP BY ALL")
def j12_relation_triples(s, d):
    x = load(s, d, "semantic_candidates").select(F.col("id").alias("entity_id"), "source_kind", "source_ref", "candidate_field_id")
    cell = lambda k, c: F.struct(F.lit(k).alias("field_key"), F.col(c).alias("value_json"))
    c = x.select("entity_id", F.explode(F.array(cell("relation_type", "source_kind"), cell("source", "source_ref"), cell("target", "candidate_field_id"))).alias("x")).select("entity_id", "x.*")
    return refgraph.triples(c).groupBy("relation_type", "source", "target").agg(F.count("*").alias("n"))


@query("SELECT d.doc_id, count(*) OVER (PARTITION BY text) - 1 AS n_copies, count(*) OVER (PARTITION BY entity_id) AS n_siblings FROM documents d WHERE entity_id IS NOT NULL")
def j17_document_copies(s, d):
    docs = load(s, d, "documents").where("entity_id is not null").select("doc_id", "entity_id", F.xxhash64("text").alias("h"), F.md5("text").alias("m"))
    # counts are pre-aggregated, so neither a text nor an entity with a third of the rows is gathered
    copies = docs.groupBy("h", "m").agg((F.count("*") - 1).alias("n_copies"))
    sib = docs.groupBy("entity_id").agg(F.count("*").alias("n_siblings"))
    j = lookup_join(docs.withColumn("k", F.struct("h", "m")), copies.select(F.struct("h", "m").alias("k"), "n_copies"), "k", spread=F.col("doc_id"))
    return lookup_join(j, sib, "entity_id", spread=F.col("doc_id")).select("doc_id", "n_copies", "n_siblings")


@query("""SELECT o_orderkey, c_name, n_name, r_name, count(l_linenumber) AS n_lines, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) AS suppliers
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, c_name, n_name, r_name""")
def j18_provenance_chain(s, d):
    li = load(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("l_linenumber").alias("n_lines"), F.array_join(F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))), ",").alias("suppliers"))
    o = load(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(load(s, d, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("n_nationkey")), "c_custkey")
    n = load(s, d, "nation").join(load(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    return lookup_join(o, n, "n_nationkey").join(li, "o_orderkey", "left").select("o_orderkey", "c_name", "n_name", "r_name", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), "suppliers")


@query("SELECT d.doc_id, s.label AS name FROM documents d JOIN (SELECT DISTINCT split_part(label_en, ' ', 1) AS label FROM c4b) s ON contains(d.text, s.label)")
def j21_text_mentions(s, d):
    names = load(s, d, "c4b").select(F.split("label_en", " ")[0].alias("name")).distinct().withColumn("name_id", F.col("name"))
    m = refgraph.text_mentions(load(s, d, "documents").select(F.col("doc_id").alias("text_id"), "text"), names)
    return m.select(F.col("text_id").alias("doc_id"), F.col("name_id").alias("name"))


@query("SELECT field_id, max(created_at) AS at, arg_max(id, struct_pack(c := created_at, i := id)) AS event_id FROM field_events WHERE event_type = 'converged' GROUP BY 1")
def j22_latest_converged(s, d):
    e = load(s, d, "field_events").where("event_type = 'converged'")
    return e.groupBy("field_id").agg(F.max(F.struct("created_at", "id")).alias("m")).select("field_id", F.col("m.created_at").alias("at"), F.col("m.id").alias("event_id"))


@query("""WITH a AS (SELECT * FROM snapshot_records QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY observed_at DESC) = 1), b AS (SELECT * FROM store_records QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY observed_at DESC) = 1)
SELECT coalesce(a.entity_id, b.entity_id) AS entity_id, a.kind IS NOT DISTINCT FROM b.kind AS same_kind, a.label IS NOT DISTINCT FROM b.label AS same_label FROM a FULL JOIN b ON a.entity_id = b.entity_id WHERE a.kind IS DISTINCT FROM b.kind OR a.label IS DISTINCT FROM b.label""")
def j23_registry_reconcile(s, d):
    def cur(t: str, p: str) -> DataFrame:
        return latest(load(s, d, t), ["entity_id"], ["observed_at"], ["kind", "label"]).select("entity_id", F.col("kind").alias(f"{p}k"), F.col("label").alias(f"{p}l"))
    j = cur("snapshot_records", "a").join(cur("store_records", "b"), "entity_id", "full_outer")
    k, m = F.col("ak").eqNullSafe(F.col("bk")), F.col("al").eqNullSafe(F.col("bl"))
    return j.select("entity_id", k.alias("same_kind"), m.alias("same_label")).where("not (same_kind and same_label)")


@query("SELECT p_partkey, count(l_orderkey) AS n_uses FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1")
def j25_usage_counts(s, d):
    u = load(s, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    return load(s, d, "part").select("p_partkey").join(u, "p_partkey", "left").select("p_partkey", F.coalesce("n", F.lit(0)).alias("n_uses"))


# ---- aggregates


@query(f"""WITH {FL}, {E}, {C} SELECT (SELECT count(*) FROM f) AS fields, (SELECT count(*) FROM f WHERE status = 'active') AS active_fields, (SELECT count(*) FROM f WHERE status = 'converged') AS converged_fields,
(SELECT count(*) FROM e) AS entities, (SELECT count(*) FROM c) AS cells, (SELECT count(DISTINCT id) FROM field_proposals) AS proposals, (SELECT count(*) FROM f) * (SELECT count(*) FROM e) AS logical_capacity,
(SELECT count(*) FROM c) / ((SELECT count(*) FROM f) * (SELECT count(*) FROM e)) AS density""")
def a01_store_stats(s, d):
    return Q.store_stats(F_(s, d), E_(s, d), C_(s, d), load(s, d, "field_proposals").select("id").distinct())


@query(f"WITH {C} SELECT field_id, count(*) AS n_cells, max(updated_at) AS latest FROM c GROUP BY 1")
def a02_field_coverage(s, d):
    return Q.coverage(C_(s, d))


@query(f"WITH {FL} SELECT namespace, count(*) AS n_fields, max(updated_at) AS latest FROM f GROUP BY 1")
def a03_view_support(s, d):
    return F_(s, d).groupBy("namespace").agg(F.count("*").alias("n_fields"), F.max("updated_at").alias("latest"))


_CUR_CAND = "x AS (SELECT * FROM semantic_candidates QUALIFY row_number() OVER (PARTITION BY source_kind, source_ref, candidate_field_id ORDER BY created_at DESC) = 1)"


def _candidates(s: SparkSession, d: str) -> DataFrame:
    return latest(load(s, d, "semantic_candidates"), ["source_kind", "source_ref", "candidate_field_id"], ["created_at"], ["score"])


@query(f"WITH {_CUR_CAND}, y AS (SELECT source_ref AS field_id, candidate_field_id AS other, score FROM x UNION ALL SELECT candidate_field_id, source_ref, score FROM x) SELECT field_id, max(score) AS redundancy, count(DISTINCT other) AS n_others FROM y WHERE field_id <> other GROUP BY 1")
def a04_redundancy(s, d):
    return Q.redundancy(_candidates(s, d))


@query(f"WITH {E} SELECT kind, count(*) AS n FROM e GROUP BY 1")
def a05_kinds(s, d):
    return E_(s, d).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1")
def a06_value_histogram(s, d):
    _, c = exchange.melt(load(s, d, "part"), "part", "p_partkey", ["p_brand"], "p_name")
    return Q.histogram(c.withColumnRenamed("field_key", "field_id"), "p_brand")


@query("SELECT 'o_orderstatus' AS column_name, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2")
def a07_multi_histogram(s, d):
    return Q.histograms(load(s, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) * 2 + grouping(o_orderpriority) AS BIGINT) AS level, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def a07_cube(s, d):
    return load(s, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.grouping_id().alias("level"), F.count("*").alias("n")).select("o_orderstatus", "o_orderpriority", "level", "n")


@query(f"WITH {C} SELECT strftime(updated_at, '%Y-%m') AS month, source, count(*) AS n FROM c GROUP BY ALL")
def a08_cells_per_month(s, d):
    return C_(s, d).groupBy(F.date_format("updated_at", "yyyy-MM").alias("month"), "source").agg(F.count("*").alias("n"))


@query(f"WITH {C}, {E}, {FL} SELECT count(*) AS n FROM c JOIN e ON e.id = c.entity_id JOIN f ON f.id = c.field_id WHERE e.kind IN ('paper', 'canon') AND f.namespace = 'paper'")
def a09_scoped_cells(s, d):
    ids = F_(s, d).where("namespace = 'paper'").select(F.col("id").alias("field_id"))
    e = E_(s, d).where(F.col("kind").isin("paper", "canon")).select(F.col("id").alias("entity_id"))
    return lookup_join(C_(s, d), ids, "field_id", "left_semi", spread=F.col("entity_id")).join(e, "entity_id", "left_semi").agg(F.count("*").alias("n"))


@query("SELECT namespace, round(avg(CASE WHEN score >= 0.72 THEN 1.0 ELSE 0.0 END), 6) AS linked, round(avg(CASE WHEN score IS NULL THEN 1.0 ELSE 0.0 END), 6) AS unscored, count(*) AS n FROM semantic_candidates GROUP BY 1")
def a12_rates(s, d):
    g = load(s, d, "semantic_candidates").groupBy("namespace").agg(F.round(F.count_if(F.col("score") >= 0.72) / F.count("*"), 6).alias("linked"), F.round(F.count_if(F.col("score").isNull()) / F.count("*"), 6).alias("unscored"), F.count("*").alias("n"))
    return g


@query(f"WITH {C} SELECT field_id, count(*) AS n, min(CAST(value_json AS DOUBLE)) AS least, max(CAST(value_json AS DOUBLE)) AS greatest, round(avg(CASE WHEN abs(CAST(value_json AS DOUBLE)) < 1e15 THEN CAST(value_json AS DOUBLE) END), 3) AS mean FROM c WHERE regexp_full_match(trim(value_json, ' '), '-?(0|[1-9][0-9]*)(\\.[0-9]+)?([eE][+-]?[0-9]+)?') GROUP BY 1")
def a15_numeric_summary(s, d):
    # a mean's last digits depend on the order of adding
    return Q.numeric_summary(C_(s, d), 1e15).withColumn("mean", F.round("mean", 3))


@query("SELECT source, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY 1")
def a16_source_distribution(s, d):
    return load(s, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, count(CASE WHEN l_discount > 0.05 THEN 1 END) AS n_discounted, round(avg(l_quantity), 4) AS mean_quantity, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem GROUP BY ALL")
def a17_conditional_metrics(s, d):
    return load(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("n_discounted"), F.round(F.avg("l_quantity"), 4).alias("mean_quantity"), F.count_distinct("l_suppkey").alias("n_suppliers"))


@query("SELECT c_nationkey, count(*) AS n, count(DISTINCT o_custkey) AS n_buyers, sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) AS n_repeated FROM (SELECT c_nationkey, c_custkey, o_custkey, count(o_orderkey) AS k FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL) GROUP BY 1")
def a18_shared_targets(s, d):
    o = load(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("k"))
    j = load(s, d, "customer").select("c_custkey", "c_nationkey").join(o, "c_custkey", "left")
    return j.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.count("k").alias("n_buyers"), F.coalesce(F.sum((F.col("k") > 1).cast("int")), F.lit(0)).alias("n_repeated"))


@query(f"WITH {E} SELECT id, min(id) OVER (PARTITION BY lower(label)) AS identity_id, count(*) OVER (PARTITION BY lower(label)) AS n_forms FROM e WHERE label IS NOT NULL")
def a24_identity_groups(s, d):
    """Entities of one name get one identity; names aren't gathered, whatever their number of forms."""
    e = E_(s, d).where("label is not null").select("id", F.lower("label").alias("name"))
    g = e.groupBy("name").agg(F.min("id").alias("identity_id"), F.count("*").alias("n_forms"))
    return lookup_join(e, g, "name", spread=F.col("id")).select("id", "identity_id", "n_forms")


@query("SELECT l_orderkey, sum(l_quantity) AS total, sum(l_quantity) > 100 AS over_budget FROM lineitem GROUP BY 1")
def a23_budget_sums(s, d):
    return load(s, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("total")).withColumn("over_budget", F.col("total") > 100)


# ---- windows and order


@query("SELECT user_id, max(ts) AS ts, arg_max(event_id, struct_pack(t := ts, i := event_id)) AS event_id FROM events GROUP BY 1")
def w01_latest_per_key(s, d):
    return latest(load(s, d, "events"), ["user_id"], ["ts", "event_id"], [])


@query("SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS ordinal FROM events")
def w03_next_ordinal(s, d):
    ev = load(s, d, "events").select("user_id", "event_id", "ts")
    none = ev.limit(0).select("user_id", F.lit(0).alias("ordinal"))
    return store.next_ordinals(ev, none, "user_id", ["ts", "event_id"], "ordinal").select("user_id", "event_id", F.col("ordinal").cast("int").alias("ordinal"))


@query(f"WITH {_CUR_CAND} SELECT source_ref, candidate_field_id, score, CAST(row_number() OVER (PARTITION BY source_ref ORDER BY score DESC, source_kind, candidate_field_id) AS INTEGER) AS rank FROM x WHERE score IS NOT NULL QUALIFY rank <= 3")
def w06_top_k_per_source(s, d):
    return store.rank_within(_candidates(s, d).where("score is not null"), ["source_ref"], [F.desc("score"), F.col("source_kind"), F.col("candidate_field_id")], 3).select("source_ref", "candidate_field_id", "score", "rank")


@query(f"WITH {_CUR_CAND} SELECT source_kind, source_ref, candidate_field_id, score FROM x WHERE score IS NOT NULL ORDER BY score DESC, source_kind DESC, source_ref DESC, candidate_field_id DESC LIMIT 100")
def w07_global_top_k(s, d):
    return _candidates(s, d).where("score is not null").orderBy(F.desc("score"), F.desc("source_kind"), F.desc("source_ref"), F.desc("candidate_field_id")).limit(100).select("source_kind", "source_ref", "candidate_field_id", "score")


@query("SELECT run_id, intent, min(ordinal) AS first_ordinal FROM field_agent_actions GROUP BY ALL")
def w08_first_occurrence(s, d):
    return load(s, d, "field_agent_actions").groupBy("run_id", "intent").agg(F.min("ordinal").alias("first_ordinal"))


@query("WITH x AS (SELECT DISTINCT run_id, ordinal FROM field_agent_actions), y AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ordinal) AS n FROM x) SELECT run_id, ordinal FROM y WHERE ordinal <> n")
def w09_ordinal_gaps(s, d):
    x = load(s, d, "field_agent_actions").select("run_id", "ordinal").distinct()
    return x.withColumn("n", F.row_number().over(Window.partitionBy("run_id").orderBy("ordinal"))).where("ordinal <> n").drop("n")


@query("SELECT l_suppkey AS id, count(*) AS degree FROM lineitem GROUP BY 1 ORDER BY degree DESC, id LIMIT 20")
def w12_top_degree(s, d):
    return refgraph.top_degree(load(s, d, "lineitem"), "l_suppkey", 20)


@query()
def w14_greedy_fill(s, d):
    li = load(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return assess.greedy_fill(li, "l_orderkey", ["l_quantity", "l_linenumber"], "l_quantity", 60, 3)


@query("SELECT user_id, event_id, CASE WHEN ts + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) THEN 'expired' ELSE 'active' END AS state FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def w16_leases(s, d):
    ev = load(s, d, "events")
    now = ev.agg(F.max("ts")).first()[0]
    last = latest(ev, ["user_id"], ["ts", "event_id"], [])
    return last.select("user_id", "event_id", F.when(F.col("ts") + F.expr("interval 1 day") <= F.lit(now), "expired").otherwise("active").alias("state"))


# ---- catalogue and time


@query("SELECT doc_id, source, lang FROM documents WHERE contains(lower(text), 'snapshot') AND lang IN ('en', 'de') AND source <> 'field_primer'")
def c02_catalog_search(s, d):
    docs = load(s, d, "documents")
    return docs.where(F.contains(F.lower("text"), F.lit("snapshot")) & F.col("lang").isin("en", "de") & (F.col("source") != "field_primer")).select("doc_id", "source", "lang")


_ANCHORS = "a AS (SELECT user_id AS anchor_id, min(ts) AS t_at FROM events GROUP BY 1), t AS (SELECT user_id AS anchor_id, ts AS t_at, event_type = 'purchase' AS ok FROM events)"


def _anchor_tables(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ev = load(s, d, "events")
    a = ev.groupBy(F.col("user_id").alias("anchor_id")).agg(F.min("ts").alias("instant")).withColumn("status", F.lit("pending"))
    return a, ev.select(F.col("user_id").alias("anchor_id"), F.col("ts").alias("at"), F.col("ts").alias("instant"), (F.col("event_type") == "purchase").alias("succeeded"))


@query(f"WITH {_ANCHORS} SELECT anchor_id FROM a WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.anchor_id = a.anchor_id AND ok)")
def t02_pending_anchors(s, d):
    return anchors.pending(*_anchor_tables(s, d)).select("anchor_id")


@query(f"WITH {_ANCHORS} SELECT a.anchor_id, coalesce(x.t_at, a.t_at) AS instant, CASE WHEN x.t_at IS NULL THEN 'pending' ELSE 'registered' END AS status FROM a LEFT JOIN (SELECT anchor_id, max(t_at) AS t_at FROM t WHERE ok GROUP BY 1) x ON x.anchor_id = a.anchor_id")
def t03_effective_anchors(s, d):
    return anchors.effective(*_anchor_tables(s, d)).select("anchor_id", "instant", "status")


@query("SELECT o_orderkey, round(epoch_us(TIMESTAMP '2000-01-01') / 86400000000.0 - epoch_us(o_orderdate) / 86400000000.0, 6) AS age_days, o_orderdate > TIMESTAMP '1995-01-01' AS after FROM orders")
def t06_age_days(s, d):
    o = load(s, d, "orders")
    return o.select("o_orderkey", F.round(S.age_days(F.col("o_orderdate"), F.lit("2000-01-01").cast("timestamp_ntz")), 6).alias("age_days"), S.strictly_after(F.col("o_orderdate"), F.lit("1995-01-01").cast("timestamp_ntz")).alias("after"))


@query(r"""SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, replace(replace(p_type, '~', '~0'), '/', '~1') AS pointer,
least(greatest(p_retailprice, 950.0), 1500.0) AS clamped, substring(sha256(p_name || chr(31) || p_brand), 1, 16) AS digest, lower(regexp_extract('x.' || p_brand, '\.([^./\\]+)$', 1)) AS extension FROM part""")
def f_part_scalars(s, d):
    p = load(s, d, "part")
    return p.select("p_partkey", S.slug(F.col("p_name")).alias("slug"), S.pointer_escape(F.col("p_type")).alias("pointer"), S.clamp(F.col("p_retailprice"), 950.0, 1500.0).alias("clamped"), S.digest_id(16, F.col("p_name"), F.col("p_brand")).alias("digest"), S.extension(F.concat(F.lit("x."), F.col("p_brand"))).alias("extension"))


@query(f"WITH {FL} SELECT id, trim(regexp_replace(regexp_replace(lower(trim(key)), '[\\s\\-./]+', '_', 'g'), '_+', '_', 'g'), '_') AS norm FROM f WHERE regexp_full_match(key, '[\\x20-\\x7e]*')")
def f01_ascii_keys(s, d):
    f = F_(s, d).where(F.col("key").rlike(r"^[\x20-\x7e]*$"))
    return f.select("id", S.ascii_key(F.col("key")).alias("norm"))


@query()
def f01_field_keys(s, d):
    return F_(s, d).select("id", S.field_key("key").alias("norm"))


@query()
def f02_canonical_digests(s, d):
    return load(s, d, "field_events").select("id", S.json_sha(F.col("evidence_json")).alias("digest")).distinct()


@query()
def f08_value_kinds(s, d):
    return C_(s, d).groupBy(S.json_kind(F.col("value_json")).alias("kind")).agg(F.count("*").alias("n"))
