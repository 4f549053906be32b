"""Further rows of the operator inventory as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomcell.functions import scalars as S
from loomcell.operators import assess, snapshot, store
from loomcell.plans.reads import C_, E_, F_, _candidates, _CUR_CAND
from loomcell.plans.registry import C, E, FL, query
from loomcell.runtime import latest, load, lookup_join, spread_previous


@query(f"WITH {FL} SELECT namespace, string_agg(key, ',' ORDER BY key) AS keys FROM f WHERE namespace NOT LIKE 'lab_%' GROUP BY 1")
def p02_view_fields(s, d):
    f = F_(s, d).where(~F.col("namespace").startswith("lab_"))
    return f.groupBy("namespace").agg(F.array_join(F.array_sort(F.collect_list("key")), ",").alias("keys"))


@query("SELECT DISTINCT id, outcome FROM field_agent_actions WHERE lower(intent) = 'score_proposal'")
def p09_table_lookup(s, d):
    return load(s, d, "field_agent_actions").where(F.lower("intent") == "score_proposal").select("id", "outcome").distinct()


@query(f"WITH {E}, {C}, {FL} SELECT e.id, max(CASE WHEN f.key = 'record_title' THEN c.value_json END) AS title, count(c.field_id) AS n_cells FROM e LEFT JOIN c ON c.entity_id = e.id LEFT JOIN f ON f.id = c.field_id GROUP BY 1")
def p10_record_summaries(s, d):
    named = store.named_cells(C_(s, d), F_(s, d)).groupBy(F.col("entity_id").alias("id")).agg(F.max(F.when(F.col("field_key") == "record_title", F.col("value_json"))).alias("title"), F.count("*").alias("n"))
    return E_(s, d).select("id").join(named, "id", "left").select("id", "title", F.coalesce("n", F.lit(0)).alias("n_cells"))


@query(f"WITH {C} SELECT source, count(*) AS n, count(CASE WHEN trim(value_json) IN ('null', '\"\"', '[]', '{{}}', '') THEN 1 END) AS n_blank FROM c GROUP BY 1")
def p11_blank_values(s, d):
    blank = F.trim("value_json").isin("null", '""', "[]", "{}", "")
    return C_(s, d).groupBy("source").agg(F.count("*").alias("n"), F.count_if(blank).alias("n_blank"))


@query("SELECT run_id, intent, arg_min(outcome, struct_pack(o := ordinal, i := id)) AS outcome FROM field_agent_actions GROUP BY ALL")
def j19_first_action(s, d):
    a = load(s, d, "field_agent_actions")
    return a.groupBy("run_id", "intent").agg(F.min(F.struct("ordinal", "id", "outcome")).alias("m")).select("run_id", "intent", "m.outcome")


@query(f"WITH {E} SELECT kind, count(*) AS n_entities, count(x.n) AS n_with_documents, coalesce(sum(x.n), 0) AS n_documents FROM e LEFT JOIN (SELECT entity_id, count(*) AS n FROM documents GROUP BY 1) x ON x.entity_id = e.id GROUP BY 1")
def j20_documents_per_kind(s, d):
    n = load(s, d, "documents").where("entity_id is not null").groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("n"))
    return E_(s, d).join(n, "id", "left").groupBy("kind").agg(F.count("*").alias("n_entities"), F.count("n").alias("n_with_documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_documents"))


@query("""SELECT l_orderkey, l_linenumber, coalesce(p_brand, 'none') AS brand, coalesce(s_name, 'none') AS supplier FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size > 10 LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 0""")
def j24_aligned_defaults(s, d):
    p = load(s, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    u = load(s, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    j = lookup_join(load(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), p, "l_partkey", "left", spread=F.col("l_orderkey"), salted=False)
    j = lookup_join(j, u, "l_suppkey", "left", spread=F.col("l_orderkey"), salted=False)
    return j.select("l_orderkey", "l_linenumber", F.coalesce("p_brand", F.lit("none")).alias("brand"), F.coalesce("s_name", F.lit("none")).alias("supplier"))


@query("SELECT intent, count(DISTINCT run_id) AS n_runs, count(DISTINCT outcome) AS n_outcomes, string_agg(DISTINCT capability_decision, ',' ORDER BY capability_decision) AS decisions FROM field_agent_actions GROUP BY 1")
def a11_distinct_sets(s, d):
    return load(s, d, "field_agent_actions").groupBy("intent").agg(F.count_distinct("run_id").alias("n_runs"), F.count_distinct("outcome").alias("n_outcomes"), F.array_join(F.array_sort(F.collect_set("capability_decision")), ",").alias("decisions"))


@query(f"WITH {_CUR_CAND}, y AS (SELECT source_ref AS member, score FROM x WHERE source_kind = 'field' UNION ALL SELECT candidate_field_id, score FROM x WHERE source_kind = 'field') SELECT member, min(score) AS min_score, round(CAST(sum(CAST(score AS DECIMAL(18, 6))) AS DOUBLE) / count(*), 6) AS avg_score, count(*) AS n_peers FROM y WHERE score IS NOT NULL GROUP BY 1")
def a13_peer_scores(s, d):
    c = _candidates(s, d).where("source_kind = 'field' and score is not null")
    both = c.select(F.col("source_ref").alias("member"), "score").unionByName(c.select(F.col("candidate_field_id").alias("member"), "score"))
    return both.groupBy("member").agg(F.min("score").alias("min_score"), F.round(F.sum(F.col("score").cast("decimal(18,6)")).cast("double") / F.count("*"), 6).alias("avg_score"), F.count("*").alias("n_peers"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def a19_rollup(s, d):
    return load(s, d, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, count(*) AS n_options, count(*) - count(DISTINCT l_partkey) AS n_repeated, count(DISTINCT l_suppkey) = 1 AS converges FROM lineitem GROUP BY 1")
def a20_choice_metrics(s, d):
    return load(s, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_options"), (F.count("*") - F.count_distinct("l_partkey")).alias("n_repeated"), (F.count_distinct("l_suppkey") == 1).alias("converges"))


@query(f"WITH {FL}, w AS (SELECT * FROM (VALUES ('paper', 40), ('canon', 40), ('global', 1), ('gone', 3)) t(namespace, expected)) SELECT coalesce(g.namespace, w.namespace) AS namespace, coalesce(g.n, 0) AS n, w.expected, coalesce(g.n, 0) = coalesce(w.expected, -1) AS ok FROM (SELECT namespace, count(*) AS n FROM f GROUP BY 1) g FULL JOIN w ON w.namespace = g.namespace")
def a21_counts_against_contract(s, d):
    w = s.createDataFrame([("paper", 40), ("canon", 40), ("global", 1), ("gone", 3)], "namespace string, expected int")
    g = F_(s, d).groupBy("namespace").agg(F.count("*").alias("n")).join(w, "namespace", "full_outer")
    return g.select("namespace", F.coalesce("n", F.lit(0)).alias("n"), "expected", (F.coalesce("n", F.lit(0)) == F.coalesce("expected", F.lit(-1))).alias("ok"))


@query()
def a22_registry_digest(s, d):
    return snapshot.fingerprint(F_(s, d), ["id", "key", "value_type", "status", "normalized_key"])


@query("SELECT user_id, event_id, lag(event_type) OVER w AS previous, CAST(row_number() OVER w - 1 AS INTEGER) AS nth FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def w04_previous_event(s, d):
    e = load(s, d, "events").select("user_id", "event_id", "ts", "event_type")
    return spread_previous(e, "user_id", ["ts", "event_id"], "event_type").select("user_id", "event_id", F.col("prev").alias("previous"), "nth")


@query("SELECT run_id, max(ordinal) AS ordinal FROM field_agent_actions GROUP BY 1")
def w10_stream_heads(s, d):
    return snapshot.chain_head(load(s, d, "field_agent_actions"), "run_id", "ordinal", "outcome").select("run_id", "ordinal")


@query("SELECT field_id, arg_max(event_type, struct_pack(c := created_at, i := id)) AS event_type FROM field_events GROUP BY 1")
def w11_latest_event(s, d):
    return latest(load(s, d, "field_events"), ["field_id"], ["created_at", "id"], ["event_type"]).select("field_id", "event_type")


@query("SELECT entity_id, CASE WHEN k = 1 THEN 'left' WHEN k = 2 THEN 'right' ELSE 'both' END AS side FROM (SELECT entity_id, max(k1) + max(k2) AS k FROM (SELECT entity_id, 1 AS k1, 0 AS k2 FROM snapshot_records UNION ALL SELECT entity_id, 0, 2 FROM store_records) GROUP BY 1)")
def x05_set_sides(s, d):
    u = load(s, d, "snapshot_records").select("entity_id", F.lit(1).alias("k")).unionByName(load(s, d, "store_records").select("entity_id", F.lit(2).alias("k")))
    g = u.groupBy("entity_id").agg(F.max((F.col("k") == 1).cast("int")).alias("a"), F.max((F.col("k") == 2).cast("int")).alias("b"))
    return g.select("entity_id", F.when(F.col("b") == 0, "left").when(F.col("a") == 0, "right").otherwise("both").alias("side"))


@query("SELECT key, string_agg(DISTINCT w, ' ' ORDER BY w) AS words FROM (SELECT key, unnest(string_split(label_en, ' ')) AS w FROM c4b) GROUP BY 1")
def x06_token_sets(s, d):
    t = load(s, d, "c4b").select("key", F.split("label_en", " ").alias("t"))
    return t.groupBy("key").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("t")))), " ").alias("words"))


@query("SELECT id, count(DISTINCT namespace) AS n_namespaces FROM (SELECT id, namespace FROM fields UNION ALL SELECT field_id, namespace FROM field_aliases) GROUP BY 1 HAVING count(*) > 1")
def x08_composed_ids(s, d):
    u = load(s, d, "fields").select("id", "namespace").unionByName(load(s, d, "field_aliases").select(F.col("field_id").alias("id"), "namespace"))
    return u.groupBy("id").agg(F.count_distinct("namespace").alias("n_namespaces"), F.count("*").alias("n")).where("n > 1").drop("n")


@query("WITH t AS (SELECT DISTINCT source FROM mix_targets), l AS (SELECT unnest(['en', 'zh', 'de', 'fr', 'pt', 'ru', 'xx']) AS lang) SELECT t.source, l.lang FROM t, l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.source = t.source AND d.lang = l.lang)")
def x09_missing_pairs(s, d):
    t = load(s, d, "mix_targets").select("source").distinct().withColumn("lang", F.explode(F.array(*map(F.lit, ["en", "zh", "de", "fr", "pt", "ru", "xx"]))))
    return t.join(load(s, d, "documents").select("source", "lang").distinct(), ["source", "lang"], "left_anti")


@query(f"WITH {_CUR_CAND} SELECT least(source_ref, candidate_field_id) AS left_id, greatest(source_ref, candidate_field_id) AS right_id, max(score) AS score FROM x WHERE source_kind = 'field' AND source_ref <> candidate_field_id GROUP BY ALL")
def e07_related_pairs(s, d):
    c = _candidates(s, d).where("source_kind = 'field' and source_ref <> candidate_field_id")
    return c.groupBy(F.least("source_ref", "candidate_field_id").alias("left_id"), F.greatest("source_ref", "candidate_field_id").alias("right_id")).agg(F.max("score").alias("score"))


@query("SELECT DISTINCT id, key IS NOT NULL AND trim(key) <> '' AND value_type IN ('text', 'integer', 'number', 'boolean', 'array', 'object', 'json') AS valid FROM field_proposals")
def e13_packet_validation(s, d):
    ok = F.col("key").isNotNull() & (F.trim("key") != "") & F.col("value_type").isin("text", "integer", "number", "boolean", "array", "object", "json")
    return load(s, d, "field_proposals").select("id", ok.alias("valid")).distinct()


@query("SELECT capability_decision, outcome, count(DISTINCT id) AS n FROM field_agent_actions GROUP BY ALL")
def d08_outcome_counts(s, d):
    return load(s, d, "field_agent_actions").groupBy("capability_decision", "outcome").agg(F.count_distinct("id").alias("n"))


@query(f"WITH {_CUR_CAND} SELECT source_ref AS id, CASE WHEN score IS NULL THEN 'DEFER' WHEN score >= 0.9 THEN 'ESCALATE' WHEN source_ref = candidate_field_id THEN 'DEFER' ELSE 'EXECUTE' END AS decision, count(*) AS n FROM x GROUP BY ALL")
def d02_rule_table(s, d):
    rules = [(F.col("score").isNull(), "DEFER"), (F.col("score") >= 0.9, "ESCALATE"), (F.col("source_ref") == F.col("candidate_field_id"), "DEFER")]
    return assess.first_match(_candidates(s, d), "decision", rules, "EXECUTE").groupBy(F.col("source_ref").alias("id"), "decision").agg(F.count("*").alias("n"))


@query("SELECT source_ref AS id, 'out' AS direction, count(DISTINCT id) AS n FROM semantic_candidates GROUP BY 1 UNION ALL SELECT candidate_field_id, 'in', count(DISTINCT id) FROM semantic_candidates GROUP BY 1")
def g07_edge_listing(s, d):
    c = load(s, d, "semantic_candidates")
    out = c.groupBy(F.col("source_ref").alias("id")).agg(F.count_distinct(F.col("id")).alias("n")).withColumn("direction", F.lit("out"))
    into = c.groupBy(F.col("candidate_field_id").alias("id")).agg(F.count_distinct(F.col("id")).alias("n")).withColumn("direction", F.lit("in"))
    return out.unionByName(into).select("id", "direction", "n")


@query("SELECT event_id, ts + INTERVAL 8 HOUR AS local_time FROM events")
def t04_zone_conversion(s, d):
    return load(s, d, "events").select("event_id", S.in_zone(F.col("ts").cast("timestamp"), "+08:00").cast("timestamp_ntz").alias("local_time"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS instant FROM events")
def t05_canonical_instants(s, d):
    return load(s, d, "events").select("event_id", S.canonical_instant(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))).alias("instant"))


@query("SELECT doc_id, sha256(text) AS digest, count(*) OVER (PARTITION BY sha256(text)) AS n_same FROM documents WHERE text IS NOT NULL")
def v02_content_addresses(s, d):
    a = load(s, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"))
    return lookup_join(a, a.groupBy("digest").agg(F.count("*").alias("n_same")), "digest", spread=F.col("doc_id")).select("doc_id", "digest", "n_same")


@query(f"WITH {C} SELECT field_id, count(*) AS n, count(DISTINCT value_json) AS n_values FROM c GROUP BY 1")
def xa_distinct_values(s, d):
    return C_(s, d).groupBy("field_id").agg(F.count("*").alias("n"), F.count_distinct("value_json").alias("n_values"))


@query("SELECT c_custkey, rank, o_orderkey FROM (SELECT o_custkey AS c_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank, o_orderkey FROM orders) WHERE rank <= 2")
def w06_top_orders(s, d):
    o = load(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return store.rank_within(o, ["c_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 2).select("c_custkey", "rank", "o_orderkey")



