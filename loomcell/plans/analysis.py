"""Similarity, assessment, snapshot plans, reference graphs, verification, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcell.operators import assess, difference, refgraph, similarity, snapshot, store, verify
from loomcell.plans.reads import C_, F_, _candidates, _CUR_CAND
from loomcell.plans.registry import C, FL, query
from loomcell.runtime import latest, load, shared_dir
from loomcell.sources import exchange
from loomcell.streaming import changes

_STOP = "['" + "','".join(similarity.STOPWORDS) + "']"
_TOKS = f"list_sort(list_distinct(list_filter(regexp_extract_all(regexp_replace(lower({{0}}), '[_\\-/.]', ' ', 'g'), '([a-z0-9]+)', 1), lambda x: NOT list_contains({_STOP}, x))))"


# ---- similarity


@query(f"SELECT p_partkey, array_to_string({_TOKS.format('p_name')}, ' ') AS tokens FROM part")
def e02_name_tokens(s, d):
    return load(s, d, "part").select("p_partkey", F.array_join(similarity.ascii_tokens(F.col("p_name")), " ").alias("tokens"))


@query("WITH n AS (SELECT p_partkey, row_number() OVER (ORDER BY p_name, p_partkey) AS rn FROM part) SELECT a.p_partkey AS source, b.p_partkey AS candidate FROM n a JOIN n b ON a.rn <> b.rn AND b.rn BETWEEN a.rn - 3 AND a.rn + 3")
def w05_neighbour_pairs(s, d):
    return similarity.neighbour_pairs(load(s, d, "part").select("p_partkey", "p_name"), "p_partkey", ["p_name", "p_partkey"], 3)


_FT = f"t AS (SELECT id, unnest({_TOKS.format('key')}) AS tok FROM f)"


@query(f"WITH {FL}, {_FT}, r AS (SELECT tok FROM t GROUP BY 1 HAVING count(*) BETWEEN 2 AND 8) SELECT DISTINCT a.id AS source, b.id AS candidate FROM t a JOIN t b ON a.tok = b.tok AND a.id <> b.id WHERE a.tok IN (SELECT tok FROM r)")
def e06_rare_token_pairs(s, d):
    f = F_(s, d).select("id", similarity.ascii_tokens(F.col("key")).alias("toks"))
    return similarity.rare_token_pairs(f, "id", "toks", 8)


@query(f"""WITH {FL}, {_FT}, r AS (SELECT tok FROM t GROUP BY 1 HAVING count(*) BETWEEN 2 AND 8), n AS (SELECT id, row_number() OVER (ORDER BY key, id) AS rn FROM f),
p AS (SELECT a.id AS x, b.id AS y FROM t a JOIN t b ON a.tok = b.tok AND a.id < b.id WHERE a.tok IN (SELECT tok FROM r) UNION SELECT least(a.id, b.id), greatest(a.id, b.id) FROM n a JOIN n b ON b.rn > a.rn AND b.rn <= a.rn + 4)
SELECT x AS left_id, y AS right_id FROM p""")
def e06_block_pairs(s, d):
    f = F_(s, d).select("id", "key", similarity.ascii_tokens(F.col("key")).alias("toks"))
    both = similarity.neighbour_pairs(f, "id", ["key", "id"], 4).unionByName(similarity.rare_token_pairs(f, "id", "toks", 8))
    return both.select(F.least("source", "candidate").alias("left_id"), F.greatest("source", "candidate").alias("right_id")).distinct()


@query(f"""WITH {FL}, k AS (SELECT id, {_TOKS.format('key')} AS toks FROM f), {_CUR_CAND}
SELECT DISTINCT source_ref, candidate_field_id, CASE WHEN len(a.toks) + len(b.toks) = 0 THEN 1.0 ELSE round(len(list_intersect(a.toks, b.toks)) / len(list_distinct(list_concat(a.toks, b.toks))), 6) END AS jaccard
FROM x JOIN k a ON a.id = source_ref JOIN k b ON b.id = candidate_field_id""")
def e01_token_score(s, d):
    k = F_(s, d).select("id", similarity.ascii_tokens(F.col("key")).alias("toks"))
    c = _candidates(s, d).select("source_ref", "candidate_field_id").distinct()
    j = c.join(k.select(F.col("id").alias("source_ref"), F.col("toks").alias("a")), "source_ref").join(k.select(F.col("id").alias("candidate_field_id"), F.col("toks").alias("b")), "candidate_field_id")
    return j.select("source_ref", "candidate_field_id", F.round(similarity.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


@query()
def e01_pair_score(s, d):
    c = _candidates(s, d).where("source_kind = 'field' and source_ref <> candidate_field_id").select(F.least("source_ref", "candidate_field_id").alias("left_id"), F.greatest("source_ref", "candidate_field_id").alias("right_id")).distinct()
    return similarity.score_pairs(c, F_(s, d))


@query()
def e06_scan(s, d):
    return similarity.scan(F_(s, d))


@query()
def e05_score_proposal(s, d):
    p = latest(load(s, d, "field_proposals").where("id is not null"), ["id"], ["created_at"], ["key", "label", "description", "value_type", "namespace"])
    return similarity.score_proposals(F_(s, d), p, 20)


@query()
def e09_families(s, d):
    f = F_(s, d)
    return similarity.families(f, similarity.scan(f))


@query(f"WITH {_CUR_CAND} SELECT namespace, min(score) AS min_score, count(CASE WHEN score < 0.72 THEN 1 END) AS n_conflicts, count(*) AS n_pairs, round(CAST(sum(CAST(score AS DECIMAL(18, 6))) AS DOUBLE) / count(*), 6) AS avg_score FROM x WHERE score IS NOT NULL GROUP BY 1")
def a10_pair_metrics(s, d):
    c = latest(load(s, d, "semantic_candidates"), ["source_kind", "source_ref", "candidate_field_id"], ["created_at"], ["namespace", "score"]).where("score is not null")
    return similarity.pair_metrics(c, "namespace", 0.72).withColumn("avg_score", F.round("avg_score", 6))


# ---- assessment


_SIG = "sg AS (SELECT user_id % 50 AS key, CAST(event_id % 20 AS INTEGER) AS run_id, user_id % 3 AS backend, user_id % 5 AS root, 1 AS basis, CASE WHEN user_id % 50 < 3 THEN event_type ELSE 'text' END AS value_type, event_id AS ordinal FROM events QUALIFY row_number() OVER (PARTITION BY user_id % 50, event_id % 20 ORDER BY event_id) = 1)"


@query(f"""WITH {_SIG}, g AS (SELECT key, count(*) AS raw_support, count(DISTINCT (backend, root)) AS independent_support, count(DISTINCT backend) AS n_backends, count(DISTINCT root) AS n_roots, count(DISTINCT value_type) AS n_types FROM sg GROUP BY 1)
SELECT key, raw_support, independent_support, n_backends, n_roots, n_types, CASE WHEN n_types > 1 THEN 'incompatible' WHEN raw_support >= 2 AND independent_support <= 1 THEN 'insufficient_independence' WHEN key % 7 = 3 THEN 'disputed'
WHEN independent_support >= 2 AND n_backends >= 2 AND n_roots >= 2 THEN 'strong_agreement' WHEN independent_support >= 2 THEN 'weak_agreement' ELSE 'insufficient_independence' END AS status FROM g""")
def e15_consensus(s, d):
    ev = load(s, d, "events")
    sig = ev.select((F.col("user_id") % 50).alias("key"), (F.col("event_id") % 20).alias("run_id"), (F.col("user_id") % 3).alias("backend"), (F.col("user_id") % 5).alias("root"), F.lit(1).alias("basis"), F.when(F.col("user_id") % 50 < 3, F.col("event_type")).otherwise("text").alias("value_type"), F.col("event_id").alias("ordinal"))
    bad = sig.select("key").distinct().where("key % 7 = 3").withColumn("n_conflicts", F.lit(1))
    return assess.consensus(sig, bad)


@query("""WITH x AS (SELECT DISTINCT id, run_id, ordinal, intent FROM field_agent_actions), y AS (SELECT run_id, ordinal, id, intent, row_number() OVER (PARTITION BY run_id, intent ORDER BY ordinal, id) AS nth FROM x),
z AS (SELECT *, sum(CASE WHEN nth = 1 AND intent NOT IN ('observe') THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY ordinal, id ROWS UNBOUNDED PRECEDING) AS made FROM y)
SELECT id, CASE WHEN nth > 1 THEN 'skipped_duplicate' WHEN intent = 'observe' THEN 'skipped_represented' WHEN made > 2 THEN 'budget_exhausted' ELSE 'created' END AS outcome FROM z""")
def e14_outcomes(s, d):
    x = load(s, d, "field_agent_actions").select("id", "run_id", "ordinal", "intent").distinct()
    known = s.createDataFrame([("observe",)], "key string")
    sug = x.select("run_id", F.struct("ordinal", "id").alias("ordinal"), F.col("intent").alias("key"))
    return assess.outcomes(sug, known, known.limit(0), 2).select("ordinal.id", "outcome")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'DEFER' WHEN o_totalprice > 300000 THEN 'ESCALATE' WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 100000 THEN 'ESCALATE' ELSE 'EXECUTE' END AS decision FROM orders")
def d02_decisions(s, d):
    o = load(s, d, "orders")
    rules = [(F.col("o_orderstatus") == "P", "DEFER"), (F.col("o_totalprice") > 300000, "ESCALATE"), ((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 100000), "ESCALATE")]
    return assess.first_match(o, "decision", rules, "EXECUTE").select("o_orderkey", "decision")


# ---- snapshot plans


_AB = """a AS (SELECT * FROM snapshot_records QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY observed_at DESC) = 1),
b AS (SELECT * FROM store_records QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY observed_at DESC) = 1)"""


def _two_copies(s: SparkSession, d: str):
    """The source's and the store's records as entities and cells, one per member of
    their values, each in canonical spelling."""
    def side(t: str) -> DataFrame:
        return latest(load(s, d, t), ["entity_id"], ["observed_at"], ["kind", "label", "values_json"]).withColumnRenamed("entity_id", "id")

    def cells(df: DataFrame) -> DataFrame:
        return difference.unpivoted(df.where("values_json is not null").select(F.col("id").alias("entity_id"), "values_json"), "entity_id", "values_json").withColumn("source", F.lit("sync"))

    a, b = side("snapshot_records"), side("store_records")
    return a, b, cells(a), cells(b)


# Members of a side's values as rows; numbers by value, strings as they are written.
_MEMBERS = """ca AS (SELECT entity_id, k, json_extract(values_json, '$."' || k || '"') AS v FROM (SELECT entity_id, values_json, unnest(json_keys(values_json)) AS k FROM a)),
cb AS (SELECT entity_id, k, json_extract(values_json, '$."' || k || '"') AS v FROM (SELECT entity_id, values_json, unnest(json_keys(values_json)) AS k FROM b)),
na AS (SELECT entity_id, k, CASE WHEN json_type(v) IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT') THEN CAST(CAST(CAST(v AS VARCHAR) AS DECIMAL(38, 12)) AS VARCHAR) WHEN json_type(v) = 'VARCHAR' THEN 's' || (v ->> '$') ELSE CAST(v AS VARCHAR) END AS v FROM ca),
nb AS (SELECT entity_id, k, CASE WHEN json_type(v) IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT') THEN CAST(CAST(CAST(v AS VARCHAR) AS DECIMAL(38, 12)) AS VARCHAR) WHEN json_type(v) = 'VARCHAR' THEN 's' || (v ->> '$') ELSE CAST(v AS VARCHAR) END AS v FROM cb),
cc AS (SELECT coalesce(na.entity_id, nb.entity_id) AS entity_id, count(CASE WHEN nb.k IS NULL THEN 1 END) AS n_add, count(CASE WHEN na.k IS NULL OR na.v <> nb.v THEN 1 END) AS n_bad FROM na FULL JOIN nb ON na.entity_id = nb.entity_id AND na.k = nb.k GROUP BY 1)"""


@query(f"""WITH {_AB}, {_MEMBERS} SELECT coalesce(a.entity_id, b.entity_id) AS entity_id, CASE WHEN b.entity_id IS NULL THEN 'new' WHEN a.entity_id IS NULL THEN 'missing'
WHEN a.kind IS DISTINCT FROM b.kind OR a.label IS DISTINCT FROM b.label OR coalesce(n_bad, 0) > 0 THEN 'conflict' WHEN coalesce(n_add, 0) > 0 THEN 'enrich' ELSE 'unchanged' END AS state,
coalesce(n_add, 0) AS n_add, coalesce(n_bad, 0) AS n_bad FROM a FULL JOIN b ON a.entity_id = b.entity_id LEFT JOIN cc ON cc.entity_id = coalesce(a.entity_id, b.entity_id)""")
def m01_entity_plan(s, d):
    return snapshot.entity_plan(*_two_copies(s, d))


@query(f"WITH {_AB}, {_MEMBERS} SELECT na.entity_id, na.k AS field_key, nb.k IS NULL AS added FROM na LEFT JOIN nb ON na.entity_id = nb.entity_id AND na.k = nb.k WHERE nb.k IS NULL OR na.v <> nb.v")
def m07_changed_cells(s, d):
    _, _, a, b = _two_copies(s, d)
    return snapshot.changed_cells(a, b).select("entity_id", "field_key", "added")


@query(f"""WITH {_AB} SELECT coalesce(a.entity_id, b.entity_id) AS entity_id, coalesce(a.kind, b.kind) AS kind, CASE WHEN b.entity_id IS NULL THEN 'new' WHEN a.entity_id IS NULL THEN 'missing' WHEN a.kind IS DISTINCT FROM b.kind THEN 'reassigned' WHEN a.label IS DISTINCT FROM b.label THEN 'changed' ELSE 'unchanged' END AS state
FROM a FULL JOIN b ON a.entity_id = b.entity_id""")
def m03_partition_plan(s, d):
    a, b, _, _ = _two_copies(s, d)
    return snapshot.partition_plan(a.withColumnRenamed("id", "entity_id"), b.withColumnRenamed("id", "entity_id"), "entity_id", "kind", "label")


@query("""WITH seen AS (SELECT coalesce(lang, 'none') || '/' || doc_id AS path, sha256(CASE WHEN source = 'canon_notes' THEN text || '!' ELSE text END) AS sha FROM documents WHERE source <> 'repo_briefs'), known AS (SELECT CASE WHEN lang = 'de' THEN 'old' ELSE coalesce(lang, 'none') END || '/' || doc_id AS path, sha256(text) AS sha FROM documents WHERE source <> 'ledger_notes'),
j AS (SELECT coalesce(s.path, k.path) AS path, s.sha AS s1, k.sha AS s2 FROM seen s FULL JOIN known k ON s.path = k.path), g AS (SELECT s2 AS s, count(*) AS n, min(path) AS was FROM j WHERE s1 IS NULL GROUP BY 1), w AS (SELECT s1 AS s, count(*) AS n FROM j WHERE s2 IS NULL GROUP BY 1), p AS (SELECT g.s, g.was FROM g JOIN w ON g.s = w.s WHERE g.n = 1 AND w.n = 1)
SELECT path, CASE WHEN s1 IS NULL THEN CASE WHEN was IS NOT NULL THEN 'moved_away' ELSE 'missing' END WHEN s2 IS NULL THEN CASE WHEN was IS NOT NULL THEN 'moved' ELSE 'first_seen' END WHEN s1 = s2 THEN 'unchanged' ELSE 'content_changed' END AS state, CASE WHEN s2 IS NULL THEN was END AS was_path FROM j LEFT JOIN p ON p.s = coalesce(s1, s2)""")
def m04_file_plan(s, d):
    """Two listings of the documents: folders by language, some renamed, changed, new or gone."""
    docs, i, lang = load(s, d, "documents"), F.col("doc_id").cast("string"), F.coalesce("lang", F.lit("none"))
    seen = docs.where("source <> 'repo_briefs'").select(F.concat(lang, F.lit("/"), i).alias("path"), F.sha2(F.when(F.col("source") == "canon_notes", F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha"))
    known = docs.where("source <> 'ledger_notes'").select(F.concat(F.when(F.col("lang") == "de", "old").otherwise(lang), F.lit("/"), i).alias("path"), F.sha2("text", 256).alias("sha"))
    return snapshot.file_plan(seen, known)


@query("SELECT sha256(string_agg(n_nationkey || '|' || n_name, chr(10) ORDER BY n_nationkey)) AS digest FROM nation")
def m05_ordered_digest(s, d):
    n = load(s, d, "nation")
    return snapshot.ordered_digest(n, ["n_nationkey"], F.concat_ws("|", F.col("n_nationkey").cast("string"), "n_name"))


@query()
def m05_fingerprint(s, d):
    return snapshot.fingerprint(load(s, d, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"])


@query()
def m06_contract(s, d):
    want = load(s, d, "field_proposals").groupBy("key").agg(F.min("value_type").alias("value_type"))
    return snapshot.contract(F_(s, d), want)


@query("WITH a AS (SELECT DISTINCT entity_id FROM snapshot_records), b AS (SELECT DISTINCT entity_id FROM store_records) SELECT entity_id, 'left' AS side FROM a WHERE entity_id NOT IN (SELECT entity_id FROM b) UNION ALL SELECT entity_id, 'right' FROM b WHERE entity_id NOT IN (SELECT entity_id FROM a)")
def x02_set_difference(s, d):
    return snapshot.set_difference(load(s, d, "snapshot_records"), load(s, d, "store_records"), ["entity_id"])


@query()
def x04_merge_maps(s, d):
    def maps(t: str) -> DataFrame:
        cur = latest(load(s, d, t), ["entity_id"], ["observed_at"], ["values_json"])
        return cur.select("entity_id", F.from_json("values_json", "map<string,string>").alias("m"))
    return snapshot.merge_maps(maps("snapshot_records"), maps("store_records"), "entity_id").select("entity_id", F.to_json("merged").alias("merged"), "conflicts")


# ---- reference graphs


_RULES = [("lineitem", "l_orderkey", "orders"), ("lineitem", "l_partkey", "part"), ("lineitem", "l_suppkey", "supplier"), ("customer", "c_nationkey", "nation")]


@query("""WITH e AS (SELECT 'lineitem' AS t, 'l_orderkey' AS f, 'orders' AS g, CAST(l_orderkey AS VARCHAR) AS v, o_orderkey IS NOT NULL AS ok FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus <> 'P' UNION ALL SELECT 'lineitem', 'l_partkey', 'part', CAST(l_partkey AS VARCHAR), true FROM lineitem
UNION ALL SELECT 'lineitem', 'l_suppkey', 'supplier', CAST(l_suppkey AS VARCHAR), true FROM lineitem UNION ALL SELECT 'customer', 'c_nationkey', 'nation', CAST(c_nationkey AS VARCHAR), true FROM customer)
SELECT t || '.' || f || '->' || g || ':' || CASE WHEN ok THEN 'resolved' ELSE 'missing_target' END AS edge_type, count(*) AS n FROM e GROUP BY 1""")
def a14_edge_counts(s, d):
    return refgraph.edge_counts(_edges(s, d))


def _edges(s: SparkSession, d: str) -> DataFrame:
    li, cu = load(s, d, "lineitem"), load(s, d, "customer")
    r1 = li.select(F.lit("lineitem").alias("source_table"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("source_id"), F.create_map(*[x for c in ("l_orderkey", "l_partkey", "l_suppkey") for x in (F.lit(c), F.col(c).cast("string"))]).alias("payload"))
    r2 = cu.select(F.lit("customer").alias("source_table"), F.col("c_custkey").cast("string").alias("source_id"), F.create_map(F.lit("c_nationkey"), F.col("c_nationkey").cast("string")).alias("payload"))
    t = [load(s, d, n).select(F.lit(n).alias("table_name"), F.col(k).cast("string").alias("record_id")) for n, k in (("part", "p_partkey"), ("supplier", "s_suppkey"), ("nation", "n_nationkey"))]
    t.append(load(s, d, "orders").where("o_orderstatus <> 'P'").select(F.lit("orders").alias("table_name"), F.col("o_orderkey").cast("string").alias("record_id")))
    targets = t[0].unionByName(t[1]).unionByName(t[2]).unionByName(t[3])
    return refgraph.edges(r1.unionByName(r2), _RULES, targets)


@query("SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS source_id, CAST(l_orderkey AS VARCHAR) AS target_id FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'P')")
def g01_missing_targets(s, d):
    return _edges(s, d).where("status = 'missing_target'").select("source_id", "target_id")


_LINKS = "li AS (SELECT DISTINCT source_ref AS src, candidate_field_id AS dst FROM semantic_candidates WHERE source_kind = 'field' AND score >= 0.6)"


def _links(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "semantic_candidates").where("source_kind = 'field' and score >= 0.6").select(F.col("source_ref").alias("src"), F.col("candidate_field_id").alias("dst")).distinct()


@query(f"""WITH {FL}, {_LINKS}, o AS (SELECT src, count(*) AS n FROM li GROUP BY 1), i AS (SELECT dst, count(*) AS n FROM li GROUP BY 1)
SELECT f.id, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree, CASE WHEN i.n IS NULL AND o.n IS NULL THEN 'isolated' WHEN i.n IS NULL THEN 'root' WHEN o.n IS NULL THEN 'terminal' ELSE 'inner' END AS class FROM f LEFT JOIN o ON o.src = f.id LEFT JOIN i ON i.dst = f.id""")
def g03_graph_roots(s, d):
    return refgraph.degrees(F_(s, d).select("id"), _links(s, d))


@query()
def g03_strong_components(s, d):
    return refgraph.strong_components(_links(s, d))


_TREE = "tr AS (SELECT 'r' || r_regionkey AS src, 'n' || n_nationkey AS dst FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)"


@query(f"WITH RECURSIVE {_TREE}, w AS (SELECT 'r' || r_regionkey AS start, 'r' || r_regionkey AS node, 0 AS distance FROM region UNION ALL SELECT w.start, tr.dst, w.distance + 1 FROM w JOIN tr ON tr.src = w.node) SELECT start, node, distance FROM w WHERE distance > 0")
def g04_closure(s, d):
    r, n, c, o = (load(s, d, t) for t in ("region", "nation", "customer", "orders"))
    pre = lambda p, col: F.concat(F.lit(p), F.col(col).cast("string"))
    links = n.select(pre("r", "n_regionkey").alias("src"), pre("n", "n_nationkey").alias("dst")).unionByName(c.select(pre("n", "c_nationkey").alias("src"), pre("c", "c_custkey").alias("dst"))).unionByName(o.select(pre("c", "o_custkey").alias("src"), pre("o", "o_orderkey").alias("dst")))
    return refgraph.closure(links, r.select(pre("r", "r_regionkey").alias("id")))


@query("SELECT 'c' || c_custkey AS id, 'direct' AS via FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'o' || o_orderkey, 'stored_link' FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'")
def g08_linked_search(s, d):
    c, o = load(s, d, "customer"), load(s, d, "orders")
    direct = c.where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"))
    links = o.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("dst"))
    return refgraph.linked_search(direct, links)


# ---- verification


@query(f"WITH {C}, {FL} SELECT entity_id, sha256(string_agg(f.key || '=' || value_json, chr(10) ORDER BY f.key || '=' || value_json)) AS digest, count(*) AS n_cells FROM c JOIN f ON f.id = c.field_id GROUP BY 1")
def v01_entity_digest(s, d):
    return verify.entity_digests(store.named_cells(C_(s, d), F_(s, d)))


def _few_cells(s: SparkSession, d: str) -> DataFrame:
    return exchange.melt(load(s, d, "nation"), "nation", "n_nationkey", ["n_name", "n_regionkey"], "n_name")[1]


@query()
def v05_merkle_roots(s, d):
    return verify.merkle_roots(_few_cells(s, d))


@query()
def v06_proofs(s, d):
    c = _few_cells(s, d)
    wanted = c.select("entity_id").distinct().select("entity_id", F.explode(F.array(F.lit("n_name"), F.lit("no_such_field"))).alias("field_key"))
    return verify.proofs(c, wanted).select("entity_id", "field_key", "payload", "root", "valid")


@query("SELECT doc_id AS file_id, CAST(greatest(1, ceil(octet_length(encode(text)) / 64.0)) AS BIGINT) AS n_chunks FROM documents")
def v11_chunk_counts(s, d):
    f = load(s, d, "documents").select(F.col("doc_id").alias("file_id"), F.encode("text", "utf-8").alias("content"))
    return verify.chunks(f, 64).groupBy("file_id").agg(F.count("*").alias("n_chunks"))


@query()
def v11_range_roots(s, d):
    f = load(s, d, "documents").select(F.col("doc_id").alias("file_id"), F.encode("text", "utf-8").alias("content"))
    return verify.range_roots(verify.chunks(f, 64))


@query("SELECT doc_id AS file_id, CAST(u.chunk AS BIGINT) AS chunk, NOT (doc_id % 5 = 0 AND u.chunk = 1) AS valid FROM documents, LATERAL (SELECT unnest(generate_series(0, 2)) AS chunk) u WHERE u.chunk < greatest(1, ceil(octet_length(encode(text)) / 64.0))")
def v12_verified_chunks(s, d):
    """The first chunks of all documents against their proofs; a fifth have one bit turned."""
    f = load(s, d, "documents").select(F.col("doc_id").alias("file_id"), F.encode("text", "utf-8").alias("content"))
    tree = verify.range_tree(verify.chunks(f, 64))
    n = F.greatest(F.lit(1), F.ceil(F.length("content") / 64))
    got = f.select("file_id", "content", F.explode(F.sequence(F.lit(0), F.least(F.lit(2), n - 1))).alias("chunk")).select("file_id", "chunk", F.substring("content", (F.col("chunk") * 64 + 1).cast("int"), F.lit(64)).alias("bytes"))
    turned = F.concat(F.unhex(F.lit("FF")), F.expr("substring(bytes, 2, 63)"))
    got = got.withColumn("bytes", F.when((F.col("file_id") % 5 == 0) & (F.col("chunk") == 1), turned).otherwise(F.col("bytes")))
    return verify.verify_chunks(got, verify.chunk_proofs(tree, got))


@query("SELECT doc_id AS file_id, CAST(u.chunk AS INTEGER) AS chunk FROM documents, LATERAL (SELECT unnest(generate_series(1, 3)) AS chunk) u WHERE u.chunk < greatest(1, ceil(octet_length(encode(text)) / 64.0))")
def v13_covering_chunks(s, d):
    f = load(s, d, "documents").select(F.col("doc_id").alias("file_id"), F.encode("text", "utf-8").alias("content"))
    req = f.select("file_id", F.lit(100).alias("first_byte"), F.lit(150).alias("n_bytes"))
    return verify.covering(verify.chunks(f, 64), req, 64).select("file_id", "chunk")


@query("SELECT s_suppkey FROM supplier WHERE s_acctbal > 1000 AND s_nationkey IN (1, 2, 3, 4) QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY CASE WHEN s_nationkey = 2 THEN 0 ELSE 1 END, s_suppkey) = 1")
def w13_first_placement(s, d):
    p = load(s, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("digest"), (F.col("s_acctbal") > 1000).alias("enabled"), F.col("s_nationkey").cast("string").alias("provider_id"), F.lit("hot").alias("tier"), F.lit(1).alias("size_bytes"), F.col("s_nationkey").cast("string").alias("region"), F.lit(0).alias("priority"), F.col("s_suppkey").alias("placement_id"))
    return verify.rank_placements(p, "2", ["1", "2", "3", "4"], ["hot"], 10).where("rank = 1").select("s_suppkey")


# ---- streams


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def xs_windowed_counts(s, d):
    """Tumbling counts of the events read as a stream, to the end of the input."""
    ev = s.readStream.schema(load(s, d, "events").schema).parquet(f"{d}/events.parquet*")
    ev = ev.withColumn("ts", F.col("ts").cast("timestamp"))
    out = f"{shared_dir(s)}/stream-{abs(hash(d)) % 10**9}"
    from loomcell.runtime import remove
    remove(s, out)
    q = changes.windowed_counts(ev, "ts", "event_type").writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/data/batch={n}")).outputMode("complete").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    r = s.read.parquet(f"{out}/data")
    last = r.agg(F.max("batch")).first()[0]
    return r.where(F.col("batch") == last).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), y AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM x) SELECT user_id, min(ts) AS started, count(*) AS n_events FROM y GROUP BY user_id, n")
def xs_sessions(s, d):
    ev = load(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return changes.sessions(ev, "ts", "user_id").select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), "n_events")
