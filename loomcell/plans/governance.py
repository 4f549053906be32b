"""Utility, reviews, decisions, reconciliations and further reads, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcell.functions import scalars as S
from loomcell.operators import assess, difference, review, similarity, snapshot, store, utility
from loomcell.plans.reads import _CUR_CAND, C_, E_, F_, _candidates
from loomcell.plans.registry import C, E, FL, query
from loomcell.runtime import latest, load, lookup_join

# ---- utility: aliases stand for task views, an event's reason for a guardrail

_EV = """g AS (SELECT field_id, arg_max(id, id) AS gid, arg_max(evaluator LIKE 'system%', id) AS protected FROM field_events WHERE field_id IS NOT NULL GROUP BY 1),
ev AS (SELECT field_id, count(*) AS n, max(updated_at) AS t FROM c GROUP BY 1), vw AS (SELECT field_id, count(DISTINCT id) AS n, max(created_at) AS t FROM field_aliases GROUP BY 1),
rd AS (SELECT k, max(score) AS r FROM (SELECT source_ref AS k, score FROM semantic_candidates WHERE source_kind = 'field' AND status = 'pending' UNION ALL SELECT candidate_field_id, score FROM semantic_candidates WHERE source_kind = 'field' AND status = 'pending') GROUP BY 1),
cv AS (SELECT field_id, arg_max(created_at, id) AS t FROM field_events WHERE event_type = 'converged' GROUP BY 1),
e1 AS (SELECT f.id AS field_id, f.key, f.status, f.created_at, f.updated_at, coalesce(ev.n, 0) AS n_cells, ev.t AS cell_t, coalesce(vw.n, 0) AS n_views, vw.t AS view_t, coalesce(rd.r, 0.0) AS red, g.gid, coalesce(g.protected, false) AS protected, cv.t AS conv,
(SELECT count(*) FROM e) AS n_e, date_diff('microsecond', f.created_at, TIMESTAMP '2026-07-01') / 86400000000.0 AS age FROM f LEFT JOIN ev ON ev.field_id = f.id LEFT JOIN vw ON vw.field_id = f.id LEFT JOIN rd ON rd.k = f.id LEFT JOIN g ON g.field_id = f.id LEFT JOIN cv ON cv.field_id = f.id),
e2 AS (SELECT *, coalesce(cell_t > conv, false) AS cell_after, coalesce(view_t > conv, false) AS view_after, round(greatest(0.0, age), 6) AS age_days, round(least(1.0, greatest(0.0, 0.45 * (n_cells / n_e) + 0.40 * CASE WHEN n_views > 0 THEN 1.0 ELSE 0.0 END + 0.15 * (1 - red))), 6) AS score FROM e1),
u AS (SELECT *, CASE WHEN status NOT IN ('active', 'converged') THEN 'keep' WHEN status = 'converged' THEN CASE WHEN cell_after OR view_after THEN 'reactivate_candidate' ELSE 'keep' END WHEN protected THEN 'keep' WHEN n_e = 0 THEN 'insufficient_evidence'
WHEN n_cells = 0 AND n_views = 0 AND age_days < 7 THEN 'insufficient_evidence' WHEN n_cells = 0 AND n_views = 0 AND score <= 0.15 THEN 'converge_candidate' WHEN score < 0.35 THEN 'review' ELSE 'keep' END AS recommendation FROM e2)"""
_U = f"WITH {FL}, {E}, {C}, {_EV}"
_ROW = "field_id, status, n_cells, round(n_cells / n_e, 6) AS coverage, n_views, round(red, 6) AS redundancy, age_days, protected, cell_after, view_after, score, recommendation"


def _as_of() -> Column:
    return F.lit("2026-07-01").cast("timestamp_ntz")


def _guards(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "field_events").select("id", "field_id", F.coalesce(F.col("evaluator").startswith("system"), F.lit(False)).alias("protected"))


def _evidence(s: SparkSession, d: str, cells: DataFrame | None = None) -> DataFrame:
    views = load(s, d, "field_aliases").select(F.col("id").cast("string").alias("view_id"), "field_id", "created_at")
    return utility.evidence(F_(s, d), C_(s, d) if cells is None else cells, views, load(s, d, "semantic_candidates"), _guards(s, d), load(s, d, "field_events"))


@query(f"{_U} SELECT {_ROW} FROM u")
def u01_utility(s, d):
    return utility.assess(_evidence(s, d), E_(s, d).count(), _as_of())


@query(f"{_U} SELECT field_id, n_cells, cell_t AS latest_cell_at, n_views, view_t AS latest_view_at, red AS redundancy, gid AS guardrail_id, protected, conv AS latest_converged_at FROM u WHERE key = 'record_title'")
def u02_field_evidence(s, d):
    """Of one field: every pass is filtered by its id before it is aggregated."""
    ids = [r["id"] for r in F_(s, d).where("key = 'record_title'").select("id").collect()]  # a key names one field
    f, own = F_(s, d).where(F.col("id").isin(ids)), F.col("field_id").isin(ids)
    views = load(s, d, "field_aliases").where(own).select(F.col("id").cast("string").alias("view_id"), "field_id", "created_at")
    cand = load(s, d, "semantic_candidates").where(F.col("source_ref").isin(ids) | F.col("candidate_field_id").isin(ids))
    e = utility.evidence(f, store.cells(load(s, d, "cells").where(own)), views, cand, _guards(s, d).where(own), load(s, d, "field_events").where(own))
    return e.select("field_id", "n_cells", "latest_cell_at", "n_views", "latest_view_at", "redundancy", "guardrail_id", "protected", "latest_converged_at")


@query(f"{_U} SELECT status, recommendation, count(*) AS n, min(score) AS least, max(score) AS greatest FROM u GROUP BY ALL")
def u03_registry_advice(s, d):
    u = utility.assess(_evidence(s, d), E_(s, d).count(), _as_of())
    return u.groupBy("status", "recommendation").agg(F.count("*").alias("n"), F.min("score").alias("least"), F.max("score").alias("greatest"))


@query(f"{_U} SELECT {_ROW} FROM u WHERE status IN ('active', 'converged') ORDER BY key, field_id LIMIT 1000 OFFSET 20")
def u04_registry_page(s, d):
    page = store.page(F_(s, d).where(F.col("status").isin("active", "converged")).select("id", "key"), ["key", "id"], 1000, 20)
    u = utility.assess(_evidence(s, d), E_(s, d).count(), _as_of())
    return u.join(page.select(F.col("id").alias("field_id")), "field_id", "left_semi")


@query(f"""{_U}, old AS (SELECT field_id, count(*) AS n, max(updated_at) AS t FROM c WHERE updated_at < TIMESTAMP '2026-01-01' GROUP BY 1), st AS (SELECT u.*, coalesce(old.n, 0) <> n_cells OR old.t IS DISTINCT FROM cell_t AS stale FROM u LEFT JOIN old ON old.field_id = u.field_id),
mv AS (SELECT *, CASE WHEN status = 'active' AND recommendation = 'converge_candidate' THEN 'converged' WHEN status = 'converged' AND recommendation = 'reactivate_candidate' THEN 'active' END AS target FROM st)
SELECT field_id, status, recommendation, CASE WHEN target IS NULL THEN 'not_actionable' WHEN stale THEN 'stale' ELSE 'applied' END AS outcome, CASE WHEN target IS NOT NULL AND NOT stale THEN target ELSE status END AS new_status FROM mv""")
def u05_apply(s, d):
    """Assessments of today whose basis was taken before the year's cells came in."""
    n, now = E_(s, d).count(), _evidence(s, d)
    then = _evidence(s, d, C_(s, d).where("updated_at < timestamp_ntz'2026-01-01'"))
    return utility.apply(utility.assess(now, n, _as_of()), utility.basis(then, n), utility.basis(now, n))


@query("SELECT field_id, max(id) AS guardrail_id, arg_max(coalesce(evaluator LIKE 'system%', false), id) AS protected, count(DISTINCT id) AS n_changes FROM field_events WHERE field_id IS NOT NULL GROUP BY 1")
def u06_guardrails(s, d):
    return utility.guardrails(_guards(s, d))


# ---- candidates and families under review

_PAIRS = "least(source_ref, candidate_field_id) AS left_id, greatest(source_ref, candidate_field_id) AS right_id"


@query(f"WITH p AS (SELECT {_PAIRS}, score, status FROM semantic_candidates WHERE source_kind = 'field' AND source_ref <> candidate_field_id) SELECT left_id, right_id, max(score) AS score FROM p WHERE status = 'pending' AND (left_id, right_id) NOT IN (SELECT (left_id, right_id) FROM p WHERE status = 'reviewed') GROUP BY ALL")
def x03_fresh_pairs(s, d):
    c = load(s, d, "semantic_candidates").where("source_kind = 'field'").select(F.col("source_ref").alias("left_id"), F.col("candidate_field_id").alias("right_id"), "score", "status")
    return review.fresh_pairs(c.where("status = 'pending'"), c.where("status = 'reviewed'"))


_REVIEWS = "rv AS (SELECT DISTINCT id, TRY_CAST(regexp_extract(evidence_json, '([0-9]+)', 1) AS BIGINT) AS candidate_id, CASE WHEN outcome = 'CREATED_PROPOSAL' THEN 'alias' WHEN outcome = 'OBSERVED' THEN 'related' WHEN outcome = 'ERROR' THEN 'ignore' ELSE 'distinct' END AS decision FROM field_agent_actions)"


def _reviews(s: SparkSession, d: str) -> DataFrame:
    """Actions as reviews of the candidate whose number their evidence gives."""
    o = F.col("outcome")
    decision = F.when(o == "CREATED_PROPOSAL", "alias").when(o == "OBSERVED", "related").when(o == "ERROR", "ignore").otherwise("distinct")
    return load(s, d, "field_agent_actions").select("id", F.regexp_extract("evidence_json", "([0-9]+)", 1).try_cast("bigint").alias("candidate_id"), decision.alias("decision")).distinct()


@query(f"WITH {_REVIEWS}, r AS (SELECT candidate_id, arg_min(decision, id) AS decision, count(DISTINCT id) - 1 AS n_refused FROM rv WHERE candidate_id IS NOT NULL GROUP BY 1) SELECT c.id, coalesce(r.decision, 'pending') AS decision, coalesce(n_refused, 0) AS n_refused, CASE r.decision WHEN 'alias' THEN 'alias_of' WHEN 'related' THEN 'related_to' END AS relation FROM (SELECT DISTINCT id FROM semantic_candidates) c LEFT JOIN r ON r.candidate_id = c.id")
def e07_review_once(s, d):
    return review.review_once(load(s, d, "semantic_candidates"), _reviews(s, d))


@query(f"WITH {_REVIEWS}, x AS (SELECT DISTINCT id, source_ref, candidate_field_id FROM semantic_candidates), m AS (SELECT id, source_ref AS member FROM x UNION SELECT id, candidate_field_id FROM x) SELECT member, count(*) AS n_candidates, count(CASE WHEN EXISTS (SELECT 1 FROM rv WHERE rv.candidate_id = m.id) THEN 1 END) AS n_reviewed FROM m GROUP BY 1")
def j06_reviewed_members(s, d):
    """Candidates of a field on either side, with and without review."""
    x = load(s, d, "semantic_candidates").select("id", "source_ref", "candidate_field_id").distinct()
    m = x.select("id", F.explode(F.array_distinct(F.array("source_ref", "candidate_field_id"))).alias("member"))
    r = _reviews(s, d).where("candidate_id is not null").select(F.col("candidate_id").alias("id")).distinct().withColumn("done", F.lit(1))
    return m.join(r, "id", "left").groupBy("member").agg(F.count("*").alias("n_candidates"), F.count("done").alias("n_reviewed"))


# Families: the fields that one field was scored near to.
_FAM = "fm AS (SELECT DISTINCT source_ref AS family_id, candidate_field_id AS field_id FROM semantic_candidates WHERE source_kind = 'field' AND score >= 0.72 UNION SELECT source_ref, source_ref FROM semantic_candidates WHERE source_kind = 'field' AND score >= 0.72)"


def _families(s: SparkSession, d: str) -> DataFrame:
    c = load(s, d, "semantic_candidates").where("source_kind = 'field' and score >= 0.72")
    return c.select(F.col("source_ref").alias("family_id"), F.explode(F.array("source_ref", "candidate_field_id")).alias("field_id")).distinct()


_BASIS = "sha256(string_agg(fm.field_id || '|' || coalesce(x.key, '') || '|' || coalesce(x.status, '') || '|' || coalesce(strftime(x.updated_at, '%Y-%m-%dT%H:%M:%S.%f'), ''), chr(10) ORDER BY fm.field_id))"


@query(f"WITH {FL}, {_FAM} SELECT family_id, count(*) AS n_members, {_BASIS} AS basis FROM fm LEFT JOIN f x ON x.id = fm.field_id GROUP BY 1")
def e10_family_basis(s, d):
    return review.family_basis(_families(s, d), F_(s, d).select("id", "key", "status", "updated_at"))


@query(f"WITH {FL}, o AS (SELECT * FROM fields QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at) = 1), {_FAM} SELECT fm.family_id, bool_or(f.updated_at IS DISTINCT FROM o.updated_at OR f.status IS DISTINCT FROM o.status) AS stale FROM fm LEFT JOIN f ON f.id = fm.field_id LEFT JOIN o ON o.id = fm.field_id GROUP BY 1")
def e10_stale_families(s, d):
    """Families proposed on the first state of the registry against the current one."""
    old = load(s, d, "fields").groupBy("id").agg(F.min(F.struct("updated_at", "key", "status")).alias("r")).select("id", "r.key", "r.status", "r.updated_at")
    m = _families(s, d)
    return review.stale(review.family_basis(m, old), review.family_basis(m, F_(s, d).select("id", "key", "status", "updated_at")))


@query(f"WITH {_FAM} SELECT field_id, count(DISTINCT family_id) AS n_families, min(family_id) AS first_family FROM fm GROUP BY 1 HAVING count(DISTINCT family_id) > 1")
def j11_family_overlap(s, d):
    return review.overlaps(_families(s, d))


@query(f"WITH {FL}, {_FAM} SELECT fm.family_id, string_agg(x.key, ',' ORDER BY x.key, x.id) AS keys, count(DISTINCT x.namespace) AS n_namespaces FROM fm JOIN f x ON x.id = fm.field_id GROUP BY 1")
def j10_family_members(s, d):
    j = lookup_join(_families(s, d), F_(s, d).select(F.col("id").alias("field_id"), "key", "namespace"), "field_id", spread=F.col("family_id"))
    g = j.groupBy("family_id").agg(F.array_sort(F.collect_list(F.struct("key", "field_id"))).alias("m"), F.count_distinct("namespace").alias("n_namespaces"))  # a family has few members
    return g.select("family_id", F.array_join(F.transform("m", lambda x: x["key"]), ",").alias("keys"), "n_namespaces")


_PARTS = "pw AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS i FROM lineitem), pp AS (SELECT DISTINCT l_orderkey AS k, l_linenumber % 2 AS part, CASE WHEN l_linenumber = 7 THEN l_partkey + 1000000 ELSE l_partkey END AS i FROM lineitem WHERE l_linenumber <> 6)"


@query(f"WITH {_PARTS}, n AS (SELECT k, i, count(DISTINCT part) AS n FROM pp GROUP BY ALL), j AS (SELECT coalesce(pw.k, n.k) AS k, pw.k IS NULL AS foreign_, n.k IS NULL AS missing, coalesce(n.n, 0) > 1 AS doubled FROM pw FULL JOIN n ON pw.k = n.k AND pw.i = n.i) SELECT k, count(CASE WHEN missing THEN 1 END) AS n_missing, count(CASE WHEN foreign_ THEN 1 END) AS n_foreign, count(CASE WHEN doubled THEN 1 END) AS n_doubled, NOT bool_or(missing OR foreign_ OR doubled) AS exact FROM j GROUP BY 1")
def x07_exact_partition(s, d):
    li = load(s, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("i"), F.col("l_linenumber").alias("n"))
    parts = li.where("n <> 6").select("k", (F.col("n") % 2).alias("part"), F.when(F.col("n") == 7, F.col("i") + 1_000_000).otherwise(F.col("i")).alias("i"))
    return review.partition_check(li.select("k", "i"), parts, "k", "i")


# ---- campaigns: backends and roots of a run follow from its id

_LINKS = "lk AS (SELECT DISTINCT run_id, substring(run_id, 1, 1) AS backend, substring(run_id, 2, 1) AS root, 'b' AS basis FROM field_agent_actions)"


def _links(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "field_agent_actions").select("run_id", F.lit("c").alias("campaign_id"), F.substring("run_id", 1, 1).alias("backend"), F.substring("run_id", 2, 1).alias("root"), F.lit("b").alias("basis")).distinct()


_ACT = "a AS (SELECT DISTINCT id, run_id, ordinal, intent, outcome FROM field_agent_actions)"


@query(f"WITH {_ACT}, {_LINKS} SELECT lk.backend, a.intent, a.outcome, count(*) AS n, count(DISTINCT a.run_id) AS n_runs FROM a JOIN lk ON lk.run_id = a.run_id GROUP BY ALL")
def j09_campaign_actions(s, d):
    a = load(s, d, "field_agent_actions").select("id", "run_id", "intent", "outcome").distinct()
    return lookup_join(a, _links(s, d), "run_id", spread=F.col("id")).groupBy("backend", "intent", "outcome").agg(F.count("*").alias("n"), F.count_distinct("run_id").alias("n_runs"))


@query(f"WITH {_ACT}, {_LINKS}, sg AS (SELECT id % 20 AS key, run_id, ordinal, CASE WHEN id % 20 < 3 THEN outcome ELSE 'text' END AS value_type FROM a WHERE intent <> 'observe' QUALIFY row_number() OVER (PARTITION BY run_id, id % 20 ORDER BY ordinal, id) = 1) SELECT key, count(*) AS raw_support, count(DISTINCT (backend, root)) AS independent_support, count(DISTINCT backend) AS n_backends, count(DISTINCT root) AS n_roots, count(DISTINCT value_type) AS n_types, CASE WHEN count(DISTINCT value_type) > 1 THEN 'incompatible' WHEN count(*) >= 2 AND count(DISTINCT (backend, root)) <= 1 THEN 'insufficient_independence' WHEN count(DISTINCT (backend, root)) >= 2 AND count(DISTINCT backend) >= 2 AND count(DISTINCT root) >= 2 THEN 'strong_agreement' WHEN count(DISTINCT (backend, root)) >= 2 THEN 'weak_agreement' ELSE 'insufficient_independence' END AS status FROM sg JOIN lk ON lk.run_id = sg.run_id GROUP BY 1")
def e15_linked_consensus(s, d):
    a = load(s, d, "field_agent_actions").where("intent <> 'observe'").select("id", "run_id", "ordinal", "outcome").distinct()
    sig = a.select((F.col("id") % 20).alias("key"), "run_id", F.struct("ordinal", "id").alias("ordinal"), F.when(F.col("id") % 20 < 3, F.col("outcome")).otherwise("text").alias("value_type"))
    sig = lookup_join(sig, _links(s, d), "run_id", spread=F.col("ordinal"))
    return assess.consensus(sig, sig.limit(0).select("key", F.lit(1).alias("n_conflicts")))


@query()
def e15_proposal_consensus(s, d):
    """Proposals of one key as signals of their proposers: pairs of members below the
    floor are conflicts."""
    p = latest(load(s, d, "field_proposals").where("id is not null"), ["id"], ["created_at"], ["key", "label", "description", "value_type", "namespace", "proposed_by"])
    p = p.withColumn("norm", S.field_key("key")).where("norm is not null")
    sig = p.select(F.concat_ws(":", "namespace", "norm").alias("key"), F.col("id").alias("run_id"), F.coalesce("proposed_by", F.lit("")).alias("backend"), F.substring("id", 1, 2).alias("root"), F.lit(1).alias("basis"), "value_type", F.lit(1).alias("ordinal"))
    # members of one key repeat few texts: those are compared, not the members
    text = p.select(F.concat_ws(":", "namespace", "norm").alias("group"), "namespace", "key", "label", "value_type", "description").distinct().withColumn("id", F.sha2(F.concat_ws("\x1f", "group", "key", F.coalesce("label", F.lit("")), "value_type", F.coalesce("description", F.lit(""))), 256))
    a, b = text.select("group", F.col("id").alias("left_id")), text.select("group", F.col("id").alias("right_id"))
    pairs = a.join(b, "group").where("left_id < right_id").select("left_id", "right_id")
    low = similarity.score_pairs(pairs, text).where("score < 0.72").select(F.col("left_id").alias("id")).join(text, "id").groupBy(F.col("group").alias("key")).agg(F.count("*").alias("n_conflicts"))
    return assess.consensus(sig, low)


# ---- decisions: orders as actions

_ENVELOPE = {"allow_external": False, "allow_shared_world": False, "allow_irreversible": False, "authority_domains": ["field_registry", "task_view"], "resource_owners": ["self"], "max_cost_units": 4}


def _actions(s: SparkSession, d: str) -> DataFrame:
    o, p = load(s, d, "orders"), F.col("o_orderpriority")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return o.select(F.col("o_orderkey").alias("id"), F.when(cents % 11 == 0, "disputed").when(cents % 13 == 0, "basis_incompatible").when(cents % 17 == 0, "incompatible").otherwise("strong_agreement").alias("consensus"), (p == "1-URGENT").alias("external"), (p == "2-HIGH").alias("shared_world"),
                    F.when(F.col("o_orderstatus") == "P", "outside").otherwise("field_registry").alias("authority_domain"), F.when(cents % 7 == 0, "other").otherwise("self").alias("resource_owner"), F.when(p == "5-LOW", None).otherwise(cents % 5 == 0).alias("irreversible"), (cents % 6).cast("int").alias("cost_units"))


@query("""WITH x AS (SELECT o_orderkey AS id, CAST(round(o_totalprice * 100) AS BIGINT) AS c, o_orderpriority AS p, o_orderstatus AS st FROM orders),
y AS (SELECT id, c, p, (c % 11 = 0 OR (c % 13 <> 0 AND c % 17 = 0)) AS conflict, (c % 11 <> 0 AND c % 13 = 0) AS other, p = '5-LOW' AS missing, concat_ws(',', CASE WHEN p = '1-URGENT' THEN 'external_effect_not_delegated' END, CASE WHEN p = '2-HIGH' THEN 'shared_world_effect_not_delegated' END, CASE WHEN st = 'P' THEN 'authority_domain_not_delegated' END,
CASE WHEN c % 7 = 0 THEN 'resource_owner_not_delegated' END, CASE WHEN c % 5 = 0 THEN 'irreversible_effect_not_delegated' END) AS bounds, c % 6 > 4 AS dear FROM x)
SELECT id, CASE WHEN conflict THEN 'ESCALATE' WHEN other OR missing THEN 'DEFER' WHEN bounds <> '' THEN 'ESCALATE' WHEN dear THEN 'DEFER' ELSE 'EXECUTE' END AS decision,
CASE WHEN conflict THEN 'consensus_conflict' WHEN other THEN 'consensus_basis_incompatible' WHEN missing THEN 'effect_classification_incomplete' WHEN bounds <> '' OR dear THEN concat_ws(',', nullif(bounds, ''), CASE WHEN dear THEN 'cost_exceeds_envelope' END) ELSE 'inside_autonomy_envelope' END AS reasons FROM y""")
def d02_precedence(s, d):
    return review.decide(_actions(s, d), _ENVELOPE)


@query()
def d07_store_fingerprints(s, d):
    """One digest for each table of the store, whatever the order of its rows."""
    out = None
    for t in ("entities", "fields", "cells", "field_events", "field_proposals"):
        df = load(s, d, t)
        one = snapshot.fingerprint(df, df.columns).withColumn("table_name", F.lit(t))
        out = one if out is None else out.unionByName(one)
    return out


# ---- plans by record, and their application


_AB = """a AS (SELECT * FROM snapshot_records QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY observed_at DESC) = 1),
b AS (SELECT * FROM store_records QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY observed_at DESC) = 1)"""


def _sides(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return tuple(latest(load(s, d, t).where("entity_id is not null"), ["entity_id"], ["observed_at"], ["kind", "label", "values_json"]) for t in ("snapshot_records", "store_records"))


@query()
def m02_record_plan(s, d):
    """A record as a whole: new, unchanged, conflict (with the number of differing
    fields), missing in the source."""
    diff = difference.differences(load(s, d, "snapshot_records"), load(s, d, "store_records"), "entity_id", "observed_at", ["kind", "label"], "values_json", "new", "missing")
    g = diff.groupBy("entity_id").agg(F.max("side").alias("side"), F.count_if(F.col("field_name") != "").alias("n_fields"))
    a, b = _sides(s, d)
    every = a.select("entity_id").union(b.select("entity_id")).distinct()
    side = F.coalesce(F.when(F.col("side") == "both", "conflict").otherwise(F.col("side")), F.lit("unchanged"))
    return every.join(g, "entity_id", "left").select("entity_id", side.alias("state"), F.coalesce("n_fields", F.lit(0)).alias("n_fields"))


@query(f"WITH {_AB} SELECT coalesce(a.kind, b.kind) AS kind, count(CASE WHEN b.entity_id IS NULL THEN 1 END) AS n_new, count(CASE WHEN a.entity_id IS NULL THEN 1 END) AS n_missing, count(CASE WHEN a.kind <> b.kind THEN 1 END) AS n_moved, count(*) AS n FROM a FULL JOIN b ON a.entity_id = b.entity_id GROUP BY 1")
def k19_plan_summary(s, d):
    a, b = _sides(s, d)
    j = a.select("entity_id", F.col("kind").alias("k1"), F.lit(1).alias("i1")).join(b.select("entity_id", F.col("kind").alias("k2"), F.lit(1).alias("i2")), "entity_id", "full_outer")
    return j.groupBy(F.coalesce("k1", "k2").alias("kind")).agg(F.count_if(F.col("i2").isNull()).alias("n_new"), F.count_if(F.col("i1").isNull()).alias("n_missing"), F.count_if(F.col("k1") != F.col("k2")).alias("n_moved"), F.count("*").alias("n"))


@query("SELECT field_id, id AS event_id, CAST(row_number() OVER (PARTITION BY field_id ORDER BY created_at, id) AS INTEGER) AS version FROM (SELECT DISTINCT id, field_id, created_at FROM field_events WHERE event_type IN ('created', 'definition_changed'))")
def w04_version_numbers(s, d):
    ev = load(s, d, "field_events").where("event_type in ('created', 'definition_changed')").select("field_id", F.col("id").alias("event_id"), "created_at").distinct()
    return review.versions(ev, "field_id", ["created_at", "event_id"]).select("field_id", "event_id", F.col("version").cast("int").alias("version"))


# ---- joins and filters of the inventory


@query(f"WITH {FL}, v AS (SELECT DISTINCT id, field_id FROM field_aliases), t AS (SELECT DISTINCT namespace FROM f) SELECT t.namespace, count(v.id) AS n_fields FROM t LEFT JOIN f ON f.namespace = t.namespace LEFT JOIN v ON v.field_id = f.id GROUP BY 1")
def j04_view_field_counts(s, d):
    """All views, those without fields too: namespaces as views, aliases as their fields."""
    f = F_(s, d).select("namespace", F.col("id").alias("field_id"))
    n = load(s, d, "field_aliases").select("id", "field_id").distinct().groupBy("field_id").agg(F.count("*").alias("k"))
    return f.join(n, "field_id", "left").groupBy("namespace").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n_fields"))


@query(f"WITH {FL} SELECT f.id, count(DISTINCT ev.id) AS n_changes, max(ev.created_at) AS latest FROM f LEFT JOIN field_events ev ON ev.field_id = f.id AND ev.event_type = 'definition_changed' GROUP BY 1")
def j05_latest_versions(s, d):
    ev = load(s, d, "field_events").where("event_type = 'definition_changed'").groupBy(F.col("field_id").alias("id")).agg(F.count_distinct(F.col("id")).alias("n_changes"), F.max("created_at").alias("latest"))
    return F_(s, d).select("id").join(ev, "id", "left").select("id", F.coalesce("n_changes", F.lit(0)).alias("n_changes"), "latest")


@query("""WITH r AS (SELECT o_orderkey AS id, o_custkey AS owner, nullif(o_orderpriority, '5-LOW') AS pr FROM orders) SELECT a.owner, count(*) AS n_linked, count(DISTINCT b.id) AS n_distinct, count(a.pr) AS n_ranked FROM r a JOIN (SELECT DISTINCT l_orderkey AS id FROM lineitem) b ON b.id = a.id GROUP BY 1""")
def j16_linked_records(s, d):
    r = load(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("pr"))
    b = load(s, d, "lineitem").select(F.col("l_orderkey").alias("id")).distinct()
    j = r.join(b, "id")  # an order is in the table once
    return j.groupBy("owner").agg(F.count("*").alias("n_linked"), F.count_distinct("id").alias("n_distinct"), F.count("pr").alias("n_ranked"))


def without_none(c: Column, sentinels: tuple[str, ...]) -> Column:
    """The items of an array that are no sentinel and not null."""
    return F.filter(c, lambda x: x.isNotNull() & ~x.isin(*sentinels))


@query("SELECT key, array_to_string(list_filter([latex, label_zh, label_en, defining_relation, notes], lambda x: x IS NOT NULL AND x NOT IN ('', '0', 'none')), '|') AS kept FROM (SELECT DISTINCT * FROM c4b)")
def p12_without_sentinels(s, d):
    c = load(s, d, "c4b").distinct()
    return c.select("key", F.array_join(without_none(F.array("latex", "label_zh", "label_en", "defining_relation", "notes"), ("", "0", "none")), "|").alias("kept"))


@query("SELECT source_kind, source_ref, candidate_field_id, bool_or(source_kind = 'field' AND source_ref NOT IN (SELECT id FROM fields)) OR bool_or(candidate_field_id NOT IN (SELECT id FROM fields)) AS unresolved FROM semantic_candidates GROUP BY ALL HAVING unresolved OR max(score) IS NULL")
def p21_unresolved(s, d):
    """Candidates whose sides aren't registered, or that were never scored."""
    c = load(s, d, "semantic_candidates").groupBy("source_kind", "source_ref", "candidate_field_id").agg(F.max("score").alias("score"))
    known = load(s, d, "fields").select("id").distinct()
    j = lookup_join(c, known.select(F.col("id").alias("source_ref"), F.lit(True).alias("k1")), "source_ref", "left", spread=F.col("candidate_field_id"), salted=False)
    j = lookup_join(j, known.select(F.col("id").alias("candidate_field_id"), F.lit(True).alias("k2")), "candidate_field_id", "left", spread=F.col("source_ref"), salted=False)
    u = ((F.col("source_kind") == "field") & F.col("k1").isNull()) | F.col("k2").isNull()
    return j.withColumn("unresolved", u).where(F.col("unresolved") | F.col("score").isNull()).select("source_kind", "source_ref", "candidate_field_id", "unresolved")


@query(f"WITH {E} SELECT id, kind, label FROM e WHERE kind IN ('canon', 'symbol') AND (contains(lower(label), 'be') OR contains(lower(id), '-0000000')) ")
def p22_canon_search(s, d):
    e = E_(s, d).where(F.col("kind").isin("canon", "symbol"))
    return e.where(F.contains(F.lower("label"), F.lit("be")) | F.contains(F.lower("id"), F.lit("-0000000"))).select("id", "kind", "label")


@query("SELECT DISTINCT doc_id, lower(replace(p, chr(92), '/')) AS path FROM (SELECT doc_id, unnest(string_split(source || chr(92) || coalesce(lang, 'XX') || ';' || source || '/A.MD', ';')) AS p FROM documents) WHERE p <> ''")
def p23_container_paths(s, d):
    docs = load(s, d, "documents")
    paths = F.concat(F.col("source"), F.lit("\\"), F.coalesce("lang", F.lit("XX")), F.lit(";"), F.col("source"), F.lit("/A.MD"))
    return docs.select("doc_id", F.explode(F.split(paths, ";")).alias("p")).where("p <> ''").select("doc_id", F.lower(F.replace("p", F.lit("\\"), F.lit("/"))).alias("path")).distinct()


_SHAPES = "'" + "|".join(S.SECRET_SHAPES) + "'"
_PLANT = """CASE doc_id % 12 WHEN 0 THEN 'sk-' || substring(md5(text), 1, 20) WHEN 1 THEN 'ghp_' || substring(md5(text), 1, 16) WHEN 2 THEN 'AKIA' || upper(substring(md5(text), 1, 16)) WHEN 3 THEN md5(text) WHEN 4 THEN 'Ab3-' || substring(md5(text), 1, 26) WHEN 5 THEN substring(md5(text), 1, 27)
WHEN 6 THEN 'eyJ' || substring(md5(text), 1, 12) || '.' || substring(md5(text), 1, 12) || '.x' WHEN 7 THEN '-----BEGIN RSA PRIVATE KEY-----' WHEN 8 THEN 'a-lower-case-name-of-many-words-2026-08-24' WHEN 9 THEN 'path/Ab3_' || substring(md5(text), 1, 26) ELSE '' END"""


@query(f"""WITH x AS (SELECT doc_id, text || ' ' || {_PLANT} AS t FROM documents), y AS (SELECT doc_id, t, regexp_matches(t, {_SHAPES}) AS shape, regexp_matches(t, '[A-Za-z0-9]{{28,}}') AS run, len(list_filter(regexp_extract_all(t, '(?:^|[^A-Za-z0-9_/.])([A-Za-z0-9_\\-]{{28,}})', 1),
lambda r: length(regexp_replace(r, '[^-_]', '', 'g')) <= 3 AND regexp_matches(r, '[a-z]') AND regexp_matches(r, '[A-Z]') AND regexp_matches(r, '[0-9]'))) > 0 AS mixed FROM x) SELECT doc_id, shape, run OR mixed AS token FROM y WHERE shape OR run OR mixed""")
def p20_secret_guard(s, d):
    """The documents with made-up secrets, names and digests at their ends."""
    t = load(s, d, "documents").select("doc_id", F.concat("text", F.lit(" "), F.expr(_PLANT)).alias("t"))
    return t.where(S.looks_secret(F.col("t"))).select("doc_id", S.known_secret(F.col("t")).alias("shape"), S.bare_token(F.col("t")).alias("token"))


@query("SELECT extension, CASE WHEN extension IN ('md', 'txt', 'rst') THEN 'text' WHEN extension IN ('json', 'jsonl', 'csv', 'tsv') THEN 'data' WHEN extension IN ('py', 'js', 'mjs', 'ts', 'tsx', 'rs', 'go', 'lean', 'css', 'html') THEN 'source' WHEN extension IN ('zip', 'tar', 'gz', '7z') THEN 'archive' WHEN extension IN ('png', 'jpg', 'jpeg', 'gif', 'svg') THEN 'image' WHEN extension IN ('pdf', 'docx') THEN 'document' ELSE 'binary' END AS media, CASE WHEN extension = 'rs' THEN 'Rust' WHEN extension = 'py' THEN 'Python' END AS language, count(*) AS n FROM (SELECT CASE doc_id % 9 WHEN 0 THEN 'md' WHEN 1 THEN 'jsonl' WHEN 2 THEN 'rs' WHEN 3 THEN 'py' WHEN 4 THEN '7z' WHEN 5 THEN 'svg' WHEN 6 THEN 'docx' WHEN 7 THEN 'exe' ELSE '' END AS extension FROM documents) GROUP BY ALL")
def f15_media_classes(s, d):
    names = F.array(*[F.lit(x) for x in ("a/b.MD", "x.jsonl", "lib.rs", "m.py", "z.7z", "i.svg", "d.docx", "run.exe", "README")])
    p = load(s, d, "documents").select(F.get(names, (F.col("doc_id") % 9).cast("int")).alias("path"))
    return p.groupBy(S.extension(F.col("path")).alias("extension"), S.media_class(F.col("path")).alias("media"), S.programming_language(F.col("path")).alias("language")).agg(F.count("*").alias("n"))


@query(f"WITH {_CUR_CAND}, y AS (SELECT source_ref AS id, candidate_field_id AS other, 'out' AS direction, score FROM x WHERE source_kind = 'field' UNION ALL SELECT candidate_field_id, source_ref, 'in', score FROM x WHERE source_kind = 'field') SELECT id, direction, other, score, CAST(rn AS INTEGER) AS nth, n - 3 AS n_omitted FROM (SELECT *, row_number() OVER (PARTITION BY id, direction ORDER BY score DESC NULLS LAST, other) AS rn, greatest(count(*) OVER (PARTITION BY id, direction), 3) AS n FROM y) WHERE rn <= 3")
def g07_edges_both_ways(s, d):
    """A field's links in and out, the three best of each with the number left out."""
    c = _candidates(s, d).where("source_kind = 'field'")
    both = c.select(F.col("source_ref").alias("id"), F.col("candidate_field_id").alias("other"), F.lit("out").alias("direction"), "score").unionByName(c.select(F.col("candidate_field_id").alias("id"), F.col("source_ref").alias("other"), F.lit("in").alias("direction"), "score"))
    n = both.groupBy("id", "direction").agg(F.count("*").alias("n"))
    top = store.rank_within(both, ["id", "direction"], [F.desc_nulls_last("score"), F.col("other")], 3)
    return top.join(n, ["id", "direction"]).select("id", "direction", "other", "score", F.col("rank").cast("int").alias("nth"), (F.greatest("n", F.lit(3)) - 3).alias("n_omitted"))


@query(f"WITH {FL}, r AS (SELECT DISTINCT {_PAIRS} FROM semantic_candidates WHERE source_kind = 'field' AND score >= 0.72 AND source_ref <> candidate_field_id), b AS (SELECT left_id AS id, right_id AS other FROM r UNION ALL SELECT right_id, left_id FROM r) SELECT f.key, count(*) AS n_related, count(DISTINCT g.namespace) AS n_namespaces FROM b JOIN f ON f.id = b.id JOIN f g ON g.id = b.other GROUP BY f.id, f.key")
def g06_field_relations(s, d):
    f = F_(s, d)
    r = load(s, d, "semantic_candidates").where("source_kind = 'field' and score >= 0.72 and source_ref <> candidate_field_id").select(*review.unordered(F.col("source_ref"), F.col("candidate_field_id"))).distinct()
    b = r.select(F.col("left_id").alias("id"), F.col("right_id").alias("other")).unionByName(r.select(F.col("right_id").alias("id"), F.col("left_id").alias("other")))
    j = lookup_join(b, f.select(F.col("id").alias("other"), "namespace"), "other", spread=F.col("id"))
    return j.groupBy("id").agg(F.count("*").alias("n_related"), F.count_distinct("namespace").alias("n_namespaces")).join(f.select("id", "key"), "id").select("key", "n_related", "n_namespaces")
