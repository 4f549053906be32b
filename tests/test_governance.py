"""Utility, reviews, decisions and reconciliations on small fixtures."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomcell.functions import jsontext as J
from loomcell.functions import scalars as S
from loomcell.operators import difference, query, review, utility

T0 = datetime(2025, 1, 1)


def as_of():
    return F.lit(datetime(2025, 3, 1)).cast("timestamp_ntz")


def tables(spark, guard=()):
    day = lambda n: T0 + timedelta(n)
    f = spark.createDataFrame([(i, st, at, at) for i, st, at in [("old", "active", T0), ("guarded", "active", T0), ("young", "active", day(58)), ("near", "active", T0), ("quiet", "converged", T0), ("woken", "converged", T0), ("split", "split", T0), ("used", "active", T0)]], "id string, status string, created_at timestamp_ntz, updated_at timestamp_ntz")
    cells = spark.createDataFrame([("used", day(2)), ("used", day(3)), ("near", day(1)), ("woken", day(9)), ("quiet", day(2)), ("gone", day(2)), (None, day(2))], "field_id string, updated_at timestamp_ntz")
    views = spark.createDataFrame([("v1", "used", day(1)), ("v1", "used", day(1)), ("v2", "used", day(4))], "view_id string, field_id string, created_at timestamp_ntz")
    cand = spark.createDataFrame([("field", "near", "old", "pending", 0.9), ("field", "near", "old", "pending", None), ("field", "used", "young", "reviewed", 0.99), ("proposal", "used", "young", "pending", 0.99)], "source_kind string, source_ref string, candidate_field_id string, status string, score double")
    guards = spark.createDataFrame([(1, "guarded", False), (2, "guarded", True), (3, "woken", True), *guard], "id bigint, field_id string, protected boolean")
    events = spark.createDataFrame([(1, "quiet", "converged", day(5)), (2, "woken", "converged", day(8)), (1, "woken", "converged", day(20)), (9, "used", "created", day(1))], "id bigint, field_id string, event_type string, created_at timestamp_ntz")
    return f, cells, views, cand, guards, events


def test_every_branch_of_the_advice(spark):
    e = utility.evidence(*tables(spark))
    got = {r.field_id: r for r in utility.assess(e, 10, as_of()).collect()}
    assert {k: r.recommendation for k, r in got.items()} == {"old": "converge_candidate", "guarded": "keep", "young": "insufficient_evidence", "near": "review", "quiet": "keep", "woken": "reactivate_candidate", "split": "keep", "used": "keep"}
    assert (got["used"].n_cells, got["used"].n_views, got["used"].score) == (2, 2, 0.64)
    assert got["near"].redundancy == 0.9 and got["old"].redundancy == 0.9 and got["young"].redundancy == 0.0
    none = {r.recommendation for r in utility.assess(e, 0, as_of()).where("field_id = 'used'").collect()}
    assert none == {"insufficient_evidence"}
    empty = utility.evidence(*[t.limit(0) for t in tables(spark)])
    assert utility.assess(empty, 0, as_of()).count() == 0


def test_stale_assessments_move_nothing(spark):
    e = utility.evidence(*tables(spark))
    a, then = utility.assess(e, 10, as_of()), utility.basis(e, 10)
    out = {r.field_id: (r.outcome, r.new_status) for r in utility.apply(a, then, then).collect()}
    assert out["old"] == ("applied", "converged") and out["woken"] == ("applied", "active") and out["used"] == ("not_actionable", "active")
    later = utility.basis(utility.evidence(*tables(spark, [(7, "old", False)])), 10)
    out = {r.field_id: (r.outcome, r.new_status) for r in utility.apply(a, then, later).collect()}
    assert out["old"] == ("stale", "active") and out["woken"] == ("applied", "active")
    assert {r.field_id: (r.guardrail_id, r.protected, r.n_changes) for r in utility.guardrails(tables(spark)[4]).collect()} == {"guarded": (2, True, 2), "woken": (3, True, 1)}


def test_pairs_reviews_and_partitions(spark):
    p = "left_id string, right_id string, score double"
    found = spark.createDataFrame([("b", "a", 0.8), ("a", "b", 0.9), ("c", "c", 1.0), ("c", "d", None), ("e", "f", 0.7)], p)
    fresh = {tuple(r) for r in review.fresh_pairs(found, spark.createDataFrame([("f", "e", 0.1)], p)).collect()}
    assert fresh == {("a", "b", 0.9), ("c", "d", None)}
    r = spark.createDataFrame([(3, 1, "alias"), (2, 1, "ignore"), (2, 1, "ignore"), (4, 2, "related"), (5, None, "alias")], "id int, candidate_id int, decision string")
    c = spark.createDataFrame([(1,), (2,), (2,), (3,)], "id int")
    assert {tuple(x) for x in review.review_once(c, r).collect()} == {(1, "ignore", 1, None), (2, "related", 0, "related_to"), (3, "pending", 0, None)}
    whole = spark.createDataFrame([("k", "a"), ("k", "b"), ("l", "a"), ("m", "a")], "key string, item string")
    parts = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("k", 2, "b"), ("l", 1, "a"), ("l", 2, "a"), ("l", 1, "z"), ("n", 1, "q")], "key string, part int, item string")
    got = {r.key: (r.n_missing, r.n_foreign, r.n_doubled, r.exact) for r in review.partition_check(whole, parts, "key", "item").collect()}
    assert got == {"k": (0, 0, 0, True), "l": (0, 1, 1, False), "m": (1, 0, 0, False), "n": (0, 1, 0, False)}


def test_a_family_basis_follows_its_members(spark):
    m = spark.createDataFrame([("f", "a"), ("f", "b"), ("f", "b"), ("g", "c")], "family_id string, field_id string")
    f = spark.createDataFrame([("a", "k", "active", T0), ("b", "l", None, T0)], "id string, key string, status string, updated_at timestamp_ntz")
    before, after = review.family_basis(m, f), review.family_basis(m, f.withColumn("status", F.when(F.col("id") == "b", "merged").otherwise(F.col("status"))))
    assert {tuple(r) for r in review.stale(before, after).collect()} == {("f", True), ("g", False)}
    assert {r.family_id: r.n_members for r in before.collect()} == {"f": 2, "g": 1}


ENVELOPE = {"allow_external": False, "allow_shared_world": True, "allow_irreversible": False, "authority_domains": ["r"], "resource_owners": ["s"], "max_cost_units": 3}


def test_precedence_of_decisions(spark):
    ok = (False, False, "r", "s", False, 1)
    rows = [("run", None, *ok), ("dispute", "disputed", None, *ok[1:]), ("basis", "basis_incompatible", True, *ok[1:]), ("unstated", "strong_agreement", *ok[:5], None), ("outside", None, True, True, "x", "s", True, 9), ("dear", None, *ok[:5], 4)]
    df = spark.createDataFrame(rows, "id string, consensus string, external boolean, shared_world boolean, authority_domain string, resource_owner string, irreversible boolean, cost_units int")
    got = {r.id: (r.decision, r.reasons) for r in review.decide(df, ENVELOPE).collect()}
    assert got == {"run": ("EXECUTE", "inside_autonomy_envelope"), "dispute": ("ESCALATE", "consensus_conflict"), "basis": ("DEFER", "consensus_basis_incompatible"), "unstated": ("DEFER", "effect_classification_incomplete"),
                   "outside": ("ESCALATE", "external_effect_not_delegated,authority_domain_not_delegated,irreversible_effect_not_delegated,cost_exceeds_envelope"), "dear": ("DEFER", "cost_exceeds_envelope")}


def test_a_view_of_more_than_200_fields(spark):
    v = spark.createDataFrame([(f"f{i}", i % 2 == 0) for i in range(350)], "field_id string, loaded boolean")
    c = spark.createDataFrame([("e", "f0", "1"), ("e", "f2", "null"), ("e", "f1", "1")], "entity_id string, field_id string, value_json string")
    got = {r.field_id: r.state for r in query.slots(c, v, spark.createDataFrame([("e",)], "entity_id string")).collect()}
    assert len(got) == 350 and got["f0"] == "present" and got["f2"] == "blank" and got["f1"] == "unloaded" and got["f348"] == "absent"


def test_versions_are_numbered_per_key(spark):
    df = spark.createDataFrame([("hot" if i % 3 else "b", i) for i in range(300)], "k string, i int").repartition(5)
    got = {(r.k, r.i): r.version for r in review.versions(df, "k", ["i"]).collect()}
    for k in ("hot", "b"):
        mine = sorted(i for kk, i in got if kk == k)
        assert [got[k, i] for i in mine] == list(range(1, len(mine) + 1))


# ---- numbers of any exponent


VAST = ["1e99999999999999999999", "2e99999999999999999999", "-1e99999999999999999999", "1e-99999999999999999999", "3E-99999999999999999999"]


def test_vast_numbers_stay_apart():
    assert len({J.canonical(J.parse(x)) for x in VAST}) == len(VAST)
    assert J.canonical(J.parse("10e99999999999999999998")) == J.canonical(J.parse("1.0e+99999999999999999999"))
    assert J.canonical(J.parse("0e99999999999999999999")) == "0" == J.canonical(J.parse("0.000E-99999999999999999999"))
    for x in VAST:
        bits = J.fit_bits(J.parse(x))
        assert bits & J.TYPE_BITS["number"] and not bits & J.TYPE_BITS["integer"]
        J.typed(J.parse(x))
    assert J.fit_bits(J.parse("0e99999999999999999999")) & J.TYPE_BITS["integer"]


def test_vast_numbers_differ_between_copies(spark):
    df = lambda x: spark.createDataFrame([("e", T0, "k", "{\"a\": " + x + "}")], "entity_id string, at timestamp_ntz, kind string, v string")
    diff = lambda x, y: difference.differences(df(x), df(y), "entity_id", "at", ["kind"], "v", "a", "b").count()
    assert diff(VAST[0], VAST[1]) == 1 and diff(VAST[0], VAST[0]) == 0 and diff(VAST[3], "0") == 1


# ---- secrets


SECRETS = ["sk-" + "a" * 16, "x ghp_" + "A" * 16, "AKIA" + "A1" * 8, "AIza" + "b" * 35, "eyJ" + "a" * 10 + "." + "b" * 10 + ".", "-----BEGIN RSA PRIVATE KEY-----", "a" * 28, "Ab3-" + "x" * 26]
NAMES = ["", "sk-short", "efficient-lower-case-name-of-a-site-2026-08-24", "a" * 27, "path/Ab3_" + "x" * 22, "xghp_" + "A" * 10, None]


@pytest.mark.parametrize("many", [1, 3])
def test_secrets(spark, many):
    df = spark.createDataFrame([(x, x in SECRETS) for x in SECRETS + NAMES] * many, "t string, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", S.looks_secret(F.col("t"))).collect())
    tolerant = df.withColumn("got", S.looks_secret(F.col("t"), F.lit("notes"))).where("got").select("t").distinct().count()
    assert tolerant == 6  # known shapes are refused everywhere
