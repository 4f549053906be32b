"""Wide rows, nested records, history and differences against plain Python."""

import json
import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomcell.functions import jsontext as J
from loomcell.operators import difference, history, nested, wide
from loomcell.plans import problems

T0 = datetime(2025, 1, 1)
CELLS = "entity_id string, field_id string, value_json string, updated_at timestamp_ntz"
FIELDS = "id string, key string, value_type string, updated_at timestamp_ntz, normalized_key string, namespace string"


def fields(spark, types):
    return spark.createDataFrame([(i, i, t, T0, i, "n") for i, t in types.items()], FIELDS)


# ---- JSON


@pytest.mark.parametrize("text", ["", " ", "NaN", "Infinity", "[1,]", '{"a":1,}', "{'a':1}", "01", "1 2", '"a', "\x0b1", '{"a" 1}', "[1", "]", '"\x01"', "﻿1", "tru", "+1", ".5", "5."])
def test_not_json(text):
    for f in (J.parse, J._parse_deep):
        with pytest.raises(J.NotJson):
            f(text)


json_values = st.recursive(st.none() | st.booleans() | st.integers(-(2**70), 2**70) | st.text(max_size=5) | st.floats(allow_nan=False, allow_infinity=False), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=4), x, max_size=4), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(json_values, st.sampled_from([None, 1]))
def test_both_parsers_and_canonical_text_agree(value, indent):
    text = json.dumps(value, indent=indent)
    a, b = J.parse(text), J._parse_deep(text)
    assert J.canonical(a) == J.canonical(b) == J.canonical(J.parse(J.canonical(a)))


def test_deep_nesting_is_read():
    n = 200_000
    x = J.parse("[" * n + "]" * n)
    assert J.canonical(x) == "[" * n + "]" * n
    assert len(nested.label(x)) == n


def test_numbers_are_exact():
    same = [("1", "1.0"), ("10", "1e1"), ("0", "-0.0"), ("9007199254740993", "9007199254740993.0"), ("1e400", "10e399")]
    assert all(J.canonical(J.parse(a)) == J.canonical(J.parse(b)) for a, b in same)
    assert J.canonical(J.parse("9007199254740993")) != J.canonical(J.parse("9007199254740992"))
    assert J.whole(Decimal("3.0")) == 3 and J.whole(Decimal("0.5")) is None and J.whole(Decimal(2**63)) is None and J.whole(Decimal(-(2**63))) == -(2**63)
    assert J.canonical(J.parse("1e99999999999999999999")) == "1e99999999999999999999"


# ---- wide rows


VALUES = [
    ("text", '"a"', True), ("text", "1", True), ("text", "true", True), ("text", "[]", False), ("text", "abc", False), ("text", None, False), ("text", "null", True),
    ("integer", "3.0", True), ("integer", "3.5", False), ("integer", '" 7 "', True), ("integer", '"1e2"', True), ("integer", "9223372036854775808", False), ("integer", "true", False), ("integer", '""', False),
    ("number", '"-1.5"', True), ("number", '"NaN"', False), ("number", "1e999", True), ("number", '"07"', False), ("number", "{}", False),
    ("boolean", '"TRUE"', True), ("boolean", '" true"', True), ("boolean", "1", False), ("boolean", '"yes"', False), ("array", "[]", True), ("array", "{}", False), ("object", "{}", True), ("json", "[1", False), ("json", "0", True),
    ("unheard", "x", True),
]


def test_unfit_cells(spark):
    f = fields(spark, {t: t for t in {v[0] for v in VALUES}})
    c = spark.createDataFrame([(f"e{i}", t, v, T0) for i, (t, v, _) in enumerate(VALUES)], CELLS)
    got = {r.entity_id for r in wide.unfit_cells(c, f).collect()}
    assert got == {f"e{i}" for i, (t, v, ok) in enumerate(VALUES) if not ok}


def test_latest_version_copies_and_null_times(spark):
    f = fields(spark, {"i": "integer"})
    rows = [("a", "i", "x", T0), ("a", "i", "1", T0 + timedelta(1)), ("b", "i", "1", T0), ("b", "i", "x", T0 + timedelta(1)), ("b", "i", "x", T0 + timedelta(1)), ("c", "i", "x", None), ("c", "i", "1", T0), (None, "i", "x", T0), ("d", None, "x", T0), ("e", "gone", "x", T0)]
    c = spark.createDataFrame(rows, CELLS)
    assert [tuple(r) for r in wide.unfit_cells(c, f).collect()] == [("b", "i")]
    assert wide.unfit_cells(c.limit(0), f).count() == 0 and wide.unfit_cells(c, f.limit(0)).count() == 0


def test_wide_rows_tell_absent_null_and_unfit_apart(spark):
    f = fields(spark, {"i": "integer", "t": "text", "o": "object"})
    c = spark.createDataFrame([("a", "i", "3.0", T0), ("a", "t", "null", T0), ("a", "o", '{"b": 1, "a": 2.0}', T0), ("b", "i", '"x"', T0)], CELLS).selectExpr("*", "1 as cells", "'x' as bits")
    w = {r.entity_id: r for r in wide.wide_rows(c, f, [("i", "i", "integer"), ("t", "t", "text")]).collect()}
    assert w["a"].i == 3 and w["a"].t is None and w["a"].null_fields == ["t"] and w["a"].others == {"o": '{"a":2,"b":1}'}
    assert w["b"].i is None and w["b"].unfit_fields == ["i"] and w["b"].null_fields == [] and w["b"].n_cells == 1


def test_fields_of_all_namespaces_are_typed(spark, tmp_path):
    reg = [("p", "title", "text", "paper"), ("c", "year", "integer", "canon"), ("l", "n", "number", "lab_x"), ("b", "ok", "boolean", "lab_x"), ("o", "meta", "object", "lab_x")]
    f = spark.createDataFrame([(i, k, k, t, ns, T0) for i, k, t, ns in reg], "id string, key string, normalized_key string, value_type string, namespace string, updated_at timestamp_ntz")
    c = spark.createDataFrame([("a", "p", '"x"', T0), ("a", "c", "7", T0), ("a", "l", "1.5", T0), ("a", "b", "true", T0), ("a", "o", '{"z": 1}', T0)], CELLS)
    f.write.parquet(f"{tmp_path}/fields.parquet")
    c.write.parquet(f"{tmp_path}/cells.parquet")
    r = problems.p1_wide(spark, str(tmp_path)).first()
    assert (r.title, r.year, r.other_numbers, r.other_booleans, r.others) == ("x", 7, {"l": 1.5}, {"b": True}, {"o": '{"z":1}'})
    assert r.other_texts == {} and r.other_integers == {} and r.n_cells == 5


def test_runs_compact_to_the_same_cells(spark, tmp_path):
    a = spark.createDataFrame([("a", "x", "1", T0), ("b", "x", "2", T0)], CELLS)
    b = spark.createDataFrame([("a", "x", "3", T0 + timedelta(1)), ("a", "y", "4", T0)], CELLS)
    wide.append_runs(a, f"{tmp_path}/runs")
    wide.append_runs(b, f"{tmp_path}/runs")
    base = wide.compact_store(spark, f"{tmp_path}/runs", f"{tmp_path}/base")
    got = {(r.entity_id, c.field_id): c.json for r in base.collect() for c in r.cells}
    assert got == {("a", "x"): "3", ("a", "y"): "4", ("b", "x"): "2"}
    wide.append_runs(spark.createDataFrame([("b", "x", "9", T0 + timedelta(2))], CELLS), f"{tmp_path}/base")
    again = {(r.entity_id, r.field_id): r.json for r in wide.compact(spark.read.parquet(f"{tmp_path}/base")).collect()}
    assert again[("b", "x")] == "9"


def test_hot_field_goes_the_salted_way(spark, monkeypatch):
    import loomcell.runtime as R

    f = fields(spark, {"i": "integer", "t": "text"})
    c = spark.createDataFrame([(f"e{k}", "i" if k % 3 else "t", "x" if k % 2 else "1", T0) for k in range(300)], CELLS)
    small = sorted(map(tuple, wide.unfit_cells(c, f).collect()))
    monkeypatch.setattr(R, "is_small", lambda *_: False)
    assert sorted(map(tuple, wide.unfit_cells(c, f).collect())) == small


# ---- nested records


def plain_objects(x, path="", around="", element=False):
    if isinstance(x, dict):
        if element:
            yield path, around
            around = path
        for k, v in x.items():
            yield from plain_objects(v, f"{path}/{k.replace('~', '~0').replace('/', '~1')}", around)
    elif isinstance(x, list):
        for i, v in enumerate(x):
            yield from plain_objects(v, f"{path}/{i}", around, True)


@settings(max_examples=200, deadline=None)
@given(json_values)
def test_intervals_contain_exactly_the_subtree(value):
    nodes = nested.label(J.parse(json.dumps(value)))
    path = [nested.pointer(nodes, n[0]) for n in nodes]
    for n in nodes:
        inside = {path[m[0]] for m in nodes if m[0] > n[0] and m[1] < n[1]}
        assert inside == {p for p in path if p.startswith(path[n[0]] + "/")}
    around = nested.enclosing(nodes, nested._is_case)
    got = [(path[n[0]], path[p] if p >= 0 else "") for n, p in zip(nodes, around, strict=True) if nested._is_case(n)]
    assert got == list(plain_objects(value))


def test_array_objects(spark):
    v = [("t", "1", '[[{"a/b": [{"~": 1}]}], {"c": {"d": [{}]}}]'), ("t", "2", "{"), ("t", "3", None), ("t", "4", '"[{}]"'), ("t", "5", '{"a": {}}'), ("t", "6", "")]
    got = {tuple(r) for r in nested.array_objects(spark.createDataFrame(v, "source_table string, record_id string, value string")).collect()}
    assert got == {("t", "1", "/0/0", ""), ("t", "1", "/0/0/a~1b/0", "/0/0"), ("t", "1", "/1", ""), ("t", "1", "/1/c/d/0", "/1")}


def test_subtree_by_containment(spark):
    n = nested.node_rows(spark.createDataFrame([("t", "1", '{"a": [1, {"b": 2}], "c": 3}')], "source_table string, record_id string, value string"))
    root = n.where("node_path = '/a'")
    assert {r.node_path for r in nested.subtree(n, root).collect()} == {"/a/0", "/a/1", "/a/1/b"}


# ---- history


def plain_history(rows):
    best = {}
    for k, t, i, v in rows:
        if k is not None and v is not None and ((k, t) not in best or best[k, t][0] < i):
            best[k, t] = (i, v)
    out, by = set(), {}
    for (k, t), (i, v) in best.items():
        by.setdefault(k, []).append((t or datetime.min, i, v))
    for k, evs in by.items():
        opened = []
        for t, i, v in sorted(evs):
            if not opened or opened[-1][1] != v:
                opened.append((i, v))
        out |= {(k, a[1], a[0], b) for a, b in zip(opened, [x[0] for x in opened[1:]] + [None], strict=True)}
    return out


@pytest.mark.parametrize("bits", [0, 2, 8])
def test_history_over_chunks_of_any_size(spark, bits):
    import random

    random.seed(bits)
    rows = [(random.choice(["hot", "hot", "b", "c", None]), T0 + timedelta(minutes=random.randrange(400)), i, random.choice(["x", "x", "y", None])) for i in range(700)]
    rows += rows[:50] + [("n", None, 5000, "x"), ("n", T0, 5001, "y")]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, i bigint, v string").selectExpr("*", "1 as chunk", "2 as vs")
    got = {(r.k, r.v, r.opened_by, r.closed_by) for r in history.history(df, "k", "t", "i", "v", chunk_bits=bits).collect()}
    assert got == plain_history(rows)
    assert history.history(df.limit(0), "k", "t", "i", "v").count() == 0


def test_as_of(spark):
    df = spark.createDataFrame([("a", T0, 1, "x"), ("a", T0 + timedelta(2), 2, "y")], "k string, t timestamp_ntz, i bigint, v string")
    h = history.history(df, "k", "t", "i", "v")
    assert [r.v for r in history.as_of(h, "k", T0 + timedelta(1)).collect()] == ["x"]


# ---- differences


REC = "entity_id string, kind string, label string, values_json string, observed_at timestamp_ntz"


def diff(spark, a, b):
    x, y = spark.createDataFrame(a, REC).selectExpr("*", "1 as ha", "2 as k"), spark.createDataFrame(b, REC)
    return {(r.entity_id, r.side, r.field_name): (r.expected, r.actual) for r in difference.differences(x, y, "entity_id", "observed_at", ["kind", "label"], "values_json", "snapshot_only", "store_only").collect()}


def test_differences(spark):
    a = [("1", "k", "l", '{"a": 1.0, "b": null, "c": [1, 2], "d": {"x": 1, "y": 2}, "e": 9007199254740993, "f": "1"}', T0), ("2", "k", None, "{}", T0), ("3", "k", "l", None, T0), ("4", "k", "l", "broken", T0), ("1", "old", "old", "{}", T0 - timedelta(1)), ("5", "k", "l", "{}", T0)]
    b = [("1", "k", "l", '{"d": {"y": 2, "x": 1.0}, "a": 1, "c": [2, 1], "e": 9007199254740992, "f": 1}', T0), ("1", "k", "l", '{"d": {"y": 2, "x": 1.0}, "a": 1, "c": [2, 1], "e": 9007199254740992, "f": 1}', T0), ("2", "K", "", "{}", T0), ("3", "k", "l", "{}", None), ("4", "k", "l", "broken", T0), ("6", "k", "l", "{}", T0), (None, "k", "l", "{}", T0)]
    got = diff(spark, a, b)
    assert got == {("1", "both", "b"): ("null", None), ("1", "both", "c"): ("[1,2]", "[2,1]"), ("1", "both", "e"): ("9007199254740993", "9007199254740992"), ("1", "both", "f"): ('"1"', "1"),
                   ("2", "both", "entity.kind"): ("k", "K"), ("2", "both", "entity.label"): (None, ""), ("5", "snapshot_only", ""): (None, None), ("6", "store_only", ""): (None, None)}
    assert diff(spark, a, a) == {} and diff(spark, [], []) == {}


@pytest.mark.parametrize("bits", [1, 3])
def test_history_of_a_hot_key_is_spread(spark, monkeypatch, bits):
    """One key with most rows: the way by ranges gives what the way by windows gives."""
    rng = random.Random(bits)
    rows = [("hot" if i % 4 else f"k{i % 3}", T0 + timedelta(seconds=rng.randrange(900)), i, rng.choice(["a", "a", "a", "b", None])) for i in range(1500)]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, i int, v string").repartition(6)
    plain = {tuple(r) for r in history.history(df, "k", "t", "i", "v", bits).collect()}
    monkeypatch.setattr(history, "has_hot_key", lambda *_: True)
    spread = [tuple(r) for r in history.history(df, "k", "t", "i", "v", bits).collect()]
    assert set(spread) == plain and len(spread) == len(plain) > 100


def test_lookups_are_bounded_by_bytes_too(spark, monkeypatch):
    import loomcell.runtime as R

    small = spark.createDataFrame([(i, "x" * 1000) for i in range(100)], "k int, t string")
    assert R.is_small(small) and not R.is_small(small, 99)
    monkeypatch.setattr(R, "BROADCAST_BYTES", 50_000)
    assert not R.is_small(small)
    big = spark.range(900).selectExpr("cast(if(id % 3 = 0, 7, id % 150) as int) as k", "id")
    assert R.lookup_join(big, small, "k", spread=F.col("id")).count() == big.where("k < 100").count()


def test_node_tables_link_by_interval(spark):
    r = spark.createDataFrame([("t", "1", '{"a":[{"b":1},[{"c":null}]]}'), ("t", "2", "{"), ("t", "3", None)], "source_table string, record_id string, value string")
    t = nested.node_tables(r)
    assert {k: v.count() for k, v in t.items()} == {"objects": 3, "arrays": 2, "scalars": 2}
    o, s = t["objects"].withColumnRenamed("pre", "p0").withColumnRenamed("post", "q0"), t["scalars"]
    inside = s.join(o.select("record_id", "p0", "q0", F.col("node_path").alias("around")), "record_id").where("pre > p0 and post < q0")
    assert {(x.node_path, x.around) for x in inside.collect()} == {("/a/0/b", ""), ("/a/0/b", "/a/0"), ("/a/1/0/c", ""), ("/a/1/0/c", "/a/1/0")}


def test_unresolved_candidates_are_joined_without_copies(spark, monkeypatch, tmp_path):
    import loomcell.runtime as R
    from loomcell.plans import governance

    # as many short ids as the row bound allows take more than the byte bound
    assert not R.is_small(spark.range(180_000).select(F.sha1(F.col("id").cast("string")).alias("id"), F.lit(True).alias("k1")))
    spark.range(50).selectExpr("concat('f', id) id").write.parquet(f"{tmp_path}/fields.parquet")
    c = [("field", "f1", "f2", 0.5), ("field", "x", "f2", 0.5), ("proposal", "x", "f2", 0.5), ("proposal", "x", "y", 0.5), ("field", "f3", "f4", None)]
    spark.createDataFrame([*c, *[("field", "hot", f"f{i}", 0.9) for i in range(50)]], "source_kind string, source_ref string, candidate_field_id string, score double").write.parquet(f"{tmp_path}/semantic_candidates.parquet")
    want = {("field", "x", "f2", True), ("proposal", "x", "y", True), ("field", "f3", "f4", False), *[("field", "hot", f"f{i}", True) for i in range(50)]}
    for small in (True, False):
        monkeypatch.setattr(R, "is_small", lambda *_, small=small: small)
        u = governance.p21_unresolved(spark, str(tmp_path))
        assert "explode" not in u._jdf.queryExecution().optimizedPlan().toString()
        rows = [tuple(r) for r in u.collect()]
        assert set(rows) == want and len(rows) == len(want)


def test_missing_targets_take_no_copies(spark, monkeypatch, data):
    import loomcell.runtime as R
    from loomcell.plans import analysis

    got = []
    for small in (True, False):
        monkeypatch.setattr(R, "is_small", lambda *_, small=small: small)
        m = analysis.g01_missing_targets(spark, data)
        assert "__salt" not in m._jdf.queryExecution().analyzed().toString()
        got.append(sorted(map(tuple, m.collect())))
    assert got[0] == got[1] and got[0]


def test_aligned_defaults_take_no_copies(spark, monkeypatch, data):
    import loomcell.runtime as R
    from loomcell.plans import more

    got = []
    for small in (True, False):
        monkeypatch.setattr(R, "is_small", lambda *_, small=small: small)
        a = more.j24_aligned_defaults(spark, data)
        assert "__salt" not in a._jdf.queryExecution().analyzed().toString()
        got.append(sorted(map(tuple, a.collect())))
    assert got[0] == got[1] and len(got[0]) == spark.read.parquet(f"{data}/lineitem.parquet").count()
