"""Explainable similarity of registry fields, blocked so that no all-pairs plan arises."""

from __future__ import annotations

import heapq
import math
import re
import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from loomcell.runtime import lookup_join, ship, spool

# Words without weight, and the weights of the score.
STOPWORDS = "a an and as at by for from in of on or the to with".split()
WEIGHTS = {"key": 0.45, "label": 0.30, "description": 0.10, "type": 0.10, "namespace": 0.05}
CHAR_FACTOR, TYPE_PENALTY = 0.85, 0.60

_TOKEN = re.compile(r"[a-z0-9]+|[㐀-鿿]+")


def _plain(s: str | None) -> str:
    return re.sub(r"[_\-/.]", " ", unicodedata.normalize("NFKC", s or "").lower())


def tokens(s: str | None) -> list[str]:
    """Words without stopwords, in order, once each."""
    return [t for t in dict.fromkeys(_TOKEN.findall(_plain(s))) if t not in STOPWORDS]


def compact(s: str | None) -> str:
    """All words run together, stopwords kept."""
    return "".join(_TOKEN.findall(_plain(s)))


@pandas_udf(T.ArrayType(T.StringType()))
def name_tokens(s: pd.Series) -> pd.Series:
    return s.map(tokens)


@pandas_udf(T.StringType())
def _compacted(s: pd.Series) -> pd.Series:
    return s.map(compact)


def ascii_tokens(c: Column) -> Column:
    """tokens() of ASCII texts without leaving the JVM, sorted."""
    found = F.regexp_extract_all(F.regexp_replace(F.lower(c), r"[_\-/.]", " "), F.lit("([a-z0-9]+)"), 1)
    return F.array_sort(F.array_distinct(F.array_except(found, F.array(*map(F.lit, STOPWORDS)))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; 1 where both are empty."""
    n = F.size(F.array_union(a, b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(1.0)


@lru_cache(10_000)
def char_ratio(a: str, b: str) -> float:
    """Share of matching characters; texts both empty are equal."""
    return SequenceMatcher(None, a, b, autojunk=False).ratio() if a and b else float(a == b)


@lru_cache(100_000)
def _parts(s: str | None) -> tuple[frozenset[str], str]:
    return frozenset(tokens(s)), compact(s)


def _token_score(a: str | None, b: str | None) -> float:
    x, y = _parts(a)[0], _parts(b)[0]
    return len(x & y) / len(x | y) if x | y else 1.0


def _text_score(a: str | None, b: str | None) -> float:
    words = _token_score(a, b)
    return words if words >= CHAR_FACTOR else max(words, CHAR_FACTOR * char_ratio(_parts(a)[1], _parts(b)[1]))


def _text_bound(a: str | None, b: str | None) -> float:
    """At least _text_score: the ratio can't exceed the share of common characters."""
    x, y = _parts(a)[1], _parts(b)[1]
    return max(_token_score(a, b), CHAR_FACTOR * (SequenceMatcher(None, x, y, autojunk=False).quick_ratio() if x and y else float(x == y)))


def _same(left: dict, right: dict, name: str) -> bool:
    return unicodedata.normalize("NFKC", left[name] or "").strip().lower() == unicodedata.normalize("NFKC", right[name] or "").strip().lower()


def can_reach(left: dict, right: dict, threshold: float) -> bool:
    """Whether the score may be that high, without the costly ratio."""
    same = _same(left, right, "value_type")
    rest = WEIGHTS["type"] * same + WEIGHTS["namespace"] * _same(left, right, "namespace")
    bound = rest + sum(WEIGHTS[k] * _text_bound(left[k], right[k]) for k in ("key", "label", "description"))
    return bound * (1 if same else TYPE_PENALTY) >= threshold - 1e-6


def pair_score(left: dict, right: dict) -> dict:
    """Signals and score of two fields, left first; rounded to 6 places."""
    sig = {k: _text_score(left[k], right[k]) for k in ("key", "label", "description")}
    sig |= {"type": float(_same(left, right, "value_type")), "namespace": float(_same(left, right, "namespace"))}
    score = sum(WEIGHTS[k] * v for k, v in sig.items()) * (1 if sig["type"] else TYPE_PENALTY)
    return {k: round(v, 6) for k, v in sig.items()} | {"score": round(min(1.0, max(0.0, score)), 6)}


_ATTRS = ["key", "label", "description", "value_type", "namespace"]
_SIGNALS = ["key", "label", "description", "type", "namespace", "score"]


def score_pairs(pairs: DataFrame, f: DataFrame, threshold: float | None = None) -> DataFrame:
    """pairs (left_id, right_id) with s_key, s_label, s_description, s_type,
    s_namespace and score. Null texts are empty texts. With a threshold only pairs
    at or above it; most others fall by a bound before the costly part."""
    ship(f.sparkSession)
    side = lambda p: f.select(F.col("id").alias(f"{p}_id"), *[F.col(a).alias(f"{p}_{a}") for a in _ATTRS])
    j = pairs.select("left_id", "right_id").join(side("left"), "left_id").join(side("right"), "right_id")
    j = j.select("left_id", "right_id", *[f"{p}_{a}" for p in ("left", "right") for a in _ATTRS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns[2:]), strict=True))
            sides = [(dict(zip(_ATTRS, r[:5], strict=True)), dict(zip(_ATTRS, r[5:], strict=True))) for r in rows]
            if threshold is None:
                keep, made = None, [pair_score(*x) for x in sides]
            else:
                scored = [(i, pair_score(*x)) for i, x in enumerate(sides) if can_reach(*x, threshold)]
                scored = [(i, m) for i, m in scored if m["score"] >= threshold]
                keep, made = pa.array([i for i, _ in scored], pa.int64()), [m for _, m in scored]
            ids = b.columns[:2] if keep is None else [c.take(keep) for c in b.columns[:2]]
            yield pa.RecordBatch.from_arrays([*ids, *(pa.array([m[s] for m in made], pa.float64()) for s in _SIGNALS)], ["left_id", "right_id", *(f"s_{s}" if s != "score" else s for s in _SIGNALS)])

    return j.mapInArrow(run, "left_id string, right_id string, " + ", ".join(f"{'s_' * (s != 'score')}{s} double" for s in _SIGNALS))


#: Fields of one range partition that are numbered together.
_RANGE = 50_000


def ordered_numbers(df: DataFrame, order: list[str], name: str = "rn", rows: int | None = None) -> DataFrame:
    """A running number in a total order, without a single-task window over the
    rows: ranges are numbered by themselves and shifted by the ranges' counts."""
    r = rows if rows is not None else df.count()
    parts = max(1, math.ceil(r / _RANGE))
    p = spool(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()))
    p = p.withColumn("__p", F.shiftright("__m", 33)).withColumn("__i", F.col("__m").bitwiseAND((1 << 33) - 1))
    n = p.groupBy("__p").agg(F.count("*").alias("n"))
    before = n.select("__p", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"))  # one row per range
    return p.join(F.broadcast(before), "__p").withColumn(name, F.col("b") + F.col("__i") + 1).drop("__m", "__p", "__i", "b")


def neighbour_pairs(df: DataFrame, key: str, order: list[str], k: int, within: str | None = None) -> DataFrame:
    """Directed pairs (source, candidate) of rows at most k places apart in an
    order: an equi-join on blocks of k + 1 places and the block after. `within`, a
    column without nulls: each of its values has an order of its own."""
    by = [within] if within else []
    order = [*by, *order]
    n = ordered_numbers(df.select(key, *[c for c in order if c != key]), order).select(F.col(key).alias("id"), "rn", *by)
    block = F.floor(F.col("rn") / (k + 1))
    # rows of one value stand side by side, so places within it differ as in the whole
    a = n.select(F.col("id").alias("source"), F.col("rn").alias("r1"), block.alias("b"), *by)
    b = n.select(F.col("id").alias("candidate"), F.col("rn").alias("r2"), F.explode(F.array(block, block + 1)).alias("b"), *by)
    near = a.join(b, ["b", *by]).where((F.col("r2") < F.col("r1")) & (F.col("r1") - F.col("r2") <= k)).select("source", "candidate")
    return near.unionByName(near.select(F.col("candidate").alias("source"), F.col("source").alias("candidate")))


def rare_cap(n: int) -> int:
    """Greatest number of fields that share a token that still counts as rare."""
    return max(4, min(64, max(1, math.floor(0.05 * n))))


def rare_token_pairs(df: DataFrame, key: str, toks: str, cap: int | None = None, within: str | None = None) -> DataFrame:
    """Directed pairs that share a token that at most `cap` rows have: no token's
    block is larger than the cap, so the join's output is bounded by rows x cap.
    `within`, a column without nulls: pairs and counts are made within its values;
    without a cap, that of each value is rare_cap of its rows."""
    token = F.struct(within, F.col("t")) if within else F.col("t")
    t = df.select(F.col(key).alias("id"), *([within] if within else []), F.explode(toks).alias("t")).select("id", token.alias("t")).distinct()
    rare = t.groupBy("t").agg(F.count("*").alias("n")).where("n > 1")
    if cap is None and within:
        caps = df.groupBy(within).agg(F.greatest(F.lit(4), F.least(F.lit(64), F.floor(F.lit(0.05) * F.count("*")))).alias("cap"))
        rare = rare.withColumn(within, F.col(f"t.{within}")).join(caps, within).where("n <= cap").select("t")
    else:
        rare = rare.where(F.col("n") <= (rare_cap(df.count()) if cap is None else cap)).select("t")
    r = lookup_join(t, rare, "t", "left_semi", spread=F.col("id"))
    return r.select(F.col("id").alias("source"), "t").join(r.select(F.col("id").alias("candidate"), "t"), "t").where("source <> candidate").select("source", "candidate").distinct()


def scan(f: DataFrame, threshold: float = 0.72, most: int = 12, excluded: tuple[str, ...] = ("merged", "split", "deprecated"), limit_sources: int | None = None, namespace: str | None = None) -> DataFrame:
    """Similar pairs of a registry, each namespace by itself: neighbours in name
    order or sharers of tokens rare in the namespace, the nearest `most` per source
    by shared tokens, type and spelling, then scored with the smaller id left; pairs
    at or above the threshold. limit_sources: the first so many of a namespace."""
    f = f.where(F.col("namespace") == namespace) if namespace else f
    e = spool(f.where(~F.col("status").isin(*excluded)).withColumn("ns", F.coalesce("namespace", F.lit("global"))).withColumn("toks", name_tokens(F.concat_ws(" ", "key", "label"))).withColumn("cmp", _compacted("key")))
    near = neighbour_pairs(e, "id", ["normalized_key", "key", "id"], most, "ns")
    d = near.unionByName(rare_token_pairs(e, "id", "toks", within="ns")).distinct()
    if limit_sources is not None:
        o = ordered_numbers(e.select("ns", "id", "normalized_key", "key"), ["ns", "normalized_key", "key", "id"])
        o = o.join(o.groupBy("ns").agg(F.min("rn").alias("first")), "ns").where(F.col("rn") - F.col("first") < limit_sources)
        d = d.join(o.select(F.col("id").alias("source")), "source", "left_semi")
    s = d.join(e.select(F.col("id").alias("source"), F.col("toks").alias("t1"), F.col("value_type").alias("v1"), F.col("cmp").alias("c1")), "source")
    s = s.join(e.select(F.col("id").alias("candidate"), F.col("toks").alias("t2"), F.col("value_type").alias("v2"), F.col("cmp").alias("c2")), "candidate")
    ratio = pandas_udf(lambda a, b: pd.Series([char_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype=float), T.DoubleType())
    shared = F.size(F.array_intersect("t1", "t2")) + ((F.substring("c1", 1, 4) == F.substring("c2", 1, 4)) & (F.col("c1") != "")).cast("int")
    s = s.select("source", "candidate", shared.alias("shared"), (F.col("v1") == F.col("v2")).alias("same"), "c1", "c2")
    # spelling decides among equals only: those surely behind the first `most` need no ratio
    s = s.withColumn("r0", F.rank().over(Window.partitionBy("source").orderBy(F.desc("shared"), F.desc("same")))).where(F.col("r0") <= most)
    s = s.select("source", "candidate", "shared", "same", ratio("c1", "c2").alias("ratio"))
    w = Window.partitionBy("source").orderBy(F.desc("shared"), F.desc("same"), F.desc("ratio"), F.desc("candidate"))
    top = s.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    pairs = top.select(F.least("source", "candidate").alias("left_id"), F.greatest("source", "candidate").alias("right_id")).distinct()
    return score_pairs(pairs, e, threshold)


#: Fields and proposals that are compared in one step of score_proposals; proposals
#: whose bounds are held at once.
_FIELDS, _PROPOSALS, _AT_ONCE = 30_000, 1_000, 32
#: Each chunk of proposals takes a copy of its namespace's fields, so beyond that many
#: chunks they grow, to eight times their size.
_PARTS = 4
_TEXTS = ("key", "label", "description")
#: Copies of a character that are told apart in bounds; characters compared in order.
_LEVELS, _FIRST = 7, 63


class _Texts:
    """Upper bounds of _text_score of many texts, each of them once, with other ones."""

    def __init__(self, texts: list[str | None]):
        at: dict[tuple, int] = {}
        self.place = np.array([at.setdefault(_parts(t), len(at)) for t in texts])
        parts = list(at)
        with_token: dict[str, list[int]] = {}
        for n, (toks, _) in enumerate(parts):
            for x in toks:
                with_token.setdefault(x, []).append(n)
        self.with_token = {x: np.array(v) for x, v in with_token.items()}
        self.n_tokens = np.array([len(x) for x, _ in parts])
        self.length = np.array([len(c) for _, c in parts], np.float32)
        self.levels = _levels([c for _, c in parts])
        self.alphabet: dict[str, int] = {}
        self.codes = np.zeros((len(parts), min(_FIRST, int(self.length.max(initial=0)))), np.int32)
        for n, (_, c) in enumerate(parts):
            self.codes[n, : len(c)] = [self.alphabet.setdefault(x, len(self.alphabet) + 1) for x in c[:_FIRST]]

    def words(self, t: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Places of the texts with a common word, or without words like t, and the share of words."""
        toks = _parts(t)[0]
        if not toks:
            at = np.flatnonzero(self.n_tokens == 0)
            return at, np.ones(len(at))
        found = [self.with_token[x] for x in toks if x in self.with_token]
        at, shared = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, int), np.zeros(0))
        return at, shared / (self.n_tokens[at] + len(toks) - shared)

    def __call__(self, others: list[str | None]) -> np.ndarray:
        """Of the characters at most the common ones match; classes only raise that."""
        texts = [_parts(t)[1] for t in others]
        length = np.array([len(c) for c in texts], np.float32)
        out = _levels(texts) @ self.levels.T
        np.minimum(out, np.minimum.outer(length, self.length), out=out)
        both = np.add.outer(length, self.length)
        out *= np.float32(2 * CHAR_FACTOR)
        out /= np.maximum(both, 1)
        out[both == 0] = CHAR_FACTOR
        for row, t in zip(out, others, strict=True):
            at, share = self.words(t)
            row[at] = np.maximum(row[at], share)
        return out[:, self.place]

    def in_order(self, t: str | None, chosen: np.ndarray) -> np.ndarray:
        """A closer bound for some rows: matches are a common subsequence."""
        text, at = _parts(t)[1], self.place[chosen]
        masks = np.zeros(len(self.alphabet) + 1, np.uint64)
        for n, x in enumerate(text[:_FIRST]):
            if x in self.alphabet:
                masks[self.alphabet[x]] |= np.uint64(1 << n)
        v = np.full(len(at), 2**64 - 1, np.uint64)
        for m in masks[self.codes[at]].T:
            u = v & m
            v = (v + u) | (v - u)
        m = min(len(text), _FIRST)
        common = m - np.bitwise_count(v & np.uint64((1 << m) - 1)).astype(int) + np.maximum(self.length[at] - _FIRST, 0) + max(len(text) - _FIRST, 0)
        both = self.length[at] + len(text)
        score = CHAR_FACTOR * np.where(both > 0, 2 * common / np.maximum(both, 1), 1.0)
        places, share = self.words(t)
        words = np.zeros(len(self.length))
        words[places] = share
        return np.maximum(score, words[at])


class _Bounds:
    """Upper bounds of pair_score of proposals with each of many fields of their namespace."""

    def __init__(self, rows: list[dict]):
        self.type = np.array([_norm(r["value_type"]) for r in rows], dtype=object)
        self.texts = {k: _Texts([r[k] for r in rows]) for k in _TEXTS}

    def __call__(self, proposals: list[dict]) -> np.ndarray:
        return self._score(np.stack([self.type == _norm(p["value_type"]) for p in proposals]), {k: self.texts[k]([p[k] for p in proposals]) for k in _TEXTS})

    def closer(self, p: dict, chosen: np.ndarray) -> np.ndarray:
        return self._score(self.type[chosen] == _norm(p["value_type"]), {k: self.texts[k].in_order(p[k], chosen) for k in _TEXTS})

    @staticmethod
    def _score(same: np.ndarray, texts: dict[str, np.ndarray]) -> np.ndarray:
        total = sum(np.float32(WEIGHTS[k]) * x for k, x in texts.items()) + np.float32(WEIGHTS["namespace"])
        # what rounding to 6 places and single precision may lack
        return np.where(same, total + np.float32(WEIGHTS["type"]), total * np.float32(TYPE_PENALTY)) + np.float32(5e-6)


def _best(p: dict, rows: list[dict], bounds: _Bounds, bound: np.ndarray, top_k: int) -> list[tuple[float, str]]:
    """The top_k (score, id) of one proposal: fields are scored in the order of their
    bounds until no further one can be among the best."""
    best: list[tuple[float, str]] = []

    def score(order: np.ndarray, by: np.ndarray) -> None:
        for i, most in zip(order.tolist(), by.tolist(), strict=True):
            if len(best) >= top_k and most < best[0][0]:
                break
            s = pair_score(p, rows[i])["score"]
            for x in rows[i]["ids"]:
                (heapq.heappush if len(best) < top_k else heapq.heappushpop)(best, (s, x))

    def closest(chosen: np.ndarray) -> None:
        by = bounds.closer(p, chosen)
        o = np.argsort(-by, kind="stable")
        score(chosen[o], by[o])

    # those with the highest bounds first: they tell how high the others must come
    first = np.argpartition(-bound, 4 * top_k)[: 4 * top_k] if len(bound) > 8 * top_k else np.arange(len(bound))
    closest(first)
    if len(first) < len(bound):
        rest = bound >= best[0][0] if len(best) >= top_k else np.ones(len(bound), bool)
        rest[first] = False
        closest(np.flatnonzero(rest))
    return best


def _norm(s: str | None) -> str:
    return unicodedata.normalize("NFKC", s or "").strip().lower()


def _levels(texts: list[str]) -> np.ndarray:
    """Vectors whose products are at least the number of common characters, by class;
    Latin letters and digits have one each. A column says whether a text has a
    character once, twice and so on; the last one of a class has the further copies."""
    counts = np.zeros((len(texts), 75), np.int32)
    for n, t in enumerate(texts):
        if t:
            counts[n] = np.bincount([ord(c) % 75 for c in t], minlength=75)
    return np.concatenate([*((counts > x).astype(np.float32) for x in range(_LEVELS)), np.maximum(counts - _LEVELS, 0).astype(np.float32)], 1)


def score_proposals(f: DataFrame, proposals: DataFrame, top_k: int = 10, excluded: tuple[str, ...] = ("merged", "split", "deprecated")) -> DataFrame:
    """The best top_k fields of each proposal (id and the fields' attributes) among
    all eligible fields of its namespace: proposal_id, field_id, score, proposal left.

    Proposals with equal attributes are scored once, and so are fields: of those equal
    ones the top_k greatest ids are all that can be among the best. Blocks of fields
    meet chunks of proposals; in a block the fields are scored in the order of an
    upper bound until no further one can be among the best."""
    spark = f.sparkSession
    ship(spark)
    ns = F.coalesce(F.nullif("namespace", F.lit("")), F.lit("global")).alias("ns")
    same = F.sha2(F.to_json(F.struct(*_ATTRS)), 256).alias("same")
    asked = proposals.select("id", ns, same, *_ATTRS)
    one = asked.groupBy("same").agg(*[F.min(c).alias(c) for c in ("ns", *_ATTRS)])
    of_same = Window.partitionBy("same").orderBy(F.desc("id"))
    known = f.where(~F.col("status").isin(*excluded)).select("id", ns, same, *_ATTRS).withColumn("r", F.row_number().over(of_same)).where(F.col("r") <= top_k)
    known = known.groupBy("same").agg(F.collect_list("id").alias("ids"), *[F.min(c).alias(c) for c in ("ns", *_ATTRS)])
    one, known = spool(one), spool(known)

    def parts_of(df: DataFrame, rows: int, name: str) -> DataFrame:
        n = F.count("*")
        return df.groupBy("ns").agg(F.least(F.ceil(n / rows), F.greatest(F.lit(_PARTS), F.ceil(n / (8 * rows)))).alias(name) if rows == _PROPOSALS else F.ceil(n / rows).alias(name))

    def packed(df: DataFrame, own: str, rows: int, name: str) -> DataFrame:
        df = df.select("ns", "same", F.struct(own, *_ATTRS).alias("x"))
        return df.join(F.broadcast(parts_of(df, rows, "parts")), "ns").groupBy("ns", F.pmod(F.xxhash64("same"), "parts").alias(f"{name}_part")).agg(F.collect_list("x").alias(name))

    steps = parts_of(one, _PROPOSALS, "p").join(parts_of(known, _FIELDS, "q"), "ns").agg(F.sum(F.col("p") * F.col("q"))).first()[0] or 0
    both = packed(one, "same", _PROPOSALS, "proposals").join(packed(known, "ids", _FIELDS, "fields"), "ns")
    # few steps a partition: an Arrow batch holds a partition's blocks
    parts = max(24, int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(steps / 4))
    both = both.repartition(parts, "ns", "proposals_part", "fields_part").select("proposals", "fields")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n in range(b.num_rows):
                asked, rows, out = b.column(0)[n].as_py(), b.column(1)[n].as_py(), []
                bounds = _Bounds(rows)
                for k in range(0, len(asked), _AT_ONCE):
                    some = asked[k : k + _AT_ONCE]
                    for p, bound in zip(some, bounds(some), strict=True):
                        out += [(p["same"], i, s) for s, i in _best(p, rows, bounds, bound, top_k)]
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.float64()))], ["same", "field_id", "score"])

    found = both.mapInArrow(run, "same string, field_id string, score double")
    w = Window.partitionBy("same").orderBy(F.desc("score"), F.desc("field_id"))
    top = found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top_k).drop("r")
    return asked.select(F.col("id").alias("proposal_id"), "same").join(top, "same").select("proposal_id", "field_id", "score")


def score_against(f: DataFrame, proposal: dict, top_k: int = 10) -> DataFrame:
    """The best top_k fields of one proposal: field_id, score."""
    p = f.sparkSession.createDataFrame([("", *(proposal[a] for a in _ATTRS))], ", ".join(f"{c} string" for c in ("id", *_ATTRS)))
    return score_proposals(f, p, top_k).select("field_id", "score").orderBy(F.desc("score"), F.desc("field_id"))


def families(f: DataFrame, pairs: DataFrame, seed: float = 0.78, coherence: float = 0.72, most: int = 8) -> DataFrame:
    """Complete-link groups: from each seed field, its neighbours of the same type
    at or above `seed`, best first, joining while their score with every member is
    at least `coherence`. Equal member sets once, under the smallest seed key.
    Columns: seed_id, members (sorted ids), min_score, n_members.

    All neighbours of a seed are walked until `most` members are taken. A hub that
    many sources chose has more than the scan's `most`, but only fields of its
    windows and its rare tokens: under 2 * 12 and 64 a token for the scan's own
    pairs. Scores that the pairs lack are worked out where they are needed."""
    ship(f.sparkSession)
    both = pairs.select(F.col("left_id").alias("a"), F.col("right_id").alias("b"), "score").unionByName(pairs.select(F.col("right_id").alias("a"), F.col("left_id").alias("b"), "score")).where(F.col("score") >= seed)
    attrs = f.select("id", *_ATTRS)
    n = both.join(attrs.select(F.col("id").alias("a"), F.col("value_type").alias("ta"), F.col("namespace").alias("na")), "a").join(attrs.withColumnRenamed("id", "b"), "b").where("ta = value_type and na = namespace")
    w = Window.partitionBy("a").orderBy(F.desc("score"), F.desc("b"))
    near = n.withColumn("r", F.row_number().over(w))
    grouped = near.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("r", "b", "score", *_ATTRS))).alias("near"))
    seeds = grouped.join(attrs.withColumnRenamed("id", "a"), "a")

    def grow(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in frames:
            out = []
            for row in p.to_dict("records"):
                me = {k: row[k] for k in _ATTRS} | {"id": row["a"]}
                members, low = [me], 1.0
                for c in row["near"]:
                    if len(members) >= most:
                        break
                    c = dict(c) if isinstance(c, dict) else c.asDict()
                    other = {k: c[k] for k in _ATTRS} | {"id": c["b"]}
                    both = [sorted((m, other), key=lambda x: x["id"]) for m in members]
                    if not all(can_reach(*x, coherence) for x in both):
                        continue
                    scores = [pair_score(*x)["score"] for x in both]
                    if min(scores) >= coherence:
                        members.append(other)
                        low = min(low, *scores)
                if len(members) > 1:
                    out.append((row["a"], row["key"], sorted(m["id"] for m in members), low))
            yield pd.DataFrame(out, columns=["seed_id", "seed_key", "members", "min_score"])

    fam = seeds.mapInPandas(grow, "seed_id string, seed_key string, members array<string>, min_score double")
    one = fam.groupBy("members").agg(F.min(F.struct("seed_key", "seed_id", "min_score")).alias("s"))
    return one.select("s.seed_id", "members", "s.min_score", F.size("members").alias("n_members"))


def pair_metrics(scored: DataFrame, key: str, floor: float) -> DataFrame:
    """Least and mean score and number below the floor, per group of scored pairs."""
    return scored.groupBy(key).agg(F.min("score").alias("min_score"), (F.sum(F.col("score").cast("decimal(18,6)")).cast("double") / F.count("score")).alias("avg_score"), F.count_if(F.col("score") < floor).alias("n_conflicts"), F.count("*").alias("n_pairs"))

