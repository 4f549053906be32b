"""Freely typed values to the entries of a reference list.

Two set-similarity joins propose entries, both on rare prefixes only. In the first
the sets are words: a typed word stands for the words of the list that it may be a
writing of (found by a join on keys with a character left out), and of an entry's
words the rarest must be among them. Values that no entry's words explain, such as
words run together, go on as sets of consonant pairs: ordered by global rarity, rare
prefixes joined, length and position filters, Jaccard verified exactly. Of the
entries so found those whose words are the value's words are ranked and the best is
kept.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomcell.llm.skeleton import skeleton
from loomcell.runtime import lookup_join, ship, spool

#: Least Jaccard similarity of the consonant pairs of values that the words leave open.
SIMILARITY = 0.4
#: Words without meaning of their own (parameter of the matcher).
FILLERS = "a an the of for and my our new old tmp test copy draft final main misc field fields col column attr attribute value val data key name item entry prop property raw".split()

# Abbreviations in general use that neither cut a word nor drop its vowels.
ABBREVIATIONS = {
    "bw": "bandwidth", "ckpt": "checkpoint", "cp": "checkpoint", "dep": "dependency", "dir": "directory", "fb": "feedback",
    "fp": "fingerprint", "geo": "geometry", "ns": "namespace", "pct": "percentile", "pctl": "percentile", "rb": "rollback",
    "temp": "temporal", "ts": "timestamp", "wm": "watermark",
}

_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
_WORD = re.compile(r"[^\W_]+")
_VOWELS = re.compile(r"(?<!^)[aeiou]")


def words(text: str) -> list[str]:
    """A typed value's words: look-alikes folded, separators and inner capitals
    split, without case and accents."""
    flat = unicodedata.normalize("NFKC", skeleton(unicodedata.normalize("NFKC", text)))
    found = _WORD.findall(_CAMEL.sub(" ", flat))
    plain = ("".join(c for c in unicodedata.normalize("NFD", w.casefold()) if not unicodedata.combining(c)) for w in found)
    return [w for w in plain if w]


def pairs_of(ws: list[str]) -> list[str]:
    """The set of consonant pairs of the words (a word's first vowel counts as one):
    what is left of them however they are shortened, run together or without vowels."""
    bare = [_VOWELS.sub("", w) for w in ws]
    return sorted({b[i : i + 2] for b in bare for i in range(max(1, len(b) - 1))})


def slips(a: str, b: str, most: int) -> int:
    """Insertions, deletions, replacements and swaps of neighbours between two
    words, most + 1 if more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, last, row = row, before, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, last[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def _forms(w: str) -> tuple[str, ...]:
    more = (w[:-1] + "ies",) if w.endswith("y") else (w + "es",) if w.endswith(("s", "x", "ch", "sh")) else ()
    less = (w[:-1],) if w.endswith("s") and not w.endswith("ss") else ()
    return (w, w + "s", *more, *less)


#: Costs of the ways in which a word may be written; a slip in a plural adds up.
_EXACT, _PLURAL, _SLIP, _SHORT = 0, 1, 3, 4


#: Typed words with the words of the list that each is nearest to.
Readings = dict[str, frozenset[str]]


def word_cost(typed: str, word: str, read: Readings | None = None) -> int | None:
    """How far a typed word is from a word of the list, None if it is another: also
    if it is nearer to another word of the list, as read says."""
    if read and word not in read.get(typed, (word,)):
        return None
    if typed == word:
        return _EXACT
    forms = _forms(word)
    if typed in forms:
        return _PLURAL
    if ABBREVIATIONS.get(typed) == word:
        return _SHORT
    best = None
    if len(word) >= 4 and len(typed) >= 3:
        for k, f in enumerate(forms):
            if slips(typed, f, 1) <= 1:
                best = _SLIP + (k > 0)
                break
    if best is None and len(word) >= 5:
        bare = _VOWELS.sub("", word)
        if (len(typed) >= 4 and word.startswith(typed)) or typed in (bare, bare + "s") and len(typed) >= 3:
            best = _SHORT
        elif len(typed) >= 5 and slips(typed, word[: len(typed)], 1) <= 1 and typed[0] == word[0] and len(typed) <= len(word) - 2:
            best = _SHORT + _SLIP  # shortened with a slip
        elif len(typed) >= 4 and len(bare) >= 5 and slips(typed, bare, 1) <= 1:
            best = _SHORT + _SLIP
    return best


def word_keys(word: str) -> set[str]:
    """Keys of a word of the list: whatever word_cost takes for a writing of it has
    one of them among its own typed_keys."""
    keys = {w for f in _forms(word) for w in _less_one(f)}
    keys |= {a for a, w in ABBREVIATIONS.items() if w == word}
    bare = _VOWELS.sub("", word)
    if len(word) >= 5:
        keys |= {bare, bare + "s"} | (_less_one(bare) if len(bare) >= 5 else set())
        for n in range(4, len(word)):
            keys |= _less_one(word[:n]) if n >= 5 else {word[:n]}
    return keys


def typed_keys(word: str) -> set[str]:
    return _less_one(word) if len(word) > 2 else {word}


def _less_one(word: str) -> set[str]:
    """The word and the word without one of its characters."""
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}


class _Match:
    """Costs of one value against one entry. Parts of the entry are sets of its
    word numbers; every (place, part) is worked out once."""

    def __init__(self, typed: list[str], entry: list[str], read: Readings | None) -> None:
        self.typed, self.entry, self.read = typed, entry, read
        self.memo: dict[tuple, int | None] = {}

    def _choices(self, part: frozenset[int]) -> list[int]:
        """One number of each different word left."""
        seen: dict[str, int] = {}
        for i in sorted(part):
            seen.setdefault(self.entry[i], i)
        return list(seen.values())

    def assign(self, at: int, part: frozenset[int]) -> int | None:
        """Least cost of matching the typed words from a place on one to one."""
        if len(self.typed) - at != len(part):
            return None
        if not part:
            return 0
        key = ("a", at, part)
        if key not in self.memo:
            best = None
            for i in self._choices(part):
                c = word_cost(self.typed[at], self.entry[i], self.read)
                if c is not None:
                    rest = self.assign(at + 1, part - {i})
                    if rest is not None and (best is None or c + rest < best):
                        best = c + rest
            self.memo[key] = best
        return self.memo[key]

    def split(self, joined: str, part: frozenset[int]) -> int | None:
        """The same for words run together: cut off each word of the part in turn."""
        if not part:
            return 0 if not joined else None
        key = ("s", joined, part)
        if key not in self.memo:
            best = None
            for i in self._choices(part):
                w, rest_part = self.entry[i], part - {i}
                if not rest_part:
                    c = word_cost(joined, w, self.read)
                    if c is not None and (best is None or c < best):
                        best = c
                    continue
                for n in range(max(3, min(4, len(w) - 1)), min(len(w) + 2, len(joined)) + 1):
                    c = word_cost(joined[:n], w, self.read)
                    if c is not None and (best is None or c < best):
                        rest = self.split(joined[n:], rest_part)
                        if rest is not None and (best is None or c + rest < best):
                            best = c + rest
            self.memo[key] = best
        return self.memo[key]

    def partly_joined(self, at: int, part: frozenset[int]) -> int | None:
        """Some of the typed words are two or more words run together. A typed word
        takes as many words as its length allows: each has three characters at least."""
        left = len(self.typed) - at
        if not left:
            return 0 if not part else None
        if len(part) < left:
            return None
        key = ("p", at, part)
        if key not in self.memo:
            best = None
            most = min(len(part) - left + 1, max(1, len(self.typed[at]) // 3))
            for n in range(1, most + 1):
                for group in self._groups(at, part, n):
                    c = self.split(self.typed[at], group)
                    if c is not None and (best is None or c < best):
                        rest = self.partly_joined(at + 1, part - group)
                        if rest is not None and (best is None or c + rest < best):
                            best = c + rest
            self.memo[key] = best
        return self.memo[key]

    def _groups(self, at: int, part: frozenset[int], n: int) -> Iterator[frozenset[int]]:
        """Parts of n words whose lengths add up to about the typed word's."""
        for c in combinations(self._choices(part) if n == 1 else sorted(part), n):
            if n == 1 or len(self.typed[at]) <= sum(len(self.entry[i]) + 2 for i in c):
                yield frozenset(c)


def entry_cost(typed: list[str], entry: list[str], fillers: frozenset[str], read: Readings | None = None) -> int | None:
    """Cost at which a value means an entry, None if it doesn't.

    Fillers among the typed words may be dropped if the entry hasn't them."""
    own = set(entry)
    core = [w for w in typed if not (w in fillers and w not in own)]
    extra, n, every = len(typed) - len(core), len(entry), frozenset(range(len(entry)))
    best = None
    if len(core) == n:
        best = _Match(core, entry, read).assign(0, every)
    elif core and len(core) < n:
        m = _Match(core, entry, read)
        best = m.partly_joined(0, every)
        if best is None and len(core) == 1:  # a filler run together with the words
            for f in fillers:
                for cut in ((core[0].removeprefix(f),) if core[0].startswith(f) else ()) + ((core[0].removesuffix(f),) if core[0].endswith(f) else ()):
                    c = m.split(cut, every)
                    if c is not None and (best is None or c + 1 < best):
                        best = c + 1
    elif len(core) == n + 1:  # a separator inside a word
        for i in range(n):
            c = _Match([*core[:i], core[i] + core[i + 1], *core[i + 2 :]], entry, read).assign(0, every)
            if c is not None and (best is None or c + 1 < best):
                best = c + 1
    return None if best is None else best + extra


def _tokens(df: DataFrame, text: str) -> DataFrame:
    """Add `ws` (words) and `toks` (their consonant pairs)."""
    ship(df.sparkSession)
    at = df.columns.index(text)
    schema = T.StructType(list(df.schema.fields)).add("ws", T.ArrayType(T.StringType())).add("toks", T.ArrayType(T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ws = [words(s) for s in b.column(at).to_pylist()]
            toks = [pairs_of(x) for x in ws]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ws, pa.list_(pa.string())), pa.array(toks, pa.list_(pa.string()))], [*b.schema.names, "ws", "toks"])

    return df.mapInArrow(run, schema)


def similar(values: DataFrame, entries: DataFrame, similarity: float) -> DataFrame:
    """Prefix-filter join of two tables (block, id, toks), ids unique: pairs of
    one block with Jaccard >= similarity, as block, vid, eid, jaccard. Complete:
    the filters drop only pairs below it."""
    both = values.select("toks").unionByName(entries.select("toks"))
    rarity = both.select(F.explode("toks").alias("t")).groupBy("t").agg(F.count("*").alias("n"))

    def ordered(df: DataFrame) -> DataFrame:
        one = lookup_join(df.select("block", "id", F.explode("toks").alias("t")), rarity, "t", spread=F.col("id"))
        s = one.groupBy("block", "id").agg(F.sort_array(F.collect_list(F.struct("n", "t"))).alias("s"))  # as long as the value's text
        return s.select("block", "id", F.col("s.t").alias("toks")).withColumn("len", F.size("toks"))

    def prefix(df: DataFrame, side: str) -> DataFrame:
        keep = F.col("len") - F.ceil(F.col("len") * similarity).cast("int") + 1
        p = df.select("block", F.col("id").alias(f"{side}id"), F.col("len").alias(f"{side}len"), F.posexplode(F.slice("toks", F.lit(1), keep)).alias(f"{side}pos", "t"))
        return p

    v, e = spool(ordered(values)), spool(ordered(entries))
    left, right = (prefix(x, side).withColumn("k", F.struct("block", "t")).drop("t") for x, side in ((v, "v"), (e, "e")))
    # a pair may be frequent: the entries' prefixes go out by broadcast or salted
    m = lookup_join(left, right.drop("block"), "k", spread=F.col("vid"))
    need = F.ceil((F.col("vlen") + F.col("elen")) * (similarity / (1 + similarity)) - 1e-9)
    fits = (F.col("elen") >= F.col("vlen") * similarity) & (F.col("vlen") >= F.col("elen") * similarity)
    near = 1 + F.least(F.col("vlen") - F.col("vpos"), F.col("elen") - F.col("epos")) - 1 >= need
    first = m.where(fits).groupBy("block", "vid", "eid").agg(F.min(F.struct("vpos", "epos", "vlen", "elen")).alias("f"))
    cand = first.select("block", "vid", "eid", "f.*").where(near).select("block", "vid", "eid")
    full = cand.join(v.select("block", F.col("id").alias("vid"), F.col("toks").alias("vt")), ["block", "vid"]).join(e.select("block", F.col("id").alias("eid"), F.col("toks").alias("et")), ["block", "eid"])
    both_n = F.size(F.array_intersect("vt", "et"))
    j = full.withColumn("jaccard", both_n / (F.size("vt") + F.size("et") - both_n))
    return j.where(F.col("jaccard") >= similarity).select("block", "vid", "eid", "jaccard")


def readings(words_: DataFrame, listed: DataFrame) -> DataFrame:
    """Distinct typed words (w) and words of the list (w): each typed word with the
    nearest words of the list that it may be a writing of, as w, to (sorted); words
    with none have no row. Complete: the join is on keys that every writing shares."""

    def keyed(df: DataFrame, keys: Callable[[str], set[str]], name: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                made = [(w, k) for w in b.column(0).to_pylist() for k in sorted(keys(w))]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in made], pa.string()) for i in (0, 1)], [name, "k"])

        return df.select("w").mapInArrow(run, f"{name} string, k string")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for w, near in zip(*(c.to_pylist() for c in b.columns), strict=True):
                # of words cut off alike the one that lacks the fewest letters is nearest
                costs = {x: (c, abs(len(x) - len(w)) if c >= _SHORT else 0) for x in near if (c := word_cost(w, x)) is not None}
                if costs:
                    rows.append((w, sorted(x for x, c in costs.items() if c == min(costs.values()))))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.string()))], ["w", "to"])

    # words longer than a sentence are no words; their keys would be many
    near = keyed(words_.where(F.length("w") <= LONGEST_WORD), typed_keys, "w").join(keyed(listed, word_keys, "x"), "k")
    near = near.groupBy("w").agg(F.collect_set("x").alias("near"))  # words of the list within two slips of one word
    return near.mapInArrow(check, "w string, to array<string>")


#: A typed word of more characters is compared by its consonant pairs only.
LONGEST_WORD = 64


def match(values: DataFrame, entries: DataFrame, similarity: float = SIMILARITY, fillers: list[str] | None = None) -> DataFrame:
    """values (block, id, text) against entries (block, target, text); one row per
    value id: id, target (null if it means none), cost, jaccard (of the consonant
    pairs), n_targets.

    Equal texts of one block are matched once, so skewed values cost nothing. A
    value whose best entries of equal cost belong to different targets is decided
    by the higher Jaccard, then by the smaller target. Null and empty values mean
    none; null or empty entries mean nothing. Copies of a value id count once. What
    is written word by word, however short, is never lost; words run together are
    found from the similarity on.
    """
    fillers = FILLERS if fillers is None else fillers
    drop = frozenset(fillers)
    vals = values.select("block", "id", F.coalesce("text", F.lit("")).alias("text")).where("id is not null").distinct()
    keyed = vals.withColumn("k", F.sha2(F.concat_ws("\x1f", F.coalesce("block", F.lit("")), "text"), 256))
    v = spool(_tokens(keyed.groupBy("k").agg(F.max("block").alias("block"), F.max("text").alias("text")).select("block", F.col("k").alias("id"), "text"), "text").drop("text"))
    e = entries.where("block is not null and text is not null and target is not null").select("block", "target", "text").distinct()
    e = spool(_tokens(e.select("block", F.sha2(F.concat_ws("\x1f", "block", "target", "text"), 256).alias("id"), "target", "text"), "text").where("size(ws) > 0").drop("text"))
    listed = e.select(F.explode("ws").alias("w")).distinct()

    # the words of a value as words of the list
    typed = v.where("block is not null").select("block", "id", F.posexplode("ws").alias("at", "w"))
    read = lookup_join(typed, spool(readings(typed.select("w").distinct(), listed)), "w", "left", spread=F.col("id"))
    filler = F.col("w").isin(fillers)
    # a word that is neither read nor a filler leaves the value to the second join
    per = read.groupBy("block", "id").agg(F.array_distinct(F.flatten(F.collect_list("to"))).alias("read"), F.sum(F.when(filler, 0).otherwise(1)).alias("least"), F.count("*").alias("most"),
                                          F.bool_and(F.col("to").isNotNull() | filler).alias("whole"), F.collect_set(F.when(F.col("to").isNotNull(), F.struct("w", "to"))).alias("known"))  # as long as the value's text
    per = spool(per)
    rarity = per.select(F.explode("read").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    words_ = e.select("id", F.explode("ws").alias("w"))
    rarest = lookup_join(words_, rarity, "w", spread=F.col("id")).groupBy("id").agg(F.min(F.struct("n", "w")).alias("r")).select("id", F.col("r.w").alias("w"))
    heads = e.join(rarest, "id").select(F.struct("block", "w").alias("key"), "target", F.col("ws").alias("ew"), F.col("toks").alias("et"))
    probe = per.where("whole").select("block", F.explode("read").alias("w"), "id", "read", "least", "most", "known")
    probe = probe.withColumn("key", F.struct("block", "w")).drop("block", "w")
    c = lookup_join(probe, heads, "key", spread=F.col("id")).where((F.size("ew") >= F.col("least")) & (F.size("ew") <= F.col("most")) & (F.size(F.array_except("ew", "read")) == 0))
    c = c.join(v.select("id", F.col("ws").alias("vw"), F.col("toks").alias("vt")), "id")
    both = F.size(F.array_intersect("vt", "et"))
    c = c.select(F.col("id").alias("vid"), "target", (both / (F.size("vt") + F.size("et") - both)).alias("jaccard"), "vw", "ew", "known")

    def cost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [entry_cost(t, w, drop, {x["w"]: frozenset(x["to"]) for x in k or ()}) for t, w, k in zip(*(x.to_pylist() for x in b.columns[3:]), strict=True)]
            out = pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(made, pa.int32())], ["vid", "target", "jaccard", "cost"])
            yield out.filter(out.column(3).is_valid())

    found = "vid string, target string, jaccard double, cost int"
    by_words = spool(c.mapInArrow(cost, found))

    # the rest by their consonant pairs
    rest = spool(v.join(by_words.select(F.col("vid").alias("id")).distinct(), "id", "left_anti"))
    pairs = similar(rest, e, similarity)
    p = pairs.join(rest.select(F.col("id").alias("vid"), F.col("ws").alias("vw")), "vid").join(e.select(F.col("id").alias("eid"), "target", F.col("ws").alias("ew")), "eid")
    p = p.join(per.select(F.col("id").alias("vid"), "known"), "vid", "left").select("vid", "target", "jaccard", "vw", "ew", "known")
    ok = by_words.unionByName(spool(p.mapInArrow(cost, found)))
    best = ok.groupBy("vid").agg(F.min(F.struct("cost", (-F.col("jaccard")).alias("far"), "target")).alias("b"), F.count_distinct("target").alias("n_targets"))
    best = best.select(F.col("vid").alias("k"), "b.target", "b.cost", (-F.col("b.far")).alias("jaccard"), "n_targets")
    return lookup_join(keyed.select("k", "id"), best, "k", "left", spread=F.col("id")).drop("k")
