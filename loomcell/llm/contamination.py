"""Evaluation items in training documents: latent semantic retrieval.

Documents are cut into passages; a distributed randomised SVD of their TF-IDF
matrix gives a latent space; passages near an item's passage by cosine are
candidates, which are then checked on the units themselves: a common run for
copies, the longest common subsequence and the item's rarest units for paraphrases.

Copies are found without loss: a document's passages stand side by side and an
item's overlap at every offset, so a run of two passages' length holds a whole
passage that is unit for unit one of the item's. Both have the same TF-IDF vector,
hence the same latent vector and cosine 1.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomcell.runtime import ship, spool

#: Hashed features, latent dimensions, extra directions of the range finder.
FEATURES, RANK, EXTRA, SEED = 1 << 16, 32, 8, 7
#: Units of a passage and of a common run that counts as a leak.
PASSAGE, RUN = 8, 16
#: Item passages searched for at once; more items are taken in blocks.
BLOCK = 60_000
#: Least cosine of a copy's passage (1 but for rounding).
SAME = 0.999
_BITS, _EDGE, _SLACK = 28, 1e-7, 1e-9

_ASCII = re.compile(r"[a-z0-9]+")


@cache
def _pattern() -> regex.Pattern:
    return regex.compile(r"\p{Han}|[^\W_\p{Han}]+")


class _Unseen(dict):
    def __missing__(self, code: int) -> int | None:
        unseen = unicodedata.category(chr(code)) == "Cf"
        self[code] = v = None if unseen else code
        return v


_UNSEEN = _Unseen()


def units(text: str) -> list[str]:
    """Each Han character, and each other unbroken run of letters and digits, after
    NFKC, without invisible characters and without case."""
    if text.isascii():
        return _ASCII.findall(text.lower())
    return _pattern().findall(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).translate(_UNSEEN).casefold()))


class _Hashes(dict):
    """Hashes of the units seen, forgotten as a whole when they are many."""

    def __missing__(self, unit: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[unit] = h = xxhash.xxh3_64_intdigest(unit)
        return h


_HASHES = _Hashes()


def hashed(text: str | None) -> np.ndarray:
    """The units as 64-bit hashes."""
    if not text:
        return np.empty(0, np.int64)
    return np.array([_HASHES[u] for u in units(text)], np.uint64).view(np.int64)


def unit_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """df as key `id` and `u`, the array of its text's hashed units."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [hashed(s) for s in b.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in made])]).astype(np.int32)
            values = np.concatenate([np.empty(0, np.int64), *made])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["id", "u"])

    return df.select(F.col(key).alias("id"), text).where("id is not null").mapInArrow(run, f"id {dict(df.dtypes)[key]}, u array<bigint>")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All units of a batch, and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.asarray(column.offsets)
    return np.asarray(column.values)[offsets[0] : offsets[-1]], offsets - offsets[0]


def cut(flat: np.ndarray, offsets: np.ndarray, size: int, stride: int, rest: str = "") -> tuple[np.ndarray, np.ndarray]:
    """Passages of equal size: their row numbers and a matrix of units. With `rest`,
    every unit is in some passage: units after a row's last passage give one more,
    filled up with zeros ("fill") or reaching back from the row's end ("back");
    rows shorter than a passage give one filled up."""
    lengths = np.diff(offsets)
    n = np.maximum(0, (lengths - size) // stride + 1)
    rows = np.repeat(np.arange(len(n)), n)
    starts = offsets[:-1][rows] + (np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)) * stride
    end = np.where(n > 0, (n - 1) * stride + size, 0)  # of the last passage
    if rest == "back":
        late = np.flatnonzero((n > 0) & (end < lengths))
        rows, starts = np.concatenate([rows, late]), np.concatenate([starts, offsets[1:][late] - size])
    m = flat[starts[:, None] + np.arange(size)] if len(starts) else np.empty((0, size), np.int64)
    if rest:
        short = np.flatnonzero((end < lengths) & ((n == 0) | (rest == "fill")))
        extra = np.zeros((len(short), size), np.int64)
        for i, r in enumerate(short):
            tail = flat[offsets[r] + end[r] : offsets[r + 1]]
            extra[i, : len(tail)] = tail
        rows, m = np.concatenate([rows, short]), np.concatenate([m, extra])
    return rows, m


def _features(m: np.ndarray) -> np.ndarray:
    return (m & (FEATURES - 1)).astype(np.int32)


_CHUNK = 8192


def _weights(f: np.ndarray, m: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights of a passage's units, of length 1; the filling weighs 0."""
    w = np.where(m == 0, 0.0, idf[f])
    norm = np.sqrt((w * w).sum(1))
    return w / np.where(norm > 0, norm, 1)[:, None]


def _project(m: np.ndarray, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """TF-IDF passages times a basis, in double precision."""
    out = np.empty((len(m), basis.shape[1]))
    for i in range(0, len(m), _CHUNK):
        part = m[i : i + _CHUNK]
        f = _features(part)
        w = _weights(f, part, idf)
        out[i : i + _CHUNK] = np.einsum("pu,puk->pk", w, basis[f])
    return out


def _per_feature(df: DataFrame, width: int, work: Callable[[np.ndarray, np.ndarray], None]) -> np.ndarray:
    """Sum over all partitions of a FEATURES x width matrix that each partition
    adds up by itself: at most FEATURES rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES, width))
        for b in batches:
            flat, offsets = _flat(b.column(0))
            work(total, cut(flat, offsets, PASSAGE, PASSAGE, "fill")[1])
        used = np.flatnonzero(total.any(1))
        for i in range(0, len(used), _CHUNK):
            part = used[i : i + _CHUNK]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *(pa.array(total[part, c]) for c in range(width))], ["f", *(f"c{c}" for c in range(width))])

    cols = [f"c{c}" for c in range(width)]
    # a matrix per core, not per split of the table: what is shuffled doesn't grow with the data
    parts = df.select("u").coalesce(df.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "f int, " + ", ".join(f"{c} double" for c in cols))
    t = parts.groupBy("f").agg(*[F.sum(c).alias(c) for c in cols]).toArrow()
    out = np.zeros((FEATURES, width))
    out[np.asarray(t["f"])] = np.column_stack([np.asarray(t[c]) for c in cols])
    return out


def _idf(docs: DataFrame) -> np.ndarray:
    """Inverse passage frequencies of the hashed features, over all documents."""

    def work(total: np.ndarray, m: np.ndarray) -> None:
        f = np.sort(np.where(m == 0, -1, _features(m)), 1)
        once = f >= 0  # the filling is no unit
        once[:, 1:] &= f[:, 1:] != f[:, :-1]
        total[:, 0] += np.bincount(f[once], minlength=FEATURES)
        total[0, 1] += len(m)

    t = _per_feature(docs, 2, work)
    return np.log((1 + t[0, 1]) / (1 + t[:, 0])) + 1


def fit(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Inverse frequencies and the latent basis (FEATURES x RANK) of all passages.

    Randomised SVD with one power step: two passes apply the passages' TF-IDF
    matrix A and its transpose; the driver keeps FEATURES x (RANK + EXTRA) numbers,
    whatever the number of documents."""
    idf = _idf(docs)
    sc = docs.sparkSession.sparkContext

    def gram(basis: np.ndarray) -> np.ndarray:
        shared = sc.broadcast((idf, basis))

        def work(total: np.ndarray, m: np.ndarray) -> None:
            idf_, basis_ = shared.value
            for i in range(0, len(m), _CHUNK):
                part = m[i : i + _CHUNK]
                f = _features(part)
                w = _weights(f, part, idf_)
                y = np.einsum("pu,puk->pk", w, basis_[f])
                flat = f.ravel()
                for k in range(basis_.shape[1]):
                    total[:, k] += np.bincount(flat, (w * y[:, k : k + 1]).ravel(), FEATURES)

        z = _per_feature(docs, basis.shape[1], work)
        shared.unpersist()
        return z

    start = np.random.default_rng(SEED).standard_normal((FEATURES, RANK + EXTRA))
    q, _ = np.linalg.qr(gram(start))
    z = gram(q)
    small = q.T @ z
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(values)[::-1][:RANK]
    return idf, q @ vectors[:, order]


def _unit_length(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1))
    return x / np.where(norm > 0, norm, 1)[:, None]


def _codes(x: np.ndarray) -> np.ndarray:
    """A bit per dimension: above the edge or not. The edge lies off zero, where
    dimensions that a small corpus doesn't fill put all their rounding noise."""
    return ((x[:, :_BITS] > _EDGE) @ (1 << np.arange(_BITS))).astype(np.int64)


class _Index:
    """An item block's latent passages in buckets by the signs of their first
    dimensions; a value within rounding of the edge stands in both buckets, so a
    vector equal but for rounding always looks where it is found."""

    def __init__(self, vectors: np.ndarray, passage_of: np.ndarray, items: np.ndarray) -> None:
        near = np.abs(vectors[:, :_BITS] - _EDGE) < _SLACK
        codes, at = _codes(vectors), np.arange(len(vectors))
        for d in range(_BITS):
            both = near[at, d]
            codes, at = np.concatenate([codes, codes[both] ^ (1 << d)]), np.concatenate([at, at[both]])
        order = np.argsort(codes, kind="stable")
        self.codes, self.at, self.vectors = codes[order], at[order], vectors
        # the items of each passage: equal ones, as of a standing instruction, stand here once
        by = np.argsort(passage_of, kind="stable")
        self.items, self.starts = items[by], np.searchsorted(passage_of[by], np.arange(len(vectors) + 1))

    def near(self, x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(row of x, item) of all pairs in one bucket with at least that cosine. Equal
        passages are compared once, then stand for all their items."""
        c = _codes(x)
        lo, hi = np.searchsorted(self.codes, c), np.searchsorted(self.codes, c, "right")
        n = hi - lo
        rows = np.repeat(np.arange(len(x)), n)
        at = self.at[np.repeat(lo, n) + np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)]
        keep = np.empty(len(rows), bool)
        for i in range(0, len(rows), _CHUNK * 8):
            s = slice(i, i + _CHUNK * 8)
            a, b = x[rows[s]], self.vectors[at[s]]
            keep[s] = ((a * b).sum(1) >= least) | (~a.any(1) & ~b.any(1))
        rows, at = rows[keep], at[keep]
        n = self.starts[at + 1] - self.starts[at]
        out = np.repeat(self.starts[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(rows, n), self.items[out]


def runs_of(u: np.ndarray, n: int) -> set[bytes]:
    return {u[i : i + n].tobytes() for i in range(len(u) - n + 1)}


def _item_blocks(items: DataFrame, size: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """The stated query set in blocks of at most BLOCK passages (one item at least)."""
    ids: list = []
    us: list[np.ndarray] = []
    n = 0
    for r in items.toLocalIterator():
        u = np.array(r["u"], np.int64)
        if ids and n + len(u) > BLOCK:
            yield ids, us
            ids, us, n = [], [], 0
        ids.append(r["id"])
        us.append(u)
        n += max(1, len(u) - size + 1)
    if ids:
        yield ids, us


def _search(docs: DataFrame, items: DataFrame, item_size: int, make: Callable, schema: str) -> DataFrame | None:
    """One pass over the documents per block of items, united."""
    sc = docs.sparkSession.sparkContext
    out = None
    for ids, us in _item_blocks(items, item_size):
        part = docs.mapInArrow(make(sc.broadcast((ids, us))), schema)
        out = part if out is None else out.unionByName(part)
    return out


def leaked_runs(documents: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, run: int = RUN) -> DataFrame:
    """Pairs of a document and an item that share a run of at least `run`
    consecutive units: doc id, item id, once each.

    Texts are taken whole. Null and empty texts share nothing, nor do items shorter
    than the run. Copies of a document or an item under one id count once."""
    assert run >= 2 * PASSAGE - 1, "a run must hold a whole passage"
    docs = spool(unit_rows(documents, key, text))
    idf, basis = fit(docs)
    q = unit_rows(items, item_key, item_text).where(F.size("u") >= run).distinct()
    model = docs.sparkSession.sparkContext.broadcast((idf, basis))
    dtype, itype = dict(documents.dtypes)[key], dict(items.dtypes)[item_key]
    iarrow = to_arrow_type(items.schema[item_key].dataType)

    def make(block):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            idf_, basis_ = model.value
            ids, us = block.value
            rows, m = cut(np.concatenate(us), np.concatenate([[0], np.cumsum([len(u) for u in us])]), PASSAGE, 1)
            different, of = np.unique(m, axis=0, return_inverse=True)
            index = _Index(_unit_length(_project(different, idf_, basis_)), of.ravel(), rows)
            item_runs: dict[int, set[bytes]] = {}
            for b in batches:
                flat, offsets = _flat(b.column(1))
                drows, dm = cut(flat, offsets, PASSAGE, PASSAGE)
                pairs: set[tuple[int, int]] = set()
                for i in range(0, len(dm), _CHUNK):
                    x = _unit_length(_project(dm[i : i + _CHUNK], idf_, basis_))
                    r, it = index.near(x, SAME)
                    pairs.update(zip(drows[i + r].tolist(), it.tolist(), strict=True))
                hits, last, own = [], -1, set()
                for d, it in sorted(pairs):  # the exact check on the units
                    if d != last:
                        last, own = d, runs_of(flat[offsets[d] : offsets[d + 1]], run)
                    if it not in item_runs:
                        item_runs[it] = runs_of(us[it], run)
                    if not own.isdisjoint(item_runs[it]):
                        hits.append((d, it))
                if hits:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([d for d, _ in hits])), pa.array([ids[it] for _, it in hits], iarrow)], ["doc", "item"])

        return scan

    found = _search(docs, q, PASSAGE, make, f"doc {dtype}, item {itype}")
    if found is None:
        found = docs.select(F.col("id").alias("doc"), F.lit(None).cast(itype).alias("item")).where("false")
    return found.distinct()


#: Paraphrases: units of a window, step in documents and in items, least cosine,
#: least share of common units in order, of the item's rarest units.
WINDOW, STEP, ITEM_STEP, NEAR, IN_ORDER, ANSWER = 24, 12, 6, 0.8, 0.5, 0.5


def common_order(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b, 1):
            above = row[j]
            row[j] = left + 1 if x == y else max(above, row[j - 1])
            left = above
    return row[-1]


def paraphrases(documents: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """Documents with a passage near an item's in the latent space that also keeps
    the order of its words and its rarest words: doc, item, cosine, in_order,
    answer (greatest values of the pair's windows, each for itself).

    Finds reworded passages that share no long run; nothing is promised for those
    below the thresholds. Null, empty and short texts: as one window."""
    docs = spool(unit_rows(documents, key, text))
    idf, basis = fit(docs)
    q = unit_rows(items, item_key, item_text).where(F.size("u") > 0).distinct()
    model = docs.sparkSession.sparkContext.broadcast((idf, basis))
    dtype, itype = dict(documents.dtypes)[key], dict(items.dtypes)[item_key]
    iarrow = to_arrow_type(items.schema[item_key].dataType)

    def make(block):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            idf_, basis_ = model.value
            ids, us = block.value
            irows, im = cut(np.concatenate(us), np.concatenate([[0], np.cumsum([len(u) for u in us])]), WINDOW, ITEM_STEP, "back")
            iv = _unit_length(_project(im, idf_, basis_)).T.astype(np.float32)
            rare = [set(w[np.argsort(-idf_[_features(w)], kind="stable")[:6]].tolist()) - {0} for w in im]
            for b in batches:
                flat, offsets = _flat(b.column(1))
                drows, dm = cut(flat, offsets, WINDOW, STEP, "back")
                best: dict[tuple[int, int], list[float]] = {}
                for i in range(0, len(dm), 1024):
                    x = _unit_length(_project(dm[i : i + 1024], idf_, basis_)).astype(np.float32)
                    cos = x @ iv
                    for p, w in zip(*np.nonzero(cos >= NEAR), strict=True):
                        mine = dm[i + p]
                        answer = len(rare[w] & set(mine.tolist())) / max(1, len(rare[w]))
                        if answer < ANSWER:
                            continue
                        a, c = [v for v in mine.tolist() if v], [v for v in im[w].tolist() if v]
                        order = common_order(a, c) / max(1, len(c))
                        if order >= IN_ORDER:
                            v = best.setdefault((int(drows[i + p]), int(irows[w])), [0.0, 0.0, 0.0])
                            v[:] = [max(v[0], round(float(cos[p, w]), 6)), max(v[1], order), max(v[2], answer)]
                if best:
                    k = list(best)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([d for d, _ in k])), pa.array([ids[it] for _, it in k], iarrow), *(pa.array([best[x][j] for x in k]) for j in range(3))], ["doc", "item", "cosine", "in_order", "answer"])

        return scan

    found = _search(docs, q, WINDOW, make, f"doc {dtype}, item {itype}, cosine double, in_order double, answer double")
    if found is None:
        return docs.select(F.col("id").alias("doc"), *[F.lit(None).cast(t).alias(n) for n, t in (("item", itype), ("cosine", "double"), ("in_order", "double"), ("answer", "double"))]).where("false")
    return found.groupBy("doc", "item").agg(F.max("cosine").alias("cosine"), F.max("in_order").alias("in_order"), F.max("answer").alias("answer"))
