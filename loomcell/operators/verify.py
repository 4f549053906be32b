"""Content addresses, sparse Merkle trees and range proofs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomcell.runtime import ship, spool

DEPTH = 256


def _h(*parts: bytes) -> bytes:
    return hashlib.sha256(b"".join(parts)).digest()


@cache
def empties() -> tuple[bytes, ...]:
    """Digest of an empty subtree by height: 0 the empty leaf, 256 the empty tree."""
    out = [_h(b"\x00empty")]
    for _ in range(DEPTH):
        out.append(_h(b"\x01", out[-1], out[-1]))
    return tuple(out)


def position(key: str) -> int:
    return int.from_bytes(_h(b"\x02", key.encode()), "big")


def leaf(key: str, payload: str) -> bytes:
    return _h(b"\x00present", _h(b"\x02", key.encode()), payload.encode())


def build(leaves: dict[str, str]) -> list[dict[int, bytes]]:
    """Occupied nodes by height; their number is heights x leaves at most."""
    level = {position(k): leaf(k, v) for k, v in leaves.items()}
    levels = [level]
    for height in range(DEPTH):
        up: dict[int, bytes] = {}
        for p in level:
            q = p >> 1
            if q not in up:
                up[q] = _h(b"\x01", level.get(2 * q, empties()[height]), level.get(2 * q + 1, empties()[height]))
        level = up
        levels.append(level)
    return levels


def root(leaves: dict[str, str]) -> bytes:
    return build(leaves)[DEPTH].get(0, empties()[DEPTH])


def prove(leaves: dict[str, str], key: str) -> list[bytes]:
    """The 256 siblings on the way up, present or absent key alike."""
    levels, p, out = build(leaves), position(key), []
    for height in range(DEPTH):
        out.append(levels[height].get(p ^ 1, empties()[height]))
        p >>= 1
    return out


def check_proof(root_: bytes, key: str, payload: str | None, siblings: list[bytes]) -> bool:
    """Of membership, or of absence where payload is None."""
    if len(siblings) != DEPTH:
        return False
    p = position(key)
    x = empties()[0] if payload is None else leaf(key, payload)
    for s in siblings:
        x = _h(b"\x01", s, x) if p & 1 else _h(b"\x01", x, s)
        p >>= 1
    return x == root_


def merkle_roots(cells: DataFrame) -> DataFrame:
    """cells (entity_id, field_key, value_json) to entity_id, root (hex), n_leaves.
    An entity's leaves are as many as the registry has fields at most; null values
    have no leaf."""
    ship(cells.sparkSession)
    c = cells.where("value_json is not null").groupBy("entity_id").agg(F.map_from_entries(F.collect_set(F.struct("field_key", "value_json"))).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            maps = [dict(m) for m in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([root(m).hex() for m in maps]), pa.array([len(m) for m in maps], pa.int32())], ["entity_id", "root", "n_leaves"])

    return c.mapInArrow(run, "entity_id string, root string, n_leaves int")


def proofs(cells: DataFrame, wanted: DataFrame) -> DataFrame:
    """A proof per wanted (entity_id, field_key): payload (null for absence),
    siblings (hex), root, and whether it checks."""
    ship(cells.sparkSession)
    c = cells.where("value_json is not null").groupBy("entity_id").agg(F.map_from_entries(F.collect_set(F.struct("field_key", "value_json"))).alias("m"))
    w = wanted.join(c, "entity_id").select("entity_id", "field_key", "m")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in frames:
            out = []
            for e, k, m in p.itertuples(index=False):
                m = dict(m)
                s, r = prove(m, k), root(m)
                out.append((e, k, m.get(k), [x.hex() for x in s], r.hex(), check_proof(r, k, m.get(k), s)))
            yield pd.DataFrame(out, columns=["entity_id", "field_key", "payload", "siblings", "root", "valid"])

    return w.mapInPandas(run, "entity_id string, field_key string, payload string, siblings array<string>, root string, valid boolean")


def node_table(cells: DataFrame) -> DataFrame:
    """Occupied nodes of all trees as rows entity_id, height, position (hex), digest,
    so that a proof is a lookup of 256 positions."""
    ship(cells.sparkSession)
    c = cells.where("value_json is not null").groupBy("entity_id").agg(F.map_from_entries(F.collect_set(F.struct("field_key", "value_json"))).alias("m"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in frames:
            for e, m in p.itertuples(index=False):
                rows = [(e, h, f"{q:064x}", d.hex()) for h, level in enumerate(build(dict(m))) for q, d in level.items()]
                yield pd.DataFrame(rows, columns=["entity_id", "height", "position", "digest"])

    return c.mapInPandas(run, "entity_id string, height int, position string, digest string")


def entity_digests(cells: DataFrame) -> DataFrame:
    """SHA-256 of an entity's key=value lines in key order."""
    lines = F.array_sort(F.collect_list(F.concat_ws("=", "field_key", "value_json")))
    return cells.groupBy("entity_id").agg(F.sha2(F.array_join(lines, "\n"), 256).alias("digest"), F.count("*").alias("n_cells"))


#: First bytes of what is hashed for a chunk, for the padding and for a node. They
#: separate the three kinds; a store with other ones gives its own.
DOMAINS = (b"\x03", b"\x04pad", b"\x05")


def chunks(files: DataFrame, size: int, domains: tuple[bytes, bytes, bytes] = DOMAINS) -> DataFrame:
    """files (file_id, content binary) cut into chunks: file_id, chunk, length, digest
    of domain, number, length and bytes. One pass over each content; an empty one is
    one empty chunk, a null one none."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, number, length, digest = [], [], [], []
            for i, content in enumerate(b.column(1)):
                if not content.is_valid:
                    continue
                data = memoryview(content.as_buffer())
                for k in range(max(1, -(-len(data) // size))):
                    part = data[k * size : (k + 1) * size]
                    h = hashlib.sha256(domains[0] + k.to_bytes(8, "big") + len(part).to_bytes(8, "big"))
                    h.update(part)
                    at.append(i)
                    number.append(k)
                    length.append(len(part))
                    digest.append(h.hexdigest())
            cols = [b.column(0).take(pa.array(at, pa.int64())), pa.array(number, pa.int32()), pa.array(length, pa.int32()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["file_id", "chunk", "length", "digest"])

    return files.select("file_id", "content").mapInArrow(run, f"file_id {dict(files.dtypes)['file_id']}, chunk int, length int, digest string")


def _big_endian(x: F.Column) -> F.Column:
    return F.unhex(F.lpad(F.hex(x.cast("bigint")), 16, "0"))


def _node(left: F.Column, right: F.Column, domains: tuple[bytes, bytes, bytes]) -> F.Column:
    return F.sha2(F.concat(F.lit(domains[2]), F.unhex(left), F.unhex(right)), 256)


def range_tree(chunked: DataFrame, domains: tuple[bytes, bytes, bytes] = DOMAINS) -> DataFrame:
    """All nodes over the chunks of each file: file_id, n_chunks, tree_depth, level
    (0: chunks and padding), at, digest. A file's chunks are padded by position to a
    power of two and hashed pairwise, level by level, as equi-aggregates on (file,
    half the number): no file's chunks are gathered in one task."""
    n = chunked.groupBy("file_id").agg(F.count("*").alias("n_chunks"))
    n = n.withColumn("tree_depth", F.length(F.when(F.col("n_chunks") > 1, F.bin(F.col("n_chunks") - 1)).otherwise(""))).withColumn("width", F.expr("shiftleft(1L, tree_depth)"))
    n = spool(n)
    pads = n.where("width > n_chunks").select("file_id", F.explode(F.sequence("n_chunks", F.col("width") - 1)).alias("at")).withColumn("digest", F.sha2(F.concat(F.lit(domains[1]), _big_endian(F.col("at"))), 256))
    level = spool(chunked.select("file_id", F.col("chunk").cast("bigint").alias("at"), "digest").unionByName(pads))
    levels = [level.withColumn("level", F.lit(0))]
    for d in range(int(n.agg(F.max("tree_depth")).first()[0] or 0)):
        half = level.groupBy("file_id", F.shiftright("at", 1).alias("at2")).agg(F.count("*").alias("k"), F.max(F.when(F.col("at") % 2 == 0, F.col("digest"))).alias("l"), F.max(F.when(F.col("at") % 2 == 1, F.col("digest"))).alias("r"))
        level = spool(half.where("k = 2").select("file_id", F.col("at2").alias("at"), _node(F.col("l"), F.col("r"), domains).alias("digest")))  # a file's root has no other half
        levels.append(level.withColumn("level", F.lit(d + 1)))
    return reduce(DataFrame.unionByName, levels).join(n.drop("width"), "file_id").select("file_id", "n_chunks", "tree_depth", "level", "at", "digest")


def range_roots(chunked: DataFrame, domains: tuple[bytes, bytes, bytes] = DOMAINS) -> DataFrame:
    """file_id, n_chunks, tree_depth, root of each file's tree."""
    return range_tree(chunked, domains).where("level = tree_depth").select("file_id", "n_chunks", "tree_depth", F.col("digest").alias("root"))


def chunk_proofs(tree: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (file_id, chunk) with the siblings from the chunk up to the root:
    file_id, chunk, tree_depth, root, siblings. What no file has gets no proof."""
    roots = tree.where("level = tree_depth").select("file_id", "n_chunks", "tree_depth", F.col("digest").alias("root"))
    w = wanted.select("file_id", F.col("chunk").cast("bigint").alias("chunk")).distinct().join(roots, "file_id").where("chunk >= 0 and chunk < n_chunks")
    steps = w.where("tree_depth > 0").select("file_id", "chunk", F.explode(F.sequence(F.lit(0), F.col("tree_depth") - 1)).alias("level"))
    steps = steps.withColumn("at", F.expr("shiftright(chunk, level) ^ 1"))
    s = steps.join(tree.select("file_id", "level", "at", "digest"), ["file_id", "level", "at"]).groupBy("file_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("level", "digest"))).alias("s"))  # as long as the tree is deep
    s = s.select("file_id", "chunk", F.transform("s", lambda x: x["digest"]).alias("siblings"))
    return w.join(s, ["file_id", "chunk"], "left").select("file_id", "chunk", "tree_depth", "root", F.coalesce("siblings", F.array().cast("array<string>")).alias("siblings"))


def verify_chunks(received: DataFrame, proofs: DataFrame, domains: tuple[bytes, bytes, bytes] = DOMAINS) -> DataFrame:
    """received chunks (file_id, chunk, bytes) against their proofs: file_id, chunk,
    valid. Whatever was changed, shortened, moved or has no proof isn't valid."""
    r = received.select("file_id", F.col("chunk").cast("bigint").alias("chunk"), "bytes").join(proofs, ["file_id", "chunk"], "left")
    leaf = F.sha2(F.concat(F.lit(domains[0]), _big_endian(F.col("chunk")), _big_endian(F.length("bytes")), F.col("bytes")), 256)
    start = F.struct(leaf.alias("h"), F.col("chunk").alias("i"))

    def up(acc: F.Column, sib: F.Column) -> F.Column:
        h = F.when(acc["i"] % 2 == 0, _node(acc["h"], sib, domains)).otherwise(_node(sib, acc["h"], domains))
        return F.struct(h.alias("h"), F.shiftright(acc["i"], 1).alias("i"))

    whole = F.size("siblings") == F.col("tree_depth")
    return r.select("file_id", "chunk", F.coalesce(whole & (F.aggregate("siblings", start, up)["h"] == F.col("root")), F.lit(False)).alias("valid"))


def verified_ranges(replicas: DataFrame, requests: DataFrame, proofs: DataFrame, size: int, domains: tuple[bytes, bytes, bytes] = DOMAINS) -> DataFrame:
    """Byte ranges (file_id, first_byte, n_bytes) from ranked replicas (file_id, rank,
    chunk, bytes): each covering chunk from the first replica whose copy verifies.
    file_id, bytes (null if some chunk verifies nowhere), n_chunks, n_failed (copies
    passed over)."""
    need = requests.select("file_id", "first_byte", "n_bytes", F.explode(F.sequence(F.floor(F.col("first_byte") / size).cast("bigint"), F.floor((F.col("first_byte") + F.col("n_bytes") - 1) / size).cast("bigint"))).alias("chunk"))
    got = replicas.select("file_id", "rank", F.col("chunk").cast("bigint").alias("chunk"), "bytes").join(need.select("file_id", "chunk").distinct(), ["file_id", "chunk"], "left_semi")
    ranked = verify_chunks(got.withColumn("file_id", F.struct("file_id", "rank")), proofs.join(got.select("file_id", "rank").distinct(), "file_id").withColumn("file_id", F.struct("file_id", "rank")).drop("rank"), domains)
    state = got.join(ranked.select("file_id.file_id", "file_id.rank", "chunk", "valid"), ["file_id", "rank", "chunk"])
    first = state.groupBy("file_id", "chunk").agg(F.min(F.when(F.col("valid"), F.struct("rank", "bytes"))).alias("c"), F.min(F.when(F.col("valid"), F.col("rank"))).alias("ok"), F.collect_list(F.struct("rank", "valid")).alias("tried"))  # replicas are few
    first = first.withColumn("n_failed", F.size(F.filter("tried", lambda x: ~x["valid"] & (F.col("ok").isNull() | (x["rank"] < F.col("ok"))))))
    j = need.join(first, ["file_id", "chunk"], "left")
    g = j.groupBy("file_id", "first_byte", "n_bytes").agg(F.array_sort(F.collect_list(F.struct("chunk", F.col("c.bytes").alias("b")))).alias("s"), F.count("*").alias("n_chunks"), F.count("c").alias("n_ok"), F.sum(F.coalesce("n_failed", F.lit(0))).alias("n_failed"))
    joined = F.aggregate("s", F.lit(b""), lambda acc, x: F.concat(acc, x["b"]))
    data = F.expr("substring(__all, cast(first_byte % {0} as int) + 1, cast(n_bytes as int))".format(size))
    return g.withColumn("__all", joined).select("file_id", "first_byte", F.when(F.col("n_ok") == F.col("n_chunks"), data).alias("bytes"), "n_chunks", "n_failed")


def covering(chunked: DataFrame, requests: DataFrame, size: int) -> DataFrame:
    """The chunks that a byte range (file_id, first_byte, n_bytes) needs."""
    r = requests.select("file_id", "first_byte", "n_bytes", F.explode(F.sequence(F.floor(F.col("first_byte") / size).cast("int"), F.floor((F.col("first_byte") + F.col("n_bytes") - 1) / size).cast("int"))).alias("chunk"))
    return r.join(chunked, ["file_id", "chunk"])


def rank_placements(p: DataFrame, region: str, providers: list[str], tiers: list[str], largest: int) -> DataFrame:
    """Replicas that may be read, in the order in which to try them."""
    ok = p.where(F.col("enabled") & F.col("provider_id").isin(providers) & F.col("tier").isin(tiers) & (F.col("size_bytes") <= largest))
    w = Window.partitionBy("digest").orderBy(F.when(F.col("region") == region, 0).otherwise(1), "priority", "placement_id")
    return ok.withColumn("rank", F.row_number().over(w))
