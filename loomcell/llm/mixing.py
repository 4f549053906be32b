"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents, shuffled, are cut into blocks of about equal tokens. Slot
i of the mix belongs to the source in whose share of the cumulative weights the
point frac(i * golden ratio) falls, so every stretch of the mix has nearly the
target shares. A source's slots are ranked and take its blocks in turn, as many
times as it may be repeated.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomcell.runtime import ship, spool, spread_previous

#: Vocabulary file of the tokenizer and the pattern that splits texts before it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BLOCK_TOKENS, SEED = 4096, 7
#: Documents of one source numbered within one group; the groups' sums are prefixed.
_GROUP, _SLOTS = 20_000, 100_000
_GOLDEN = 0.6180339887498949


@cache
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, key: str, source: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """documents as id, source, tokens; a null or empty text has none."""
    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(vocabulary)
        for b in batches:
            n = pa.array([len(enc.encode_ordinary(s)) if s else 0 for s in b.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n], ["id", "source", "tokens"])

    d = documents.select(key, source, text)
    types = dict(documents.dtypes)
    return d.mapInArrow(run, f"id {types[key]}, source {types[source]}, tokens bigint")


def blocks(counted: DataFrame, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """Shuffled documents of each source in blocks of equal tokens: id, source,
    tokens, block (0-based). A document belongs to the block its first token falls
    into, so a block differs from the size by less than one document.

    The running sum of a source is built from sums of groups of documents, so a
    source with a third of all rows is numbered by many tasks."""
    c = spool(counted.where("source is not null and tokens > 0").withColumn("h", F.xxhash64(F.col("id"), F.lit(seed))))
    size = c.groupBy("source").agg((F.ceil(F.count("*") / _GROUP)).alias("n_groups"))
    g = c.join(F.broadcast(size), "source") if size.limit(10_001).count() <= 10_000 else c.join(size, "source")
    # groups are ranges of the hash, in order
    g = g.withColumn("g", F.floor((F.shiftrightunsigned(F.col("h"), 11) / F.lit(float(1 << 53))) * F.col("n_groups")).cast("bigint"))
    sums = g.groupBy("source", "g").agg(F.sum("tokens").alias("t"))
    before = sums.select("source", "g", F.coalesce(F.sum("t").over(Window.partitionBy("source").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inner = Window.partitionBy("source", "g").orderBy(F.shiftrightunsigned(F.col("h"), 11), "id").rowsBetween(Window.unboundedPreceding, -1)
    own = g.withColumn("own", F.coalesce(F.sum("tokens").over(inner), F.lit(0)))
    cut = own.join(before, ["source", "g"]).select("id", "source", "tokens", "h", F.floor((F.col("before") + F.col("own")) / block_tokens).alias("block"))
    # a block holds no more documents than tokens
    within = Window.partitionBy("source", "block").orderBy(F.shiftrightunsigned(F.col("h"), 11), "id")
    return cut.select("id", "source", "tokens", "block", (F.row_number().over(within) - 1).alias("place"))


def _plan(cut: DataFrame, targets: DataFrame, total_tokens: int | None) -> DataFrame:
    """Per source with a target: what it has, may and shall give."""
    have = cut.groupBy("source").agg(F.sum("tokens").alias("available_tokens"), F.count_distinct("block").alias("n_blocks"), F.count("*").alias("n_documents"))
    t = targets.where("source is not null and target_share > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    p = t.join(have, "source", "left").select("source", "target_share", "max_repeats", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("available_tokens", "n_blocks", "n_documents")])
    every = Window.partitionBy(F.lit(1))
    p = p.withColumn("weight", F.col("target_share") / F.sum("target_share").over(every))
    total = F.lit(total_tokens) if total_tokens is not None else F.sum("available_tokens").over(every)
    return p.withColumn("total", total.cast("double"))


def schedule(cut: DataFrame, plan: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Slots of the mix: slot, source, block, repeat. Of a source's slots only the
    first n_blocks * max_repeats are filled: what it can't give isn't made up."""
    spark = cut.sparkSession
    n_slots = plan.agg(F.max(F.ceil(F.col("total") / block_tokens))).first()[0] or 0
    w = Window.orderBy("source").rowsBetween(Window.unboundedPreceding, 0)  # one row per source
    shares = plan.withColumn("upto", F.sum("weight").over(w)).withColumn("from", F.col("upto") - F.col("weight"))
    # sources are the rows of the target table; a list of more than a few thousand is no mix
    rows = shares.select("source", "from", "n_blocks", "max_repeats", "available_tokens").orderBy("from").collect()
    if not rows:
        return spark.createDataFrame([], f"slot bigint, source {dict(plan.dtypes)['source']}, block bigint, repeat bigint")
    point = (F.col("slot") * F.lit(_GOLDEN)) % 1
    pick = F.lit(0)
    for i in range(1, len(rows)):
        pick = F.when(point >= F.lit(float(rows[i]["from"])), F.lit(i)).otherwise(pick)
    slots = spark.range(int(n_slots)).select(F.col("id").alias("slot"), F.floor(F.col("id") / _SLOTS).alias("part"))
    slots = slots.withColumn("s", pick)
    counts = slots.groupBy("part", "s").agg(F.count("*").alias("n"))
    before = counts.select("part", "s", F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = slots.withColumn("r", F.row_number().over(Window.partitionBy("part", "s").orderBy("slot")) - 1).join(before, ["part", "s"])
    ranked = ranked.withColumn("rank", F.col("r") + F.col("before"))
    names = F.array(*[F.lit(r["source"]) for r in rows])
    n_blocks = F.array(*[F.lit(int(r["n_blocks"])).cast("bigint") for r in rows])
    repeats = F.array(*[F.lit(int(r["max_repeats"])).cast("bigint") for r in rows])
    at = F.col("s") + 1
    full = ranked.select("slot", F.element_at(names, at).alias("source"), F.col("rank"), F.element_at(n_blocks, at).alias("nb"), F.element_at(repeats, at).alias("mr"))
    full = full.where((F.col("nb") > 0) & (F.col("rank") < F.col("nb") * F.col("mr")))
    return full.select("slot", "source", (F.col("rank") % F.col("nb")).alias("block"), F.floor(F.col("rank") / F.col("nb")).alias("repeat"))


def mix(documents: DataFrame, key: str, source: str, text: str, targets: DataFrame, total_tokens: int | None = None,
        block_tokens: int = BLOCK_TOKENS, vocabulary: str = VOCABULARY, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(the mix, the plan per source). The mix has a row per document and use: slot
    (its order), place (order within the slot), source, block, repeat, id, tokens;
    written in the order of slot and place it is the training text.

    total_tokens: size of the mix, by default that of all documents with a target.
    Null and empty texts, and sources without a target, are in no slot."""
    cut = spool(blocks(token_counts(documents, key, source, text, vocabulary), block_tokens, seed))
    plan = _plan(cut, targets, total_tokens)
    # a gap in the numbering (a document longer than a block) leaves no empty block behind;
    # the blocks of a source are numbered over many ranges
    dense = cut.select("source", "block").distinct().withColumn("__v", F.lit(0))
    dense = spread_previous(dense, "source", ["block"], "__v").select("source", "block", F.col("nth").cast("bigint").alias("nth"))
    slots = schedule(cut, plan, block_tokens).withColumnRenamed("block", "nth")
    filled = slots.join(dense, ["source", "nth"])  # a block has at most max_repeats slots
    m = filled.join(cut, ["source", "block"]).select("slot", "place", "source", F.col("nth").alias("block"), "repeat", "id", "tokens")
    return m, plan


def uses(documents: DataFrame, key: str, source: str, text: str, targets: DataFrame, total_tokens: int | None = None,
         block_tokens: int = BLOCK_TOKENS, vocabulary: str = VOCABULARY, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(how often each document stands in the mix, the plan per source)."""
    m, plan = mix(documents, key, source, text, targets, total_tokens, block_tokens, vocabulary, seed)
    return m.groupBy("id", "source").agg(F.max("tokens").alias("tokens"), F.count("*").alias("n_uses")), plan


def report(used: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source: target and actual share of all tokens in the mix, what it had
    and gave, the most repetitions, and whether the target was met (within one
    percent of the mix)."""
    got = used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("n_uses")).alias("mixed_tokens"), F.max("n_uses").alias("most_uses"))
    every = Window.partitionBy(F.lit(1))  # one row per source
    r = plan.join(got, "source", "left").select("source", "target_share", "max_repeats", "available_tokens", "n_documents", F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), "total", "weight")
    r = r.withColumn("actual_share", F.coalesce(F.try_divide(F.col("mixed_tokens"), F.sum("mixed_tokens").over(every)), F.lit(0.0)))
    reached = F.try_divide(F.col("mixed_tokens").cast("double"), F.col("total"))
    return r.withColumn("met", F.coalesce(reached >= F.col("weight") - 0.01, F.lit(False))).drop("total", "weight")
