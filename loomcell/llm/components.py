"""Pairwise matches into groups: connected components over any number of pairs.

The giant component is peeled by frontier breadth-first joins from the vertex of
highest degree and removed by anti-join; the small components left over are
labelled by minimum propagation with contraction, in a logarithmic number of
rounds. Vertices, links and labels never come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcell.runtime import lookup_join, spool

#: Rounds of breadth-first peeling; what a giant component's long tails leave is
#: left to the propagation, with all that was reached as one vertex.
PEEL_ROUNDS = 6
#: A side of up to so many rows is broadcast. The rounds' broadcasts live side by
#: side in the driver until it collects garbage, so the bound is low.
SMALL = 10_000


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def _hook(edges: DataFrame) -> DataFrame:
    """Each vertex's smallest neighbour or itself, three times followed: v, to. Many
    vertices may follow one and the same, so its row goes out salted or broadcast."""
    up = spool(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("to")))
    step = up.select(F.col("v").alias("k"), F.col("to").alias("far"))
    n = up.count()
    for _ in range(3):
        up = lookup_join(up.select("v", F.col("to").alias("k")), step, "k", spread=F.col("v"), rows=SMALL, n_small=n).select("v", F.col("far").alias("to"))
    return spool(up)


def _follow(df: DataFrame, column: str, up: DataFrame, n_up: int) -> DataFrame:
    """Replace a column's vertices by what they are hooked to, if they are."""
    others = [c for c in df.columns if c != column]
    keyed = df.withColumnRenamed(column, "k")
    j = lookup_join(keyed, up.select(F.col("v").alias("k"), "to"), "k", "left", spread=F.col(others[0]), rows=SMALL, n_small=n_up)
    return j.select(*others, F.coalesce("to", "k").alias(column)).select(*df.columns)


def peel(edges: DataFrame, rounds: int = PEEL_ROUNDS) -> tuple[DataFrame, int]:
    """The vertices reached from the one of highest degree (smallest id at a tie)
    within so many breadth-first rounds (v), and their number. Ends early when a
    round brings hardly anything new: what is left hangs on the rest by a border."""
    hub = edges.groupBy("a").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "a").limit(1).select(F.col("a").alias("v"))
    seen = frontier = spool(hub)
    n_seen = n = 1
    for _ in range(rounds):
        step = lookup_join(edges, frontier.select(F.col("v").alias("a")), "a", "left_semi", spread=F.col("b"), rows=SMALL, n_small=n)
        frontier = spool(step.select(F.col("b").alias("v")).distinct().join(seen, "v", "left_anti"))
        n = frontier.count()
        if not n:
            break
        seen, n_seen = spool(seen.unionByName(frontier)), n_seen + n
        if n * 20 < n_seen:
            break
    return seen, n_seen


def components(pairs: DataFrame, rounds: int = PEEL_ROUNDS) -> DataFrame:
    """pairs (a, b) of linked ids as record_id, group_id (smallest id of all linked
    directly or indirectly). Direction, repeated, self and null pairs don't matter;
    an id with none but self pairs has no row. No pairs, no rows."""
    edges = spool(_both(pairs.where("a is not null and b is not null and a <> b")))
    if edges.isEmpty():
        return edges.select(F.col("a").alias("record_id"), F.col("b").alias("group_id"))
    reached, n_reached = peel(edges, rounds)
    giant = reached.withColumn("to", F.lit(reached.agg(F.min("v")).first()[0]))  # one value
    labels = spool(edges.select(F.col("a").alias("v")).distinct().join(giant, "v", "left").select("v", F.coalesce("to", "v").alias("to")))
    # links inside the peeled part are gone; those on its border lead to its label
    rest = lookup_join(edges, giant.select(F.col("v").alias("a")), "a", "left_anti", spread=F.col("b"), rows=SMALL, n_small=n_reached)
    rest = spool(_both(_follow(rest, "b", giant, n_reached).where("a <> b")))
    while not rest.isEmpty():
        up = _hook(rest)
        n_up = up.count()
        labels = spool(_follow(labels, "to", up, n_up))
        rest = spool(_both(_follow(_follow(rest, "a", up, n_up), "b", up, n_up).where("a <> b")))
    return labels.select(F.col("v").alias("record_id"), F.col("to").alias("group_id"))
