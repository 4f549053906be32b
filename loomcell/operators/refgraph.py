"""Reference graphs: edges from declarative rules, degrees, components, closures."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import count

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomcell.runtime import lookup_join, ship, spool


def is_sentinel(c: Column) -> Column:
    """Stands for no reference: null, -1, nil in any case, blank."""
    return c.isNull() | F.lower(F.trim(c)).isin("", "-1", "nil")


def repeated_groups(df: DataFrame, key: list[str], base: dict[str, str], slots: int) -> DataFrame:
    """Columns Name0..N into one array of structs with their slot; a slot all of
    whose members are sentinels is left out. base: member name to column prefix."""
    have = set(df.columns)
    structs = [F.struct(F.lit(i).alias("slot"), *[F.col(f"{p}{i}").cast("string").alias(m) if f"{p}{i}" in have else F.lit(None).cast("string").alias(m) for m, p in base.items()]) for i in range(slots)]
    keep = lambda x: reduce(lambda a, b: a | b, [~is_sentinel(x[m]) for m in base])
    return df.select(*key, F.filter(F.array(*structs), keep).alias("items"))


def edges(records: DataFrame, rules: list[tuple[str, str, str]], targets: DataFrame, separator: str = "&") -> DataFrame:
    """References of records (source_table, source_id, payload map of column to
    text) by rules (table, regular expression on the column, target table).

    A value with the separator is a list, each target once. Status: resolved if the
    target (table_name, record_id) is there, missing_target otherwise. Rules are a
    short literal table; the target index is joined, by a shuffle of both if it is large:
    it grows with the records, so it isn't copied."""
    cols = records.select("source_table", "source_id", F.explode("payload").alias("field", "value")).where(~is_sentinel(F.col("value")))
    rule = None
    for table, pattern, target in rules:
        cond = (F.col("source_table") == table) & F.col("field").rlike(f"^(?:{pattern})$")
        rule = F.when(cond, target) if rule is None else rule.when(cond, target)
    hit = cols.withColumn("target_table", rule).where("target_table is not null")
    one = hit.select("source_table", "source_id", "field", "target_table", F.posexplode(F.array_distinct(F.split("value", re.escape(separator)))).alias("slot", "target_id"))
    one = one.withColumn("target_id", F.trim("target_id"))
    index = targets.select(F.col("record_id").cast("string").alias("target_id"), F.col("table_name").alias("target_table")).distinct().withColumn("known", F.lit(True))
    j = lookup_join(one, index, ["target_id", "target_table"], "left", salted=False)
    return j.select("source_table", "source_id", "field", "slot", "target_table", "target_id", F.when(F.col("known"), "resolved").otherwise("missing_target").alias("status"))


def edge_counts(e: DataFrame) -> DataFrame:
    return e.groupBy(F.concat_ws("", F.col("source_table"), F.lit("."), F.col("field"), F.lit("->"), F.col("target_table"), F.lit(":"), F.col("status")).alias("edge_type")).agg(F.count("*").alias("n"))


def edge_id(e: DataFrame) -> Column:
    return F.substring(F.sha2(F.to_json(F.array(*[F.col(c).cast("string") for c in ("source_id", "field", "slot", "target_table", "target_id")])), 256), 1, 16)


def degrees(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """In- and out-degree of all nodes and their class: isolated, root (nothing
    leads to it), terminal (leads nowhere), inner. Repeated links count once."""
    li = links.select("src", "dst").distinct()
    both = li.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(li.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    d = both.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    j = nodes.select("id").distinct().join(d, "id", "left").select("id", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"))
    i, o = F.col("in_degree"), F.col("out_degree")
    return j.withColumn("class", F.when((i == 0) & (o == 0), "isolated").when(i == 0, "root").when(o == 0, "terminal").otherwise("inner"))


def closure(links: DataFrame, start: DataFrame, depth: int | None = None) -> DataFrame:
    """All nodes reached from start nodes (id) with their least distance. Only the
    frontier is joined in a round; a cycle ends as nothing new is reached. depth: the
    greatest distance that is wanted, any if None."""
    li = spool(links.select("src", "dst").distinct())
    seen = frontier = spool(start.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).alias("distance")).distinct())
    for n in count(1) if depth is None else range(1, depth + 1):
        step = li.join(frontier.select("start", F.col("node").alias("src")), "src").select("start", F.col("dst").alias("node")).distinct()
        frontier = spool(step.join(seen, ["start", "node"], "left_anti").withColumn("distance", F.lit(n)))
        if frontier.isEmpty():
            break
        seen = spool(seen.unionByName(frontier))
    return seen.where("distance > 0")


def strong_components(links: DataFrame) -> DataFrame:
    """Strongly connected components: id, component (its smallest id), cyclic (more
    than one node, or a link to itself). All nodes of the links have a row.

    Distributed trimming and colouring: nodes without way in or out are components
    by themselves and drop out, again and again; of the rest, each takes the smallest
    id that reaches it, and of those of one colour, the ones that lead back to it
    are its component. Links never come to the driver."""
    li = spool(links.where("src is not null and dst is not null").select("src", "dst").distinct())
    loops = li.where("src = dst").select(F.col("src").alias("id")).distinct().withColumn("loop", F.lit(True))
    nodes = li.select(F.col("src").alias("id")).union(li.select("dst")).distinct()
    rest = spool(li.where("src <> dst"))
    done: list[DataFrame] = []
    while True:  # each round takes at least one component away
        # trim: keep links between nodes with a way in and a way out
        while True:
            n = rest.count()
            live = rest.select(F.col("src").alias("id")).intersect(rest.select(F.col("dst").alias("id")))
            rest = spool(rest.join(live.withColumnRenamed("id", "src"), "src", "left_semi").join(live.withColumnRenamed("id", "dst"), "dst", "left_semi"))
            if rest.count() == n:
                break
        if not n:
            break
        colour = spool(rest.select(F.col("src").alias("id")).distinct().withColumn("c", F.col("id")))
        while True:  # the smallest id that reaches a node
            low = rest.join(colour.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("m"))
            new = spool(colour.join(low, "id", "left").select("id", F.least("c", F.coalesce("m", "c")).alias("c"), (F.col("m") < F.col("c")).alias("changed")))
            more = not new.where("changed").isEmpty()
            colour = new.select("id", "c")
            if not more:
                break
        inside = spool(rest.join(colour.select(F.col("id").alias("src"), F.col("c").alias("c1")), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("c2")), "dst").where("c1 = c2").select("src", "dst", F.col("c1").alias("c")))
        member = frontier = spool(colour.where("id = c").select("id", "c"))
        while True:  # backwards from each colour's root, within the colour
            step = inside.join(frontier.select(F.col("id").alias("dst"), "c"), ["dst", "c"]).select(F.col("src").alias("id"), "c").distinct()
            frontier = spool(step.join(member, ["id", "c"], "left_anti"))
            if frontier.isEmpty():
                break
            member = spool(member.unionByName(frontier))
        done.append(member)
        rest = spool(rest.join(member.select(F.col("id").alias("src")), "src", "left_anti").join(member.select(F.col("id").alias("dst")), "dst", "left_anti"))
    found = reduce(DataFrame.unionByName, done) if done else nodes.limit(0).withColumn("c", F.col("id"))
    sizes = found.groupBy("c").agg(F.count("*").alias("n"))
    j = nodes.join(found, "id", "left").join(sizes, "c", "left").join(loops, "id", "left")
    return j.select("id", F.coalesce("c", "id").alias("component"), (F.coalesce("n", F.lit(1)).__gt__(1) | F.coalesce("loop", F.lit(False))).alias("cyclic"))


def top_degree(e: DataFrame, column: str, k: int = 20) -> DataFrame:
    return e.groupBy(F.col(column).alias("id")).agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "id").limit(k)


def linked_search(direct: DataFrame, links: DataFrame) -> DataFrame:
    """Matches (id) and what they lead to over one link: id, via (direct or
    stored_link; direct wins)."""
    hop = links.join(direct.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
    both = direct.select("id", F.lit(0).alias("v")).unionByName(hop.withColumn("v", F.lit(1)))
    return both.groupBy("id").agg(F.min("v").alias("v")).select("id", F.when(F.col("v") == 0, "direct").otherwise("stored_link").alias("via"))


def triples(cells: DataFrame, names: tuple[str, str, str] = ("relation_type", "source", "target")) -> DataFrame:
    """Relations stored as entities with cells (entity_id, field_key, value_json):
    one conditional aggregate instead of joining the cells with themselves."""
    t, s, o = names
    pick = lambda n: F.max(F.when(F.col("field_key") == n, F.col("value_json")))
    return cells.where(F.col("field_key").isin(*names)).groupBy("entity_id").agg(pick(t).alias("relation_type"), pick(s).alias("source"), pick(o).alias("target")).where("relation_type is not null and source is not null and target is not null")


def latest_window(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__r = 1").drop("__r")


#: Names looked for in one pass over the texts.
NAME_BLOCK = 50_000


def text_mentions(texts: DataFrame, names: DataFrame) -> DataFrame:
    """Which names (name_id, name) stand in which texts (text_id, text), case apart:
    text_id, name_id, once each.

    No join on `contains`: a multi-pattern automaton of the names scans each text
    once. Names are taken in blocks of bounded size, one pass each, so the list may
    be of any length. A null or empty name stands nowhere."""
    ship(texts.sparkSession)
    ttype, ntype = dict(texts.dtypes)["text_id"], dict(names.dtypes)["name_id"]
    narrow = to_arrow_type(names.schema["name_id"].dataType)
    sc = texts.sparkSession.sparkContext
    out = None

    def search(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by_name: dict[str, list] = {}
            for i, n in block.value:
                by_name.setdefault(n, []).append(i)
            a = ahocorasick.Automaton()
            for n, ids in by_name.items():
                a.add_word(n, (n, ids))
            a.make_automaton()
            for b in batches:
                hits = [(k, i) for k, t in enumerate(b.column(1).to_pylist()) if t for _, ids in {v[0]: v for _, v in a.iter(t)}.values() for i in ids]
                if hits:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([k for k, _ in hits])), pa.array([i for _, i in hits], narrow)], ["text_id", "name_id"])

        return texts.select("text_id", "text").mapInArrow(run, f"text_id {ttype}, name_id {ntype}")

    block: list[tuple] = []
    for r in names.where("name is not null and name <> ''").select("name_id", "name").distinct().toLocalIterator():
        block.append((r["name_id"], r["name"]))
        if len(block) == NAME_BLOCK:
            part, block = search(sc.broadcast(block)), []
            out = part if out is None else out.unionByName(part)
    if block:
        part = search(sc.broadcast(block))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return texts.select("text_id", F.lit(None).cast(ntype).alias("name_id")).where("false")
    return out.distinct()
