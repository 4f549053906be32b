"""Queries of the problems on text and matching, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcell.llm import canonical_list, components, contamination, garbled, mixing, skeleton
from loomcell.runtime import latest, load


def _readable(spark: SparkSession, d: str) -> DataFrame:
    fields, c4b = load(spark, d, "fields"), load(spark, d, "c4b")

    def col(df: DataFrame, table: str, name: str, key: str) -> DataFrame:
        return df.select(F.lit(table).alias("table_name"), F.lit(name).alias("column_name"), F.col(key).alias("id"), F.col(name).alias("text"))

    return col(fields, "fields", "key", "id").unionByName(col(fields, "fields", "label", "id")).unionByName(col(c4b, "c4b", "label_zh", "key"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return skeleton.lookalike_pairs(_readable(spark, d))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return skeleton.groups(_readable(spark, d))


def _proposals(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    values = load(spark, d, "field_proposals").where(~F.col("namespace").startswith("lab_")).select(F.col("namespace").alias("block"), "id", F.col("key").alias("text"))
    fields = load(spark, d, "fields").where(~F.col("namespace").startswith("lab_"))
    keys = latest(fields, ["id"], ["updated_at"], ["namespace", "normalized_key"]).select(F.col("namespace").alias("block"), F.col("id").alias("target"), F.col("normalized_key").alias("text"))
    aliases = load(spark, d, "field_aliases").select(F.col("namespace").alias("block"), F.col("field_id").alias("target"), F.col("normalized_alias").alias("text"))
    return values, keys.unionByName(aliases)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    m = canonical_list.match(*_proposals(spark, d))
    return m.select(F.col("id").alias("proposal_id"), F.coalesce("target", F.lit("")).alias("field_id"))


def p5_matches(spark: SparkSession, d: str) -> DataFrame:
    return canonical_list.match(*_proposals(spark, d))


#: Least score of a link.
LINK_SCORE = 0.72


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "semantic_candidates")
    cur = latest(c, ["source_kind", "source_ref", "candidate_field_id"], ["created_at"], ["score"])
    links = cur.where(F.col("score") >= LINK_SCORE).select(F.col("source_ref").alias("a"), F.col("candidate_field_id").alias("b"))
    return components.components(links)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    found = contamination.leaked_runs(load(spark, d, "documents"), "doc_id", "text", load(spark, d, "eval_items"), "item_id", "text")
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p8_paraphrases(spark: SparkSession, d: str) -> DataFrame:
    found = contamination.paraphrases(load(spark, d, "documents"), "doc_id", "text", load(spark, d, "eval_items"), "item_id", "text")
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "cosine", "in_order", "answer")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mix itself: which document stands in which slot, in order."""
    m, _ = mixing.mix(load(spark, d, "documents"), "doc_id", "source", "text", load(spark, d, "mix_targets"))
    return m.withColumnRenamed("id", "doc_id")


def p9_uses(spark: SparkSession, d: str) -> DataFrame:
    used, _ = mixing.uses(load(spark, d, "documents"), "doc_id", "source", "text", load(spark, d, "mix_targets"))
    return used.withColumnRenamed("id", "doc_id")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.report(*mixing.uses(load(spark, d, "documents"), "doc_id", "source", "text", load(spark, d, "mix_targets")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled.garbled_keys(load(spark, d, "documents"), "doc_id", "text")


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return garbled.garbled(load(spark, d, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p3_found, p3_groups, p5_found, p5_matches, p6_found, p8_found, p8_paraphrases, p9_mix, p9_uses, p9_shares, p10_found, p10_restored)}

ORACLE: dict[str, str] = {
    "p6_found": f"""WITH RECURSIVE x AS (SELECT * FROM semantic_candidates QUALIFY row_number() OVER (PARTITION BY source_kind, source_ref, candidate_field_id ORDER BY created_at DESC) = 1),
l AS (SELECT source_ref AS a, candidate_field_id AS b FROM x WHERE score >= {LINK_SCORE} AND source_ref <> candidate_field_id), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(id, reached) AS (SELECT a, a FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.reached) SELECT id AS record_id, min(reached) AS group_id FROM r GROUP BY 1""",
}
