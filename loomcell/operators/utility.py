"""Utility of fields: evidence, score, recommendation, stale bases.

All evidence on a field, from however many tables, is stacked into one column set
and aggregated once: the large tables are combined before the shuffle, so one
exchange of a row per field and task serves every pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcell.functions import scalars as S

# Version, weights and bounds of the utility policy.
POLICY = "utility-v1"
COVERAGE, SUPPORT, DISTINCTNESS = 0.45, 0.40, 0.15
MIN_AGE_DAYS, CONVERGE, REVIEW = 7.0, 0.15, 0.35
#: Recommendations that change a status, and to what.
MOVES = {("active", "converge_candidate"): "converged", ("converged", "reactivate_candidate"): "active"}


def guardrails(history: DataFrame) -> DataFrame:
    """The guardrail in force per field: history (id, field_id, protected) to
    field_id, guardrail_id, protected, n_changes; the highest id rules."""
    g = history.where("field_id is not null").groupBy("field_id").agg(F.max(F.struct("id", "protected")).alias("g"), F.count_distinct("id").alias("n_changes"))
    return g.select("field_id", F.col("g.id").alias("guardrail_id"), F.col("g.protected").alias("protected"), "n_changes")


def evidence(fields: DataFrame, cells: DataFrame, views: DataFrame, candidates: DataFrame, guards: DataFrame, events: DataFrame) -> DataFrame:
    """One row per field: id, status, times, and what speaks for it.

    fields (id, status, created_at, updated_at), current cells (field_id,
    updated_at), views (view_id, field_id, created_at), candidates (source_kind,
    source_ref, candidate_field_id, status, score), guards (id, field_id, protected),
    events (id, field_id, event_type, created_at). Only pending candidates between
    fields count for redundancy, a null score as none; the converging event and the
    guardrail with the highest id rule. A field without evidence has zeros."""
    names = {"status": "string", "created_at": "timestamp_ntz", "updated_at": "timestamp_ntz", "cell_at": "timestamp_ntz", "is_cell": "int", "is_view": "int", "view_at": "timestamp_ntz",
             "redundancy": "double", "guard": "struct<id:bigint,protected:boolean>", "converged": "struct<id:bigint,at:timestamp_ntz>"}

    def facts(df: DataFrame, field: Column, **given: Column) -> DataFrame:
        return df.select(field.alias("field_id"), *[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in names.items()])

    pend = candidates.where("source_kind = 'field' and status = 'pending' and score is not null")
    parts = [
        facts(fields, F.col("id"), status=F.col("status"), created_at=F.col("created_at"), updated_at=F.col("updated_at")),
        facts(cells, F.col("field_id"), cell_at=F.col("updated_at"), is_cell=F.lit(1)),
        facts(views.groupBy("view_id", "field_id").agg(F.max("created_at").alias("created_at")), F.col("field_id"), is_view=F.lit(1), view_at=F.col("created_at")),
        facts(pend, F.col("source_ref"), redundancy=F.col("score")),
        facts(pend, F.col("candidate_field_id"), redundancy=F.col("score")),
        facts(guards, F.col("field_id"), guard=F.struct(F.col("id").cast("bigint").alias("id"), F.col("protected").alias("protected"))),
        facts(events.where("event_type = 'converged'"), F.col("field_id"), converged=F.struct(F.col("id").cast("bigint").alias("id"), F.col("created_at").alias("at"))),
    ]
    every = reduce(DataFrame.unionByName, parts).where("field_id is not null")
    g = every.groupBy("field_id").agg(
        F.max("status").alias("status"), F.max("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"), F.coalesce(F.sum("is_cell"), F.lit(0)).alias("n_cells"),
        F.max("cell_at").alias("latest_cell_at"), F.coalesce(F.sum("is_view"), F.lit(0)).alias("n_views"), F.max("view_at").alias("latest_view_at"), F.coalesce(F.max("redundancy"), F.lit(0.0)).alias("redundancy"),
        F.max("guard").alias("g"), F.max("converged").alias("c"))
    return g.where("status is not null").select("field_id", "status", "created_at", "updated_at", "n_cells", "latest_cell_at", "n_views", "latest_view_at", "redundancy",
                                                F.col("g.id").alias("guardrail_id"), F.coalesce("g.protected", F.lit(False)).alias("protected"), F.col("c.at").alias("latest_converged_at"))


def assess(e: DataFrame, n_entities: int, as_of: Column) -> DataFrame:
    """Score and recommendation per row of evidence(); of no entities coverage is 0."""
    n, views = F.col("n_cells"), F.col("n_views")
    cov = n / F.lit(float(n_entities)) if n_entities else F.lit(0.0)
    raw = COVERAGE * cov + SUPPORT * F.when(views > 0, 1.0).otherwise(0.0) + DISTINCTNESS * (1 - F.col("redundancy"))
    score = F.round(S.clamp(raw, 0.0, 1.0), 6)
    age = F.greatest(F.lit(0.0), S.age_days(F.col("created_at"), as_of))
    out = e.select("field_id", "status", "n_cells", F.round(cov, 6).alias("coverage"), "n_views", F.round("redundancy", 6).alias("redundancy"), F.round(age, 6).alias("age_days"), "protected",
                   S.strictly_after(F.col("latest_cell_at"), F.col("latest_converged_at")).alias("cell_after"), S.strictly_after(F.col("latest_view_at"), F.col("latest_converged_at")).alias("view_after"), score.alias("score"))
    empty, old = (F.col("n_cells") == 0) & (F.col("n_views") == 0), F.col("age_days") >= MIN_AGE_DAYS
    advice = (F.when(~F.col("status").isin("active", "converged"), "keep")
              .when(F.col("status") == "converged", F.when(F.col("cell_after") | F.col("view_after"), "reactivate_candidate").otherwise("keep"))
              .when(F.col("protected"), "keep").when(F.lit(n_entities == 0), "insufficient_evidence").when(empty & ~old, "insufficient_evidence")
              .when(empty & (F.col("score") <= CONVERGE), "converge_candidate").when(F.col("score") < REVIEW, "review").otherwise("keep"))
    return out.withColumn("recommendation", advice)


def basis(e: DataFrame, n_entities: int) -> DataFrame:
    """A digest per field of all that an assessment rests on: field_id, basis."""

    def at(c: str) -> Column:
        return F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit(""))

    parts = [F.col("field_id"), F.col("status"), at("updated_at"), F.lit(str(n_entities)), F.col("n_cells").cast("string"), at("latest_cell_at"), F.col("n_views").cast("string"), at("latest_view_at"),
             F.round(F.col("redundancy") * 1e6).cast("bigint").cast("string"), F.coalesce(F.col("guardrail_id").cast("string"), F.lit("")), F.col("protected").cast("string"), at("latest_converged_at"), F.lit(POLICY)]
    return e.select("field_id", F.sha2(F.concat_ws("|", *parts), 256).alias("basis"))


def apply(assessed: DataFrame, then: DataFrame, now: DataFrame) -> DataFrame:
    """What applying assessments would do: outcome and new_status. Not actionable
    ones and those whose basis has changed since move nothing."""
    j = assessed.join(then.withColumnRenamed("basis", "b1"), "field_id").join(now.withColumnRenamed("basis", "b2"), "field_id", "left")
    target = None
    for (status, advice), to in MOVES.items():
        hit = (F.col("status") == status) & (F.col("recommendation") == advice)
        target = F.when(hit, to) if target is None else target.when(hit, to)
    j = j.withColumn("to", target)
    outcome = F.when(F.col("to").isNull(), "not_actionable").when(~F.col("b1").eqNullSafe(F.col("b2")), "stale").otherwise("applied")
    return j.select("field_id", "status", "recommendation", outcome.alias("outcome"), F.when(outcome == "applied", F.col("to")).otherwise(F.col("status")).alias("new_status"))
