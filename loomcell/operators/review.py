"""Candidates, families and actions under review: set logic over small facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcell.functions import scalars as S
from loomcell.runtime import spread_previous


def unordered(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b).alias("left_id"), F.greatest(a, b).alias("right_id")


def fresh_pairs(found: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (left_id, right_id, score) not written yet: repeated ones once, with
    their best score, in either order; self pairs are none."""
    f = found.where("left_id <> right_id").select(*unordered(F.col("left_id"), F.col("right_id")), "score").groupBy("left_id", "right_id").agg(F.max("score").alias("score"))
    return f.join(known.select(*unordered(F.col("left_id"), F.col("right_id"))).distinct(), ["left_id", "right_id"], "left_anti")


def review_once(candidates: DataFrame, reviews: DataFrame) -> DataFrame:
    """The first review (id, candidate_id, decision) of a candidate counts, later ones
    are refused: candidate id, decision (`pending` without review), n_refused, and the
    relation that an alias or related decision makes."""
    r = reviews.where("candidate_id is not null").groupBy("candidate_id").agg(F.min(F.struct("id", "decision")).alias("r"), (F.count_distinct("id") - 1).alias("n_refused"))
    j = candidates.select("id").distinct().join(r.withColumnRenamed("candidate_id", "id"), "id", "left")
    d = F.coalesce("r.decision", F.lit("pending"))
    return j.select("id", d.alias("decision"), F.coalesce("n_refused", F.lit(0)).alias("n_refused"), F.when(d == "alias", "alias_of").when(d == "related", "related_to").alias("relation"))


def family_basis(members: DataFrame, fields: DataFrame) -> DataFrame:
    """members (family_id, field_id) with the current fields (id, key, status,
    updated_at): family_id, n_members, basis. Whatever changes a member changes it."""
    j = members.select("family_id", F.col("field_id").alias("id")).distinct().join(fields, "id", "left")
    row = F.concat_ws("|", "id", F.coalesce("key", F.lit("")), F.coalesce("status", F.lit("")), F.coalesce(F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("")))
    return j.groupBy("family_id").agg(F.count("*").alias("n_members"), F.sha2(F.array_join(F.array_sort(F.collect_list(row)), "\n"), 256).alias("basis"))  # a family has few members


def stale(before: DataFrame, after: DataFrame) -> DataFrame:
    """family_id and whether its basis changed or its family is gone."""
    return before.select("family_id", F.col("basis").alias("b1")).join(after.select("family_id", F.col("basis").alias("b2")), "family_id", "left").select("family_id", (~F.col("b1").eqNullSafe(F.col("b2"))).alias("stale"))


def overlaps(members: DataFrame) -> DataFrame:
    """Fields that are members of more than one family: field_id, n_families, first."""
    g = members.select("family_id", "field_id").distinct().groupBy("field_id").agg(F.count("*").alias("n_families"), F.min("family_id").alias("first_family"))
    return g.where("n_families > 1")


def partition_check(whole: DataFrame, parts: DataFrame, key: str, item: str) -> DataFrame:
    """Whether the parts (key, part, item) of each key split its whole (key, item)
    exactly: every item in exactly one part, none foreign; n_missing, n_foreign,
    n_doubled, exact. Keys of either side have a row."""
    w = whole.select(key, item).distinct().withColumn("w", F.lit(1))
    p = parts.groupBy(key, item).agg(F.count_distinct("part").alias("n"))
    j = w.join(p, [key, item], "full_outer")
    g = j.groupBy(key).agg(F.count_if(F.col("n").isNull()).alias("n_missing"), F.count_if(F.col("w").isNull()).alias("n_foreign"), F.count_if(F.col("n") > 1).alias("n_doubled"))
    return g.withColumn("exact", (F.col("n_missing") + F.col("n_foreign") + F.col("n_doubled")) == 0)


#: Properties that an action must state before it is decided.
REQUIRED = ("external", "shared_world", "authority_domain", "resource_owner", "irreversible", "cost_units")


def decide(actions: DataFrame, envelope: dict) -> DataFrame:
    """Decisions on actions by precedence: a disputed or incompatible consensus
    escalates, one on another basis defers, an unstated property defers, what is not
    delegated escalates, what costs too much defers, the rest is executed. With all
    reasons in order, and decision and reasons also where several apply.

    actions: id, consensus and the REQUIRED columns (null: not stated). envelope:
    allow_external, allow_shared_world, allow_irreversible, authority_domains,
    resource_owners, max_cost_units."""
    missing = F.lit(False)
    for c in REQUIRED:
        missing = missing | F.col(c).isNull()
    conflict, other_basis = F.col("consensus").isin("disputed", "incompatible"), F.col("consensus") == "basis_incompatible"
    crossed = [(F.col("external") & F.lit(not envelope["allow_external"]), "external_effect_not_delegated"), (F.col("shared_world") & F.lit(not envelope["allow_shared_world"]), "shared_world_effect_not_delegated"),
               (~F.col("authority_domain").isin(*envelope["authority_domains"]), "authority_domain_not_delegated"), (~F.col("resource_owner").isin(*envelope["resource_owners"]), "resource_owner_not_delegated"),
               (F.col("irreversible") & F.lit(not envelope["allow_irreversible"]), "irreversible_effect_not_delegated")]
    dear = F.col("cost_units") > F.lit(envelope["max_cost_units"])
    bounds = F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in crossed]))
    all_ = F.concat(bounds, F.when(dear, F.array(F.lit("cost_exceeds_envelope"))).otherwise(F.array().cast("array<string>")))
    conflict, other_basis = F.coalesce(conflict, F.lit(False)), F.coalesce(other_basis, F.lit(False))
    decision = F.when(conflict, "ESCALATE").when(other_basis | missing, "DEFER").when(F.size(bounds) > 0, "ESCALATE").when(dear, "DEFER").otherwise("EXECUTE")
    reasons = (F.when(conflict, F.array(F.lit("consensus_conflict"))).when(other_basis, F.array(F.lit("consensus_basis_incompatible"))).when(missing, F.array(F.lit("effect_classification_incomplete")))
               .when(F.size(all_) > 0, all_).otherwise(F.array(F.lit("inside_autonomy_envelope"))))
    return actions.select("id", decision.alias("decision"), F.array_join(reasons, ",").alias("reasons"))


def versions(changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Number the versions of each key from 1 in a total order, whatever its size."""
    v = spread_previous(changes.withColumn("__v", F.lit(0)), key, order, "__v")
    return v.withColumn("version", F.col("nth") + 1).drop("prev", "nth", "__v")


def signals(actions: DataFrame, links: DataFrame) -> DataFrame:
    """Proposals that linked runs made or found pending: the first action of each run
    and key. actions (id, run_id, ordinal, intent, outcome, key, value_type), links
    (run_id, campaign_id, backend, root, basis)."""
    a = actions.where("intent = 'create_proposal' and outcome in ('CREATED_PROPOSAL', 'SKIPPED_PENDING_PROPOSAL')")
    a = a.withColumn("key", S.field_key("key")).where("key is not null")
    first = a.groupBy("run_id", "key").agg(F.min(F.struct("ordinal", "id", "value_type", "label")).alias("f"))
    return first.select("run_id", "key", "f.ordinal", F.col("f.id").alias("action_id"), "f.value_type", "f.label").join(links, "run_id")


def leases(claims: DataFrame, now: Column) -> DataFrame:
    """The latest claim per item with its state: active, expired once its time has
    come; claims (item, claim_id, at, expires_at)."""
    w = claims.groupBy("item").agg(F.max(F.struct("at", "claim_id", "expires_at")).alias("c"))
    return w.select("item", F.col("c.claim_id").alias("claim_id"), F.when(F.col("c.expires_at") <= now, "expired").otherwise("active").alias("state"))
