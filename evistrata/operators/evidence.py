"""Evidence analysis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evistrata.functions.values import NOT_REPORTED

# Arm roles that are compared against.
COMPARATOR_ROLES = ("comparator", "control")


def study_outcome_sets(outcomes: DataFrame) -> DataFrame:
    """Sorted distinct domains, directions, relations and quote statuses per study."""
    statuses = F.flatten(F.collect_set(F.array_sort(F.array_distinct(F.transform("evidence", lambda e: F.coalesce(e["validation_status"], F.lit("pending")))))))
    return outcomes.groupBy("study_id").agg(
        F.array_sort(F.collect_set(F.coalesce("domain", F.lit(NOT_REPORTED)))).alias("outcome_domains"),
        F.array_sort(F.collect_set(F.coalesce("effect_direction", F.lit("unclear")))).alias("effect_directions"),
        F.array_sort(F.collect_set(F.coalesce("support_relation", F.lit("unclear")))).alias("support_relations"),
        F.array_sort(F.array_distinct(statuses)).alias("quote_statuses"))


def comparisons(arms: str | Column) -> Column:
    """Ids of experimental arms against comparator arms of one study."""
    arms = F.col(arms) if isinstance(arms, str) else arms
    role = lambda a: F.coalesce(a["role"], F.lit(""))
    left = F.filter(arms, lambda a: ~role(a).isin(*COMPARATOR_ROLES))
    right = F.filter(arms, lambda a: role(a).isin(*COMPARATOR_ROLES))
    return F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: F.concat(a["arm_id"], F.lit("__vs__"), b["arm_id"]))))


def evidence_matrix(studies: DataFrame, publications: DataFrame, outcomes: DataFrame, eligible: DataFrame, per_comparison: bool = False) -> DataFrame:
    """One row per eligible study, or per study and arm comparison."""
    chosen = studies.join(eligible.select("study_id").distinct(), "study_id", "left_semi")
    rows = chosen.join(publications, "publication_id", "left").join(study_outcome_sets(outcomes), "study_id", "left")
    nothing = F.array().cast("array<string>")
    rows = rows.withColumns({n: F.coalesce(n, nothing) for n in ("outcome_domains", "effect_directions", "support_relations")})
    rows = rows.withColumn("quote_statuses", F.when(F.size(F.coalesce("quote_statuses", nothing)) == 0, F.array(F.lit(NOT_REPORTED))).otherwise(F.col("quote_statuses")))
    if not per_comparison:
        return rows
    return rows.withColumn("comparison_id", F.explode_outer(comparisons("arms"))).withColumn(
        "comparison_id", F.coalesce("comparison_id", F.lit("not_applicable")))


def inconsistent(relation: str = "support_relation") -> Column:
    """TRUE when a group holds a mixed relation, or both support and contradiction (A10)."""
    r = F.col(relation)
    return F.bool_or(r == "mixed") | (F.bool_or(r == "supports") & F.bool_or(r == "contradicts"))


def eligible_only(outcomes: DataFrame, eligible: DataFrame | None) -> DataFrame:
    """Outcomes of eligible studies; all of them without a gate."""
    return outcomes if eligible is None else outcomes.join(eligible.select("study_id").distinct(), "study_id", "left_semi")


def contradiction_groups(outcomes: DataFrame, dimensions: Sequence[str], eligible: DataFrame | None = None) -> DataFrame:
    """Outcome groups of eligible studies over the claim dimensions with their relations.

    Directions and relations are closed vocabularies; the members of a group are
    left in :func:`group_members`, since one group may hold most of the outcomes.
    """
    keyed = with_group(eligible_only(outcomes, eligible), dimensions)
    return keyed.groupBy("group_id", *dimensions).agg(
        F.count(F.lit(1)).alias("outcomes"), F.countDistinct("study_id").alias("studies"),
        F.array_sort(F.collect_set("effect_direction")).alias("effect_directions"),
        F.array_sort(F.collect_set("support_relation")).alias("support_relations"),
        inconsistent().alias("has_directional_inconsistency"))


def with_group(outcomes: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Outcomes with absent dimensions shown as the not-reported mark, and their group id.

    The id joins the dimensions with ``|``; a bar or backslash inside one is escaped, so
    different dimensions never share an id.
    """
    shown = outcomes.withColumns({d: F.coalesce(F.nullif(d, F.lit("")), F.lit(NOT_REPORTED)) for d in dimensions})
    parts = [F.regexp_replace(F.col(d).cast("string"), r"([|\\])", r"\\$1") for d in dimensions]
    return shown.withColumn("group_id", F.concat_ws("|", *parts))


def group_members(outcomes: DataFrame, dimensions: Sequence[str], eligible: DataFrame | None = None) -> DataFrame:
    """Distinct (group_id, study_id) pairs of eligible studies."""
    return with_group(eligible_only(outcomes, eligible), dimensions).select("group_id", "study_id").distinct()


def moderator_candidates(outcomes: DataFrame, dimensions: Sequence[str], moderators: Sequence[str], eligible: DataFrame | None = None) -> DataFrame:
    """Values of the moderators that vary inside a group (A11), as (group_id, moderator, value)."""
    pairs = F.array(*[F.struct(F.lit(m).alias("moderator"), F.coalesce(F.nullif(F.col(m).cast("string"), F.lit("")), F.lit(NOT_REPORTED)).alias("value")) for m in moderators])
    values = with_group(eligible_only(outcomes, eligible), dimensions).select("group_id", F.inline(pairs)).distinct()
    varying = values.groupBy("group_id", "moderator").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return values.join(varying, ["group_id", "moderator"], "left_semi")


def interpreted(groups: DataFrame, candidates: DataFrame) -> DataFrame:
    """Groups marked as having candidate explanations or observations only."""
    some = candidates.select("group_id").distinct().withColumn("_some", F.lit(True))
    note = F.when(F.col("_some"), "candidate_explanation_only").otherwise("observation_only")
    return groups.join(some, "group_id", "left").withColumn("interpretation", note).drop("_some")
