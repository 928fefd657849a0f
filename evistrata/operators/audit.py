"""Audit of claims, evidence, sections and process as issue rows.

Every check yields rows of (check, claim_id, side, entity_id).  References are
exploded once per kind and meet the entity tables in equi-joins; all checks of a
kind are decided in that one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evistrata.functions.values import outcome_filter_reasons
from evistrata.operators.extraction import INACTIVE
from evistrata.operators.synthesis import claim_sides

ISSUE_COLUMNS = ("check", "claim_id", "side", "entity_id")

# Report category of each check; all others go to protocol compliance.
CATEGORIES = {
    "unsupported_claims": ("unsupported_claim", "missing_citation"),
    "scope_violations": (
        "scope_violation", "adjacent_intervention_leakage", "population_level_overgeneralization",
        "animal_to_human_extrapolation", "correlation_to_causation_inflation", "unreported_field_hallucination",
    ),
    "invalid_quotes": ("invalid_quote", "unverified_critical_quote"),
    "contradiction_omissions": ("contradiction_omission",),
    "citation_failures": (
        "citation_key_resolution_failure", "duplicate_study_counting", "citation_to_excluded_study",
        "citation_to_unlinked_study", "included_ineligible_evidence", "unknown_study_citation_in_text",
        "superseded_outcome_reference", "superseded_evidence_reference", "stale_extraction_reference",
    ),
}
OTHER_CATEGORY = "protocol_compliance"
FILTER_CHECKS = {
    "outcome_domain_not_matched": "outcome_domain_outside_section",
    "effect_direction_not_matched": "effect_direction_outside_section",
    "support_relation_not_matched": "support_relation_outside_section",
}


def _checks(*pairs: tuple[Column, str | Column]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(when, F.lit(False)), F.lit(name) if isinstance(name, str) else name) for when, name in pairs]))


def _sided(suffix: str) -> Column:
    return F.concat("side", F.lit(f"_{suffix}"))


def _issues(df: DataFrame, checks: Column, entity: str | Column | None = None, claim: bool = True, side: bool = True) -> DataFrame:
    none = F.lit(None).cast("string")
    entity = none if entity is None else (F.col(entity) if isinstance(entity, str) else entity)
    rows = df.withColumn("_checks", checks).select(
        (F.col("claim_id") if claim else none).alias("claim_id"), (F.col("side") if side else none).alias("side"),
        entity.cast("string").alias("entity_id"), F.explode_outer("_checks").alias("check"))
    return rows.filter(F.col("check").isNotNull()).select(*ISSUE_COLUMNS)


def union_issues(parts: Sequence[DataFrame]) -> DataFrame:
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    return total


# --- claims ---------------------------------------------------------------

def claim_issues(claims: DataFrame) -> DataFrame:
    """Support, scope, population, causality, fields and qualifiers of each claim."""
    unsupported = (F.col("support_level") == "unsupported") | (F.size("supporting_studies") == 0)
    checks = _checks(
        (unsupported, "unsupported_claim"), (unsupported, "missing_citation"),
        (F.col("protocol_scope_status") == "outside", "scope_violation"),
        (F.col("protocol_scope_status") == "adjacent", "adjacent_intervention_leakage"),
        (F.col("population_overgeneralization"), "population_level_overgeneralization"),
        (F.col("animal_to_human"), "animal_to_human_extrapolation"), (F.col("causal_inflation"), "correlation_to_causation_inflation"),
        (F.size("unreported_field_claims") > 0, "unreported_field_hallucination"),
        (F.size("missing_required_qualifiers") > 0, "missing_required_qualifier"))
    return _issues(claims, checks, side=False)


def repeated_studies(claims: DataFrame) -> DataFrame:
    """Studies counted more than once on one side of a claim."""
    rows = claim_sides(claims).select("claim_id", "side", F.explode("studies").alias("study_id"))
    return rows.groupBy("claim_id", "side", "study_id").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")


def study_issues(claims: DataFrame, studies: DataFrame, members: DataFrame, link_required: bool = True) -> DataFrame:
    """Cited studies that repeat, are unknown, excluded, outside the section or unlinked.

    ``studies``: study_id, eligible, linked; ``members``: section_id, study_id.
    """
    cited = claim_sides(claims, "section_id").select("claim_id", "section_id", "side", F.explode("studies").alias("study_id"))
    counted = cited.groupBy("claim_id", "section_id", "side", "study_id").agg(F.count(F.lit(1)).alias("_times"))
    joined = (
        counted.join(studies.select("study_id", "eligible", "linked"), "study_id", "left")
        .join(members.select("section_id", "study_id").distinct().withColumn("_in", F.lit(True)), ["section_id", "study_id"], "left")
    )
    unknown, excluded = F.col("eligible").isNull(), ~F.col("eligible")
    invalid = F.concat(F.lit("invalid_"), "side", F.lit("_study"))
    return _issues(joined, _checks(
        (F.col("_times") > 1, "duplicate_study_counting"), (unknown, invalid), (unknown, "citation_key_resolution_failure"),
        (excluded, invalid), (excluded, "citation_to_excluded_study"), (F.col("_in").isNull(), _sided("study_outside_section")),
        (~F.col("linked") & F.lit(link_required), "citation_to_unlinked_study")), "study_id")


# --- references and their lifecycle (J18, J19) ----------------------------

@dataclass
class History:
    """Former entities and the current extraction state.

    ``outcomes``: outcome_id, status, extraction_run_id; ``evidence``: evidence_id,
    outcome_id, status, extraction_run_id; ``state``: outcome_id, extraction_run_id.
    """

    outcomes: DataFrame
    evidence: DataFrame
    state: DataFrame
    current_run: str = ""


def reference_lifecycle(former: DataFrame, current: DataFrame, key: str, history: History) -> DataFrame:
    """superseded or stale for every id that only exists in the past."""
    past = former.join(current.select(key), key, "left_anti")
    runs = history.state.select("outcome_id", F.col("extraction_run_id").alias("_expected"))
    joined = past.join(runs, "outcome_id", "left")
    expected = F.coalesce("_expected", F.lit(history.current_run))
    stale = (expected != "") & (F.coalesce("extraction_run_id", F.lit("")) != expected)
    status = F.when(F.coalesce("status", F.lit("active")).isin(*INACTIVE), "superseded").when(stale, "stale").otherwise("superseded")
    return joined.groupBy(key).agg(F.min_by(status, F.col("status")).alias("lifecycle"))


def _as_is(df: DataFrame) -> DataFrame:
    return df


def outcome_issues(
    claims: DataFrame, outcomes: DataFrame, history: History, filters: Mapping[str, Mapping], keep: Callable[[DataFrame], DataFrame] = _as_is,
) -> tuple[DataFrame, DataFrame]:
    """Issues of cited outcomes, and the resolved (claim_id, side, outcome_id, study_id).

    ``filters`` maps section ids to their outcome filter.  Both results read the
    judged references; pass ``keep=cut_lineage`` to compute those once.
    """
    cited = claim_sides(claims, "section_id", "relation_explanation")
    empty = _issues(cited, _checks(((F.size("studies") > 0) & (F.size("outcomes") == 0), _sided("outcome_unresolved"))))
    asked = cited.select("claim_id", "section_id", "side", "studies", "relation_explanation", F.explode("outcomes").alias("outcome_id"))
    past = reference_lifecycle(history.outcomes, outcomes, "outcome_id", history)
    joined = asked.join(outcomes.select("outcome_id", "study_id", "domain", "effect_direction", "support_relation"), "outcome_id", "left").join(past, "outcome_id", "left")
    known, relation = F.col("study_id").isNotNull(), F.coalesce("support_relation", F.lit("unclear"))
    against = ((F.col("side") == "supporting") & (relation == "contradicts")) | ((F.col("side") == "contradicting") & (relation == "supports"))
    vague = relation.isin("unclear", "mixed", "neutral") & (F.coalesce("relation_explanation", F.lit("")) == "")
    reasons = F.array().cast("array<string>")
    for section, rule in filters.items():
        reasons = F.when(F.col("section_id") == section, outcome_filter_reasons(rule, F.col("domain"), F.col("effect_direction"), F.col("support_relation"))).otherwise(reasons)
    joined = joined.withColumn("_reasons", F.when(known, reasons).otherwise(F.array().cast("array<string>")))
    names = F.create_map(*[F.lit(x) for pair in FILTER_CHECKS.items() for x in pair])
    outside = F.flatten(F.transform("_reasons", lambda r: F.array(_sided("outcome_outside_section_filter"), F.try_element_at(names, r))))
    checks = F.concat(_checks(
        (~known & (F.col("lifecycle") == "superseded"), "superseded_outcome_reference"), (~known & (F.col("lifecycle") == "stale"), "stale_extraction_reference"),
        (~known & F.col("lifecycle").isNull(), _sided("outcome_unresolved")),
        (known & ~F.array_contains("studies", F.col("study_id")), _sided("outcome_wrong_study")),
        (known & against, _sided("support_relation_mismatch")), (known & against, "support_relation_mismatch"),
        (known & ~against & vague, _sided("support_relation_unclear"))), outside)
    judged = keep(joined.withColumn("_found", checks).select("claim_id", "side", "outcome_id", "study_id", "_found"))
    resolved = judged.filter(known).select("claim_id", "side", "outcome_id", "study_id").distinct()
    return union_issues([empty, _issues(judged, F.col("_found"), "outcome_id")]), resolved


def evidence_issues(
    claims: DataFrame, evidence: DataFrame, history: History, keep: Callable[[DataFrame], DataFrame] = _as_is,
) -> tuple[DataFrame, DataFrame]:
    """Issues of cited evidence, and the resolved (claim_id, side, evidence_id, study_id, outcome_id)."""
    cited = claim_sides(claims)
    empty = _issues(cited, _checks(((F.size("studies") > 0) & (F.size("refs") == 0), _sided("evidence_unresolved"))))
    asked = cited.select("claim_id", "side", "studies", "outcomes", F.explode("refs").alias("evidence_id"))
    past = reference_lifecycle(history.evidence, evidence, "evidence_id", history)
    joined = asked.join(evidence.select("evidence_id", "study_id", "outcome_id", "validation_status"), "evidence_id", "left").join(past, "evidence_id", "left")
    known, status = F.col("study_id").isNotNull(), F.coalesce("validation_status", F.lit("unverified"))
    checks = _checks(
        (~known & (F.col("lifecycle") == "superseded"), "superseded_evidence_reference"), (~known & (F.col("lifecycle") == "stale"), "stale_extraction_reference"),
        (~known & F.col("lifecycle").isNull(), _sided("evidence_unresolved")),
        (known & ~F.array_contains("studies", F.col("study_id")), _sided("evidence_wrong_study")),
        (known & ~F.array_contains("outcomes", F.col("outcome_id")), _sided("evidence_wrong_outcome")),
        (known & (status == "failed"), "invalid_quote"), (known & ~status.isin("failed", "passed"), "unverified_critical_quote"))
    judged = keep(joined.withColumn("_found", checks).select("claim_id", "side", "evidence_id", "study_id", "outcome_id", "_found"))
    resolved = judged.filter(known).select("claim_id", "side", "evidence_id", "study_id", "outcome_id").distinct()
    # A supported claim whose references all fail to resolve has no concrete location either.
    named = cited.filter("side = 'supporting' and size(studies) > 0 and size(refs) > 0")
    unlocated = named.join(resolved.filter("side = 'supporting'").select("claim_id").distinct(), "claim_id", "left_anti")
    return union_issues([empty, _issues(judged, F.col("_found"), "evidence_id"), _issues(unlocated, F.array(_sided("evidence_unresolved")))]), resolved


def linkage_issues(claims: DataFrame, outcomes: DataFrame, evidence: DataFrame) -> DataFrame:
    """Cited studies and outcomes without their own cited outcome or evidence.

    ``outcomes`` and ``evidence`` are the resolved references of the passes above.
    They come back to their claim and side, whose arrays already hold all the
    references, and are compared there.  A side that cites neither studies nor outcomes has none.
    """
    keys = ["claim_id", "side"]
    owned = outcomes.groupBy(*keys).agg(F.collect_set(F.struct("study_id", "outcome_id")).alias("_o"))
    located = evidence.groupBy(*keys).agg(F.collect_set(F.struct("study_id", "outcome_id")).alias("_e"))
    none = F.array().cast("array<struct<study_id:string,outcome_id:string>>")
    cited = claim_sides(claims).filter((F.size("studies") > 0) | (F.size("outcomes") > 0))
    rows = cited.select(*keys, F.array_distinct("studies").alias("studies")).join(owned, keys, "left").join(located, keys, "left")
    rows = rows.withColumns({"_o": F.coalesce("_o", none), "_e": F.coalesce("_e", none)})

    def has_outcome(study: Column) -> Column:
        return F.exists("_o", lambda o: o["study_id"] == study)

    def has_evidence(study: Column) -> Column:
        return F.exists("_o", lambda o: (o["study_id"] == study) & F.array_contains("_e", o))

    def named(ids: Column, suffix: str) -> Column:
        return F.transform(ids, lambda x: F.struct(_sided(suffix).alias("check"), x.alias("entity_id")))

    bare = F.array_distinct(F.transform(
        F.filter("_o", lambda o: ~F.exists("_e", lambda e: e["outcome_id"] == o["outcome_id"])), lambda o: o["outcome_id"]))
    incomplete = F.struct(F.lit("outcome_evidence_coverage_incomplete").alias("check"), F.lit(None).cast("string").alias("entity_id"))
    rows = rows.withColumn("_bare", bare)
    found = F.concat(
        named(F.filter("studies", lambda x: ~has_outcome(x)), "study_without_outcome"),
        named(F.filter("studies", lambda x: ~has_evidence(x)), "study_without_evidence"),
        named(F.col("_bare"), "outcome_without_evidence"),
        F.when(F.size("_bare") > 0, F.array(incomplete)).otherwise(F.array().cast("array<struct<check:string,entity_id:string>>")))
    exploded = rows.withColumn("_found", found).select(*keys, F.explode_outer("_found").alias("_i")).filter("_i is not null")
    return exploded.select(F.col("_i.check").alias("check"), *keys, F.col("_i.entity_id").alias("entity_id")).select(*ISSUE_COLUMNS)


# --- sections, process and configuration ----------------------------------

def omission_issues(omissions: DataFrame) -> DataFrame:
    """Contradiction omissions per claim and group."""
    return _issues(omissions, F.array(F.lit("contradiction_omission")), "group_id", side=False)


def extraction_issues(errors: DataFrame) -> DataFrame:
    """Current extraction errors (quote and schema)."""
    checks = _checks(
        (F.col("error") == "quote_verification_failed", "invalid_quote"),
        (F.col("error").isin("schema_validation_failed", "outcome_schema_validation_failed"), "schema_validation_error"))
    return _issues(errors, checks, "entity_id", claim=False, side=False)


def hash_mismatches(rows: DataFrame, current_hash: str, entity: str, column: str = "protocol_hash") -> DataFrame:
    """Artifacts made under another protocol."""
    other = rows.filter((F.coalesce(column, F.lit("")) != "") & (F.col(column) != current_hash))
    return _issues(other, F.array(F.lit("protocol_hash_mismatch")), entity, claim=False, side=False)


def citation_token_issues(tokens: DataFrame, key: str = "section_id") -> DataFrame:
    """Study tokens of the draft that no current study carries."""
    return _issues(tokens.filter(~F.col("known")), F.array(F.lit("unknown_study_citation_in_text")), "token", claim=False, side=False)


def section_issues(sections: DataFrame) -> DataFrame:
    """Section-level coverage checks.

    ``sections``: section_id, has_evidence, section_text, validated, writer_called,
    claim_count, coverage_status, recheck_status (of an independent recheck).
    """
    bare = ~F.col("has_evidence") | (F.coalesce("evidence_status", F.lit("")) == "insufficient")
    absent = (F.coalesce("section_text", F.lit("")) == "") & F.col("has_evidence")
    checks = _checks(
        (absent, "section_text_missing"), (~absent & (F.col("recheck_status") != "passed"), "claim_coverage_incomplete"),
        (~F.col("validated"), "section_coverage_missing"), (F.col("validated") & bare & F.col("writer_called"), "empty_evidence_writer_called"),
        (F.col("validated") & bare & (F.col("claim_count") > 0), "empty_evidence_section_has_claims"),
        (F.col("validated") & ~bare & (F.col("claim_count") == 0), "nonempty_section_zero_claims"),
        (F.col("validated") & (F.col("coverage_status") != "passed"), "claim_coverage_incomplete"))
    return _issues(sections, checks, "section_id", claim=False, side=False)


def missing_sections(required: DataFrame, headings: DataFrame) -> DataFrame:
    """Required titles that no heading of the draft shows."""
    return _issues(required.select("title").join(headings.select("title"), "title", "left_anti"), F.array(F.lit("missing_required_section")), "title", claim=False, side=False)


def dropped_evidence(eligible: DataFrame, memo_studies: DataFrame) -> DataFrame:
    """Eligible studies in no memo."""
    left = eligible.select("study_id").join(memo_studies.select("study_id"), "study_id", "left_anti")
    return _issues(left, F.array(F.lit("dropped_eligible_evidence")), "study_id", claim=False, side=False)


def ineligible_evidence(claims: DataFrame, studies: DataFrame) -> DataFrame:
    """Current but ineligible studies that claims cite."""
    cited = claim_sides(claims).select(F.explode("studies").alias("study_id")).distinct()
    bad = studies.filter(~F.col("eligible")).join(cited, "study_id", "left_semi")
    return _issues(bad, F.array(F.lit("included_ineligible_evidence")), "study_id", claim=False, side=False)


def process_issues(
    incomplete: DataFrame, included: DataFrame, studies: DataFrame, fulltext: DataFrame, enforcement: str, requirement: str,
) -> DataFrame:
    """Screening, linkage and full-text gates.

    ``incomplete``: record_id; ``included``: record_id, linked; ``studies``:
    study_id, study_state; ``fulltext``: record_id, fulltext_available, structured_available.
    """
    def issue(df: DataFrame, name: str, entity: str) -> DataFrame:
        return _issues(df, F.array(F.lit(name)), entity, claim=False, side=False)

    parts = []
    if enforcement == "required":
        parts += [
            issue(incomplete, "screening_required_but_incomplete", "record_id"),
            issue(included.filter(~F.col("linked")), "included_record_lacking_study_link", "record_id"),
            issue(studies.filter("study_state = 'unlinked'"), "study_lacking_source_record", "study_id")]
    if requirement == "required":
        parts.append(issue(fulltext.filter(~F.col("fulltext_available")), "included_record_lacking_full_text", "record_id"))
    elif requirement == "structured_extraction_allowed":
        parts.append(issue(fulltext.filter(~F.col("structured_available")), "included_record_lacking_structured_extraction", "record_id"))
    return union_issues(parts) if parts else issue(incomplete.filter(F.lit(False)), "", "record_id")


@dataclass(frozen=True)
class RunFlags:
    """Facts about a run that are single values."""

    claim_map_invalid: bool = False
    section_validation_failed: bool = False
    section_validation_missing: bool = False
    placeholder_synthesis_used: bool = False
    empty_search_plan: bool = False
    extra: Mapping[str, bool] = field(default_factory=dict)


def run_issues(anchor: DataFrame, flags: RunFlags) -> DataFrame:
    """Issues of single facts; ``anchor`` supplies one row."""
    checks = _checks(
        (F.lit(flags.claim_map_invalid), "claim_map_invalid"), (F.lit(flags.section_validation_failed), "section_coverage_incomplete"),
        (F.lit(flags.section_validation_missing), "section_coverage_missing"), (F.lit(flags.placeholder_synthesis_used), "placeholder_synthesis_used"),
        (F.lit(flags.empty_search_plan), "empty_search_plan"))
    return _issues(anchor.agg(F.count(F.lit(1)).alias("rows")), checks, claim=False, side=False)


def run_record_issues(runs: DataFrame, searches: DataFrame, seeds: DataFrame) -> DataFrame:
    """Issues of the facts that runs have recorded about themselves, one run per ``entity_id``.

    ``runs``: run_id, claim_map_status, section_validation (NULL: the check never ran),
    placeholder.  ``searches``: run_id, enabled (NULL: on); ``seeds``: run_id of each seed record.
    A run whose searches are all off and that has no seed record searched for nothing.
    """
    planned = searches.filter(F.coalesce("enabled", F.lit(True))).select("run_id").unionByName(seeds.select("run_id"))
    marked = runs.join(planned.distinct().withColumn("_planned", F.lit(True)), "run_id", "left")
    checks = _checks(
        (F.col("claim_map_status") == "invalid", "claim_map_invalid"), (F.col("section_validation") == "failed", "section_coverage_incomplete"),
        (F.col("section_validation").isNull(), "section_coverage_missing"), (F.col("placeholder"), "placeholder_synthesis_used"),
        (F.col("_planned").isNull(), "empty_search_plan"))
    return _issues(marked, checks, "run_id", claim=False, side=False)


# --- roll-up --------------------------------------------------------------

def category(check: str = "check") -> Column:
    out = F.lit(OTHER_CATEGORY)
    for name, checks in CATEGORIES.items():
        out = F.when(F.col(check).isin(*checks), name).otherwise(out)
    return out


def roll_up(issues: DataFrame) -> DataFrame:
    """Issues per check with their category."""
    return issues.groupBy("check").agg(F.count(F.lit(1)).alias("issues")).withColumn("category", category())


def audit_status(issues: DataFrame) -> DataFrame:
    """passed without issues, failed otherwise, with the exit code."""
    failed = F.col("issue_count") > 0
    return issues.agg(F.count(F.lit(1)).alias("issue_count")).select(
        "issue_count", F.when(failed, "failed").otherwise("passed").alias("status"), F.when(failed, 2).otherwise(0).alias("exit_code"))
