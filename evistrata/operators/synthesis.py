"""Section selection and claim linkage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evistrata.common import as_col, batch_number, number_rows
from evistrata.functions.keys import stable_id
from evistrata.functions.text import coverage_text, missing_qualifiers, sentences
from evistrata.functions.values import NOT_REPORTED, dotted, outcome_filter_reasons
from evistrata.operators.quotes import study_citations

# Rule keys that make a selection, and the prose of an empty section.
SELECTING_KEYS = (
    "study_ids", "publication_ids", "outcome_domains", "effect_directions", "support_relations",
    "study_field_equals", "study_field_in", "population_scope", "intervention_scope", "contradiction_only",
)
OUTCOME_KEYS = ("outcome_domains", "effect_directions", "support_relations")
OUTCOME_REASONS = {
    "outcome_domains": "outcome_domain_not_matched",
    "effect_directions": "effect_direction_not_matched",
    "support_relations": "support_relation_not_matched",
}
INSUFFICIENT = "Evidence is insufficient for this protocol-required section."
SIDES = ("supporting", "contradicting")


def overlay_plan(required: DataFrame, configured: DataFrame) -> DataFrame:
    """Required sections completed from configured ones of the same title, then the extra ones.

    Both: position, title, section_id (may be NULL), attributes map; required values win.
    """
    r = required.select("title", F.col("position").alias("_rp"), F.col("section_id").alias("_rid"), F.col("attributes").alias("_ra"))
    c = configured.select("title", F.col("position").alias("_cp"), F.col("section_id").alias("_cid"), F.col("attributes").alias("_ca"))
    none = F.create_map().cast("map<string,string>")
    wins = F.coalesce("_ra", none)
    merged = F.map_concat(F.map_filter(F.coalesce("_ca", none), lambda k, v: ~F.map_contains_key(wins, k)), wins)
    both = r.join(c, "title", "full_outer").withColumn("attributes", merged)
    order = F.when(F.col("_rp").isNotNull(), F.col("_rp")).otherwise(F.col("_cp") + F.lit(1 << 40))
    numbered = number_rows(both.withColumn("_order", order), [], "_order", "position")
    default = F.format_string("S%02d", F.col("position"))
    return numbered.select("position", F.coalesce("_rid", "_cid", default).alias("section_id"), "title", "attributes")


# --- section selection (J14) ----------------------------------------------

def _strings(value) -> list[str]:
    return [str(v) for v in (value if isinstance(value, (list, tuple, set)) else [value])]


def _selection_reasons(rule: Mapping, outcome_match: Column, in_contradiction: Column) -> Column:
    if rule.get("no_evidence") is True:
        return F.array(F.lit("no_evidence_requested"))
    if not rule:
        return F.array(F.lit("no_selection_rule"))
    fields = F.col("fields")

    def field(path: str) -> Column:
        return dotted(path, fields)

    reasons: list[Column] = []

    def unless(ok: Column, reason: str) -> None:
        reasons.append(F.when(~F.coalesce(ok, F.lit(False)), F.lit(reason)))

    if rule.get("study_ids"):
        unless(F.col("study_id").isin(*_strings(rule["study_ids"])), "study_id_not_selected")
    if rule.get("publication_ids"):
        unless(F.col("publication_id").isin(*_strings(rule["publication_ids"])), "publication_id_not_selected")
    for key in OUTCOME_KEYS:
        if rule.get(key):
            unless(outcome_match, OUTCOME_REASONS[key])
    for path, wanted in rule.get("study_field_equals", {}).items():
        unless(field(path) == str(wanted), f"study_field_not_equal:{path}")
    for path, allowed in rule.get("study_field_in", {}).items():
        unless(field(path).isin(*_strings(allowed)), f"study_field_not_in:{path}")
    if "population_scope" in rule:
        unless(field(rule.get("population_field", "population.scope")) == rule["population_scope"], "population_scope_not_matched")
    if "intervention_scope" in rule:
        unless(field(rule.get("intervention_field", "intervention.scope")) == rule["intervention_scope"], "intervention_scope_not_matched")
    if rule.get("contradiction_only") is True:
        unless(in_contradiction, "not_in_contradiction_group")
    if rule.get("include_all_studies") is not True and not any(k in rule for k in SELECTING_KEYS):
        reasons.append(F.lit("no_supported_filter"))
    return F.array_compact(F.array(*reasons)) if reasons else F.array().cast("array<string>")


def select_sections(
    studies: DataFrame, outcomes: DataFrame, sections: Sequence[Mapping], contradiction_studies: DataFrame | None = None,
) -> DataFrame:
    """Every eligible study under every section with the reasons against it.

    ``studies``: study_id, publication_id, fields.  The section rules are
    configuration, so they become expressions over one pass of the studies; the
    outcome filters of all sections are decided in one aggregation.
    """
    rules = [s.get("rule", {}) for s in sections]
    matches = [
        F.bool_or(F.size(outcome_filter_reasons(rule, F.col("domain"), F.col("effect_direction"), F.col("support_relation"))) == 0).alias(f"_m{i}")
        for i, rule in enumerate(rules)
    ]
    rows = studies.join(outcomes.groupBy("study_id").agg(*matches), "study_id", "left")
    if contradiction_studies is not None:
        rows = rows.join(contradiction_studies.select("study_id").distinct().withColumn("_contra", F.lit(True)), "study_id", "left")
    else:
        rows = rows.withColumn("_contra", F.lit(False))
    judged = F.array(*[
        F.struct(F.lit(s["section_id"]).alias("section_id"), _selection_reasons(rule, F.col(f"_m{i}"), F.col("_contra")).alias("reasons"))
        for i, (s, rule) in enumerate(zip(sections, rules))
    ])
    return rows.select("study_id", "publication_id", F.inline(judged)).withColumn("selected", F.size("reasons") == 0)


def section_members(selection: DataFrame) -> DataFrame:
    return selection.filter("selected").select("section_id", "study_id", "publication_id")


def section_evidence(members: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Distinct (section, kind, value, study) of the relations and directions of a section's studies."""
    pairs = F.array(
        F.struct(F.lit("relation").alias("kind"), F.col("support_relation").alias("value")),
        F.struct(F.lit("direction").alias("kind"), F.col("effect_direction").alias("value")))
    per_study = outcomes.select("study_id", F.inline(pairs)).distinct()
    return members.select("section_id", "study_id").join(per_study, "study_id").select("section_id", "kind", "value", "study_id")


def evidence_memos(members: DataFrame, outcomes: DataFrame, size: int = 25) -> DataFrame:
    """Batches of at most ``size`` studies per section, in study order."""
    numbered = number_rows(members, ["section_id"], "study_id", "rank")
    batched = numbered.withColumn("batch", batch_number("rank", size))
    listed = outcomes.groupBy("study_id").agg(F.array_sort(F.collect_list("outcome_id")).alias("outcome_ids"))
    items = F.array_sort(F.collect_list(F.struct("study_id", "publication_id", F.coalesce("outcome_ids", F.array().cast("array<string>")).alias("outcome_ids"))))
    memos = batched.join(listed, "study_id", "left").groupBy("section_id", "batch").agg(items.alias("items"))
    return memos.withColumn("memo_id", F.format_string("%s_batch_%03d", "section_id", "batch"))


def memo_studies(memos: DataFrame) -> DataFrame:
    return memos.select("section_id", F.explode("items.study_id").alias("study_id"))


def fixture_claims(members: DataFrame, outcomes: DataFrame, rules: Mapping[str, Mapping], size: int = 25) -> DataFrame:
    """Deterministic claims, one per memo batch (X4): each study's first matching outcome with evidence.

    ``outcomes``: outcome_id, study_id, domain, effect_direction, support_relation,
    seq, evidence_id (first location, NULL without one).
    """
    located = outcomes.filter("evidence_id is not null")
    joined = members.select("section_id", "study_id").join(located, "study_id")
    unmatched = F.lit(False)
    for section, rule in rules.items():
        bad = F.size(outcome_filter_reasons(rule, F.col("domain"), F.col("effect_direction"), F.col("support_relation"))) > 0
        unmatched = unmatched | ((F.col("section_id") == section) & bad)
    first = joined.filter(~unmatched).groupBy("section_id", "study_id").agg(
        F.min_by(F.struct("outcome_id", "evidence_id", "support_relation"), F.struct("seq", "outcome_id")).alias("o"))
    ranked = number_rows(first, ["section_id"], "study_id", "rank")
    batched = ranked.withColumn("batch", batch_number("rank", size)).withColumn("against", F.col("o.support_relation") == "contradicts")

    def listed(keep: Column, value: Column) -> Column:
        sorted_pairs = F.array_sort(F.collect_list(F.when(keep, F.struct("study_id", value.alias("v")))))
        return F.transform(sorted_pairs, lambda p: p["v"])

    for_side, against = ~F.col("against"), F.col("against")
    study = F.col("study_id")
    claims = batched.groupBy("section_id", "batch").agg(
        listed(F.lit(True), study).alias("cited"),
        listed(for_side, study).alias("supporting_studies"), listed(against, study).alias("contradicting_studies"),
        listed(for_side, F.col("o.outcome_id")).alias("supporting_outcomes"), listed(against, F.col("o.outcome_id")).alias("contradicting_outcomes"),
        listed(for_side, F.col("o.evidence_id")).alias("supporting_evidence_refs"), listed(against, F.col("o.evidence_id")).alias("contradicting_evidence_refs"))
    marks = F.array_join(F.transform("cited", lambda s: F.concat(F.lit("["), s, F.lit("]"))), " ")
    sentence = F.concat(F.lit("Eligible evidence for this section was reported by "), F.size("cited").cast("string"), F.lit(" study record(s) "), marks, F.lit("."))
    level = F.when((F.size("supporting_studies") > 0) & (F.size("contradicting_studies") > 0), "mixed").when(F.size("supporting_studies") > 0, "supported").otherwise("unsupported")
    return claims.withColumn("sentence", sentence).withColumn("support_level", level).withColumn("claim_id", stable_id("claim", "section_id", "sentence")).drop("cited")


# --- coverage of section prose by claims (J30) ----------------------------

def section_coverage_errors(
    sections: DataFrame, members: DataFrame, eligible: DataFrame, ignore: Sequence[str] = (),
    insufficient: str = INSUFFICIENT, prefixes: Sequence[str] = (), patterns: Sequence[str] = (),
) -> DataFrame:
    """Disagreements of section text and claims (J30): (section_id, error, position, detail).

    ``sections``: section_id, section_text, claims array<struct<sentence, study_ids, citations>>.
    A section's text and claims are one row, so sentences meet claims inside it.  NULL texts and
    claims count as empty.
    """
    sections = sections.withColumns({"section_text": F.coalesce("section_text", F.lit("")), "claims": F.coalesce("claims", F.array())})
    some = members.select("section_id").distinct().withColumn("_evidence", F.lit(True))
    rows = sections.join(some, "section_id", "left").withColumn("_evidence", F.coalesce("_evidence", F.lit(False)))
    rows = rows.withColumn("_text", coverage_text("section_text")).withColumn("_claims", F.transform("claims", lambda c: coverage_text(c["sentence"])))

    def error(when: Column, name: str) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("error"), F.lit(-1).alias("position"), F.lit("").alias("detail")))

    section_level = F.array_compact(F.array(
        error(F.col("_evidence") & (F.size("claims") == 0), "nonempty_section_zero_claims"),
        error(~F.col("_evidence") & (F.size("claims") > 0), "empty_evidence_section_has_claims")))
    texts = F.col("_text")
    claim_level = F.filter(F.transform("_claims", lambda c, i: F.struct(
        F.when(c == "", "claim_sentence_empty").when(~texts.contains(c), "claim_sentence_absent_from_section").alias("error"),
        i.alias("position"), F.lit("").alias("detail"))), lambda e: e["error"].isNotNull())
    given = F.filter("_claims", lambda c: c != "")
    skipped = coverage_text(F.lit(insufficient))

    def uncovered(s: Column) -> Column:
        norm = coverage_text(s)
        plain = (norm != "") & (norm != skipped)
        for pattern in ignore:
            plain = plain & ~s.rlike(f"(?i){pattern}")
        return plain & ~F.exists(given, lambda c: c.contains(norm) | norm.contains(c))

    open_sentences = F.transform(F.filter(sentences("section_text"), uncovered), lambda s, i: F.struct(
        F.lit("substantive_sentence_not_mapped").alias("error"), i.alias("position"), s.alias("detail")))
    inside = rows.select("section_id", F.inline_outer(F.concat(section_level, claim_level, open_sentences))).filter("error is not null")

    # Study ids of claims against the section's members and the eligible set.
    cited = rows.select("section_id", F.posexplode_outer("claims").alias("position", "c")).filter("c is not null")
    cited = cited.select("section_id", "position", F.col("c.sentence").alias("sentence"), F.coalesce("c.citations", F.array().cast("array<string>")).alias("citations"),
                         F.explode("c.study_ids").alias("study_id"))
    joined = (
        cited.join(members.select("section_id", "study_id").distinct().withColumn("_in", F.lit(True)), ["section_id", "study_id"], "left")
        .join(eligible.select("study_id").distinct().withColumn("_ok", F.lit(True)), "study_id", "left")
    )
    checks = F.array_compact(F.array(
        F.when(~F.col("sentence").contains(F.col("study_id")) & ~F.array_contains("citations", F.col("study_id")), F.lit("citation_not_in_sentence_or_citation_field")),
        F.when(F.col("_in").isNull(), F.lit("study_outside_section")).when(F.col("_ok").isNull(), F.lit("study_not_eligible"))))
    ids = joined.select("section_id", F.explode(checks).alias("error"), "position", F.col("study_id").alias("detail"))

    # Study tokens of the prose against claims and known ids.
    known = members.select("study_id").unionByName(eligible.select("study_id")).distinct()
    tokens = study_citations(sections.select("section_id", F.col("section_text").alias("text")), known, "section_id", "text", "study_id", prefixes, patterns)
    mapped = cited.select("section_id", F.col("study_id").alias("token")).distinct().withColumn("_mapped", F.lit(True))
    token_rows = tokens.join(mapped, ["section_id", "token"], "left")
    token_checks = F.array_compact(F.array(
        F.when(F.col("_mapped").isNull(), F.lit("section_citation_not_in_claim_map")), F.when(~F.col("known"), F.lit("unknown_study_citation_in_text"))))
    unmapped = token_rows.select("section_id", F.explode(token_checks).alias("error"), F.lit(-1).alias("position"), F.col("token").alias("detail"))
    silent = rows.filter("_evidence").join(tokens.select("section_id").distinct(), "section_id", "left_anti").select(
        "section_id", F.lit("evidence_section_has_no_study_citation").alias("error"), F.lit(-1).alias("position"), F.lit("").alias("detail"))
    return inside.unionByName(ids).unionByName(unmapped).unionByName(silent)


def section_coverage(sections: DataFrame, errors: DataFrame) -> DataFrame:
    """Coverage status per section."""
    failed = errors.groupBy("section_id").agg(F.count(F.lit(1)).alias("errors"))
    return sections.select("section_id", F.size("claims").alias("claim_count")).join(failed, "section_id", "left").select(
        "section_id", "claim_count", F.coalesce("errors", F.lit(0)).alias("errors"), F.when(F.col("errors").isNull(), "passed").otherwise("failed").alias("coverage_status"))


# --- claim analysis -------------------------------------------------------

def claim_sides(claims: DataFrame, *carry: str) -> DataFrame:
    """One row per claim and side with its study, outcome and evidence ids."""
    nothing = F.array().cast("array<string>")
    have = set(claims.columns)

    def ids(name: str) -> Column:
        return F.coalesce(F.col(name), nothing) if name in have else nothing

    rows = F.array(*[
        F.struct(F.lit(s).alias("side"), ids(f"{s}_studies").alias("studies"), ids(f"{s}_outcomes").alias("outcomes"),
                 ids(f"{s}_evidence_refs").alias("refs")) for s in SIDES])
    return claims.select("claim_id", *carry, F.inline(rows))


def resolve_evidence(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each evidence reference of a claim with its current location or ``resolved`` false."""
    refs = claim_sides(claims).select("claim_id", "side", F.explode("refs").alias("evidence_id")).withColumn("evidence_id", F.trim("evidence_id"))
    found = evidence.select("evidence_id", "study_id", "outcome_id", F.lit(True).alias("resolved"))
    return refs.join(found, "evidence_id", "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)))


def misplaced_outcomes(claims: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Outcome ids that are unknown or belong to no study cited on the same side."""
    asked = claim_sides(claims).select("claim_id", "side", "studies", F.explode("outcomes").alias("outcome_id"))
    joined = asked.join(outcomes.select("outcome_id", "study_id"), "outcome_id", "left")
    owned = F.col("study_id").isNotNull() & F.array_contains("studies", F.col("study_id"))
    return joined.filter(~F.coalesce(owned, F.lit(False))).select("claim_id", "side", "outcome_id")


def contradiction_omissions(claims: DataFrame, members: DataFrame, eligible: DataFrame) -> DataFrame:
    """Inconsistent groups a claim draws on without accounting for all their studies.

    ``members``: (group_id, study_id) of inconsistent groups.  The omitted studies
    are counted, group size less accounted ones, and never listed per claim:
    they are the group's members not cited by the claim.
    """
    cited = claim_sides(claims).select("claim_id", "side", F.explode("studies").alias("study_id")).distinct()
    ok = eligible.select("study_id").distinct().withColumn("_ok", F.lit(True))
    known = cited.join(ok, "study_id", "left").withColumn("_support", (F.col("side") == "supporting") & F.col("_ok").isNotNull())
    accounted = known.groupBy("claim_id", "study_id").agg(F.bool_or("_support").alias("_support"))
    touched = accounted.join(members, "study_id").groupBy("claim_id", "group_id").agg(
        F.count(F.lit(1)).alias("accounted"), F.bool_or("_support").alias("supported"))
    sizes = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("group_size"))
    return touched.join(sizes, "group_id").select(
        "claim_id", "group_id", "supported", "accounted", (F.col("group_size") - F.col("accounted")).alias("omitted")).filter("omitted > 0")


def claim_flags(
    claims: DataFrame, studies: DataFrame, hierarchy: Sequence[str] = (), cross_pairs: Sequence[tuple[str, str]] = (),
    core: Sequence[str] = (), adjacent: Sequence[str] = (),
) -> DataFrame:
    """Scope, population and causal flags of each claim, stated or from its supporting studies.

    A flag or the population levels that the claim itself carries (``population_overgeneralization``,
    ``animal_to_human``, ``causal_inflation``, ``population_levels``) stand where they are given; a
    stated flag is never taken back by the studies.

    ``claims``: claim_id, sentence, supporting_studies, scope_status, claimed_levels,
    causal_strength, asserted_fields, required_qualifiers; ``studies``: study_id, fields.
    """
    asked = claims.select("claim_id", "asserted_fields", F.explode(F.array_distinct("supporting_studies")).alias("study_id"))
    rows = asked.join(studies.select("study_id", "fields"), "study_id")
    fields = F.col("fields")
    scope = F.coalesce(F.try_element_at(fields, F.lit("protocol.scope_status")), F.try_element_at(fields, F.lit("intervention.scope")))
    level = F.coalesce(F.try_element_at(fields, F.lit("population.evidence_level")), F.try_element_at(fields, F.lit("population.level")))
    strength = F.try_element_at(fields, F.lit("study.causal_strength"))
    known_strength = F.when(strength.isin("descriptive", "associational", "causal"), strength)
    summary = F.nullif(F.try_element_at(fields, F.lit("intervention.summary")), F.lit(""))
    reported = F.filter("asserted_fields", lambda f: ~F.coalesce(F.try_element_at(fields, f), F.lit(NOT_REPORTED)).isin("", NOT_REPORTED))
    def any_of(value: Column, wanted: Sequence[str]) -> Column:
        return F.coalesce(F.bool_or(value.isin(*wanted)), F.lit(False)) if wanted else F.lit(False)

    summed = rows.groupBy("claim_id").agg(
        any_of(scope, ["outside"]).alias("_outside"), any_of(scope, ["adjacent"]).alias("_adjacent"), any_of(scope, ["inside", "core"]).alias("_inside"),
        any_of(summary, adjacent).alias("_adjacent_summary"), F.count(summary).alias("_summaries"),
        F.count_if(summary.isin(*core) if core else F.lit(False)).alias("_core_summaries"),
        F.count(known_strength).alias("_strengths"), F.count_if(known_strength != "causal").alias("_weaker"),
        F.collect_set(F.nullif(level, F.lit(""))).alias("_levels"), F.array_distinct(F.flatten(F.collect_set(reported))).alias("_reported"))
    joined = claims.join(summed, "claim_id", "left")
    nothing = F.array().cast("array<string>")
    joined = joined.withColumn("_any", F.col("_levels").isNotNull()).withColumn("_levels", F.coalesce("_levels", nothing))

    def literal(values: Sequence[str]) -> Column:
        return F.array(*[F.lit(v) for v in values]) if values else nothing

    inferred = (
        F.when(F.col("_outside"), "outside").when(F.col("_adjacent"), "adjacent").when(F.col("_inside"), "inside")
        .when(F.col("_adjacent_summary"), "adjacent")
        .when((F.col("_summaries") > 0) & (F.col("_summaries") == F.col("_core_summaries")), "inside").otherwise("unclear"))
    stated = F.col("scope_status")
    order = literal(hierarchy)

    def top_rank(values: Column) -> Column:
        return F.array_max(F.filter(F.transform(values, lambda v: F.array_position(order, v)), lambda p: p > 0))

    over = F.coalesce(top_rank(F.col("claimed_levels")) > top_rank(F.col("_levels")), F.lit(False)) if hierarchy else F.lit(False)
    crossed = F.lit(False)
    for evidence_level, claim_level in cross_pairs:
        crossed = crossed | (F.array_contains("_levels", evidence_level) & F.array_contains("claimed_levels", claim_level))
    inflated = (F.col("causal_strength") == "causal") & (F.col("_strengths") > 0) & (F.col("_weaker") > 0)
    unreported = F.when(F.col("_any"), F.array_sort(F.array_except("asserted_fields", F.coalesce("_reported", nothing)))).otherwise(nothing)
    derived = {
        "protocol_scope_status": F.when(stated.isin("inside", "adjacent", "outside"), stated).otherwise(inferred),
        "population_levels": F.array_sort("_levels"), "population_overgeneralization": over, "animal_to_human": crossed,
        "causal_inflation": F.coalesce(inflated, F.lit(False)), "unreported_field_claims": unreported,
        "missing_required_qualifiers": missing_qualifiers("sentence", "required_qualifiers"),
    }
    for flag in ("population_overgeneralization", "animal_to_human", "causal_inflation"):
        if flag in claims.columns:
            derived[flag] = F.coalesce(F.col(flag), F.lit(False)) | derived[flag]
    if "population_levels" in claims.columns:
        given = F.filter(F.coalesce("population_levels", nothing), lambda v: v != "")
        derived["population_levels"] = F.when(F.size(given) > 0, F.array_sort(F.array_distinct(given))).otherwise(derived["population_levels"])
    own = [c for c in claims.columns if c not in derived]
    return joined.select(*own, *[value.alias(name) for name, value in derived.items()])


def linkage_status(claims: DataFrame, evidence: DataFrame, outcomes: DataFrame) -> DataFrame:
    """complete, study_only_linkage or evidence_linkage_incomplete per claim."""
    refs = resolve_evidence(claims, evidence).groupBy("claim_id").agg(
        F.count_if("resolved").alias("_resolved"), F.count_if(~F.col("resolved")).alias("_unresolved"))
    wrong = misplaced_outcomes(claims, outcomes).groupBy("claim_id").agg(F.count(F.lit(1)).alias("_wrong"))
    sums = claim_sides(claims).groupBy("claim_id").agg(
        F.sum(F.size("studies")).alias("_studies"), F.sum(F.size("outcomes") + F.size("refs")).alias("_explicit"))
    joined = sums.join(refs, "claim_id", "left").join(wrong, "claim_id", "left")
    zero = F.lit(0)
    broken = (F.coalesce("_wrong", zero) > 0) | (F.coalesce("_unresolved", zero) > 0)
    status = (
        F.when((F.col("_studies") > 0) & (F.col("_explicit") == 0), "study_only_linkage").when(broken, "evidence_linkage_incomplete")
        .when((F.col("_studies") > 0) & (F.coalesce("_resolved", zero) > 0), "complete").otherwise("evidence_linkage_incomplete"))
    return joined.select("claim_id", status.alias("linkage_status"))


def explain(value: str | Column) -> Column:
    """Selection reasons for display; a selected study is included by rule."""
    return F.when(F.size(as_col(value)) == 0, "included_by_rule").otherwise(F.array_join(as_col(value), ","))
