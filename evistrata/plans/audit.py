"""Audit queries (A18, A21, J18, J19, J31, J32 and the issue checks)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evistrata.common import cut_lineage
from evistrata.operators import audit as ops
from evistrata.operators import eligibility as gate
from evistrata.operators import quotes as citations
from evistrata.operators import synthesis as S
from evistrata.plans import screening as screening_plans
from evistrata.plans import synthesis as synthesis_plans
from evistrata.plans.bindings import LEDGER_SQL, OUTCOMES_SQL, STUDIES_SQL, SYNTHESIS_SQL, claims, described_studies, evidence, ledger, links, outcomes, universe
from evistrata.plans.registry import query, table

RULES = {"S01": {}, "S02": {"outcome_domains": ["d1", "d2", "d3"], "support_relations": ["supports"]}, "S03": {"effect_directions": ["increase", "decrease"]}}


def audit_studies(spark, d):
    return described_studies(spark, d).select("study_id", (F.col("seq") % 4 != 3).alias("eligible"), (F.col("seq") % 7 != 0).alias("linked"), "seq")


def members(spark, d):
    s = described_studies(spark, d)
    return s.select(F.explode(F.array(*[F.lit(f"S0{i}") for i in (1, 2, 3, 4)])).alias("section_id"), "study_id", "seq").filter("section_id <> 'S04' or seq % 2 = 0")


def history(spark, d, current=None):
    current = outcomes(spark, d) if current is None else current
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    n = k.cast("string")
    former = o.filter(k % 5 == 0).select(F.concat(F.lit("old"), n).alias("outcome_id"), F.when(k % 2 == 0, "superseded").otherwise("active").alias("status"), F.lit("run1").alias("extraction_run_id"))
    stale = o.filter(k % 9 == 0).select(F.concat(F.lit("stale"), n).alias("evidence_id"), F.concat(F.lit("o"), n, F.lit("-1")).alias("outcome_id"),
                                        F.when(k % 27 == 0, "resolved").otherwise("active").alias("status"), F.when(k % 2 == 0, "run1").otherwise("run2").alias("extraction_run_id"))
    state = current.select("outcome_id", F.lit("run2").alias("extraction_run_id"))
    return ops.History(former, stale, state, "run2")


AUDIT_SQL = f"""
{OUTCOMES_SQL}, {SYNTHESIS_SQL},
ast as (select study_id, k % 4 <> 3 as eligible, k % 7 <> 0 as linked from st),
memb as (select section_id, study_id from st, (select unnest(['S01', 'S02', 'S03', 'S04']) as section_id) where section_id <> 'S04' or k % 2 = 0),
side as (select claim_id, section_id, k, 'supporting' as side from cl union all select claim_id, section_id, k, 'contradicting' from cl)"""
CLAIM_ISSUES_SQL = """
select 'unsupported_claim' as "check", claim_id, null as side, null as entity_id from un union all select 'missing_citation', claim_id, null, null from un
union all select 'scope_violation', claim_id, null, null from flag where scope = 'outside' union all select 'adjacent_intervention_leakage', claim_id, null, null from flag where scope = 'adjacent'
union all select 'population_level_overgeneralization', claim_id, null, null from flag where over = 1 union all select 'animal_to_human_extrapolation', claim_id, null, null from flag where crossed = 1
union all select 'correlation_to_causation_inflation', claim_id, null, null from flag where inflated = 1
union all select 'unreported_field_hallucination', claim_id, null, null from flag where unreported <> '' union all select 'missing_required_qualifier', claim_id, null, null from flag where missing <> ''"""
UNSUPPORTED_SQL = "un as (select claim_id from cl where k % 31 = 0 or (k % 50 = 1 and k % 3 <> 0 and k % 40 <> 0))"


@query("audit_claim_issues", f"with {synthesis_plans.FLAGS_SQL}, {UNSUPPORTED_SQL} {CLAIM_ISSUES_SQL}")
def claim_issues(spark, d):
    return ops.claim_issues(synthesis_plans.flagged(spark, d))


@query("a21_repeated_studies", f"with {OUTCOMES_SQL}, {SYNTHESIS_SQL} select claim_id, side, study_id, count(*) as times from cst group by 1, 2, 3 having count(*) > 1")
def a21(spark, d):
    return ops.repeated_studies(claims(spark, d))


STUDY_ISSUES_SQL = """
select 'duplicate_study_counting' as "check", claim_id, side, study_id as entity_id from u where times > 1
union all select 'invalid_' || side || '_study', claim_id, side, study_id from u where eligible is null or not eligible
union all select 'citation_key_resolution_failure', claim_id, side, study_id from u where eligible is null
union all select 'citation_to_excluded_study', claim_id, side, study_id from u where not eligible
union all select side || '_study_outside_section', claim_id, side, study_id from u where (section_id, study_id) not in (select (section_id, study_id) from memb)
union all select 'citation_to_unlinked_study', claim_id, side, study_id from u where not linked"""
STUDY_CTE = "u as (select claim_id, section_id, side, study_id, count(*) as times, any_value(eligible) as eligible, any_value(linked) as linked from cst left join ast using (study_id) group by 1, 2, 3, 4)"


@query("audit_study_issues", f"with {AUDIT_SQL}, {STUDY_CTE} {STUDY_ISSUES_SQL}")
def study_issues(spark, d):
    return ops.study_issues(claims(spark, d), audit_studies(spark, d), members(spark, d))


HIST_SQL = """
ho as (select 'old' || o_orderkey as outcome_id, case when o_orderkey % 2 = 0 then 'superseded' else 'stale' end as life from orders where o_orderkey % 5 = 0),
he as (select 'stale' || o_orderkey as evidence_id, case when o_orderkey % 27 = 0 then 'superseded' when o_orderkey % 2 = 0 then 'stale' else 'superseded' end as life from orders where o_orderkey % 9 = 0)"""


@query("j18_j19_reference_lifecycle", f"with {OUTCOMES_SQL}, {SYNTHESIS_SQL}, {HIST_SQL} select outcome_id as id, life as lifecycle from ho union all select evidence_id, life from he")
def j19(spark, d):
    h = history(spark, d)
    a = ops.reference_lifecycle(h.outcomes, outcomes(spark, d), "outcome_id", h).select(F.col("outcome_id").alias("id"), "lifecycle")
    return a.unionByName(ops.reference_lifecycle(h.evidence, evidence(spark, d), "evidence_id", h).select(F.col("evidence_id").alias("id"), "lifecycle"))


OUTCOME_CTE = f"""{HIST_SQL},
w as (select c.*, o.study_id, o.domain, o.effect_direction, o.support_relation, h.life, (c.side = 'supporting' and o.support_relation = 'contradicts') or (c.side = 'contradicting' and o.support_relation = 'supports') as against,
  exists (select 1 from cst x where x.claim_id = c.claim_id and x.side = c.side and x.study_id = o.study_id) as own from cot c left join outc o using (outcome_id) left join ho h using (outcome_id)),
fl as (select *, unnest([case when section_id = 'S02' and domain not in ('d1', 'd2', 'd3') then 'outcome_domain_outside_section' end, case when section_id = 'S03' and effect_direction not in ('increase', 'decrease') then 'effect_direction_outside_section' end,
  case when section_id = 'S02' and support_relation <> 'supports' then 'support_relation_outside_section' end]) as outside from w where study_id is not null)"""
OUTCOME_ISSUES_SQL = """
select side || '_outcome_unresolved' as "check", claim_id, side, null as entity_id from side s where exists (select 1 from cst x where x.claim_id = s.claim_id and x.side = s.side) and not exists (select 1 from cot x where x.claim_id = s.claim_id and x.side = s.side)
union all select case when life = 'superseded' then 'superseded_outcome_reference' when life = 'stale' then 'stale_extraction_reference' else side || '_outcome_unresolved' end, claim_id, side, outcome_id from w where study_id is null
union all select side || '_outcome_wrong_study', claim_id, side, outcome_id from w where study_id is not null and not own
union all select side || '_support_relation_mismatch', claim_id, side, outcome_id from w where against union all select 'support_relation_mismatch', claim_id, side, outcome_id from w where against
union all select side || '_support_relation_unclear', claim_id, side, outcome_id from w where support_relation in ('unclear', 'mixed', 'neutral') and k % 19 <> 0
union all select side || '_outcome_outside_section_filter', claim_id, side, outcome_id from fl where outside is not null union all select outside, claim_id, side, outcome_id from fl where outside is not null"""


@query("audit_outcome_issues", f"with {AUDIT_SQL}, {OUTCOME_CTE} {OUTCOME_ISSUES_SQL}")
def outcome_issues(spark, d):
    return ops.outcome_issues(claims(spark, d), outcomes(spark, d), history(spark, d), RULES)[0]


EVIDENCE_CTE = """
cited_study as (select distinct claim_id, side, study_id, 1 as hit from cst), cited_outcome as (select distinct claim_id, side, outcome_id, 1 as hit from cot),
v as (select c.*, e.study_id, e.outcome_id, e.validation_status, h.life, x.hit is not null as own, y.hit is not null as own_outcome from cet c left join evi e using (evidence_id) left join he h using (evidence_id)
  left join cited_study x on x.claim_id = c.claim_id and x.side = c.side and x.study_id = e.study_id left join cited_outcome y on y.claim_id = c.claim_id and y.side = c.side and y.outcome_id = e.outcome_id)"""
EVIDENCE_ISSUES_SQL = """
select side || '_evidence_unresolved' as "check", claim_id, side, null as entity_id from (select claim_id, side from cst except select claim_id, side from cet)
union all select case when life = 'superseded' then 'superseded_evidence_reference' when life = 'stale' then 'stale_extraction_reference' else side || '_evidence_unresolved' end, claim_id, side, evidence_id from v where study_id is null
union all select 'supporting_evidence_unresolved', claim_id, side, null from (select claim_id, side from v where side = 'supporting' group by 1, 2 having count(study_id) = 0)
  where claim_id in (select claim_id from cst where side = 'supporting')
union all select side || '_evidence_wrong_study', claim_id, side, evidence_id from v where study_id is not null and not own union all select side || '_evidence_wrong_outcome', claim_id, side, evidence_id from v where study_id is not null and not own_outcome
union all select 'invalid_quote', claim_id, side, evidence_id from v where validation_status = 'failed' union all select 'unverified_critical_quote', claim_id, side, evidence_id from v where validation_status = 'unverified'"""


@query("audit_evidence_issues", f"with {AUDIT_SQL}, {HIST_SQL}, {EVIDENCE_CTE} {EVIDENCE_ISSUES_SQL}")
def evidence_issues(spark, d):
    return ops.evidence_issues(claims(spark, d), evidence(spark, d), history(spark, d))[0]


LINK_CTE = """
ro as (select distinct claim_id, side, outcome_id, study_id from w where study_id is not null), re as (select distinct claim_id, side, study_id, outcome_id from v where study_id is not null),
us as (select distinct claim_id, side, study_id from cst), bare as (select * from ro where not exists (select 1 from re where re.claim_id = ro.claim_id and re.side = ro.side and re.outcome_id = ro.outcome_id))"""
LINK_ISSUES_SQL = """
select side || '_study_without_outcome' as "check", claim_id, side, study_id as entity_id from us where not exists (select 1 from ro where ro.claim_id = us.claim_id and ro.side = us.side and ro.study_id = us.study_id)
union all select side || '_study_without_evidence', claim_id, side, study_id from us where not exists (select 1 from ro join re using (claim_id, side, outcome_id) where ro.claim_id = us.claim_id and ro.side = us.side and ro.study_id = us.study_id and re.study_id = us.study_id)
union all select side || '_outcome_without_evidence', claim_id, side, outcome_id from bare union all select distinct 'outcome_evidence_coverage_incomplete', claim_id, side, null from bare"""


def linkage(spark, d):
    c, o = claims(spark, d), synthesis_plans.written_outcomes(spark, d)
    h = history(spark, d, o)
    return c, ops.outcome_issues(c, o, h, RULES), ops.evidence_issues(c, evidence(spark, d, o), h)


@query("audit_linkage_issues", f"with {AUDIT_SQL}, {OUTCOME_CTE}, {EVIDENCE_CTE}, {LINK_CTE} {LINK_ISSUES_SQL}")
def linkage_issues(spark, d):
    c, (_, ro), (_, re) = linkage(spark, d)
    return ops.linkage_issues(c, ro, re)


OMIT_SQL = f"""
{synthesis_plans.GROUP_SQL}, omit as (select claim_id, group_id from (select distinct claim_id, study_id from cst) join mem using (study_id) join grp using (group_id) group by claim_id, group_id, size having size > count(*))"""


@query("audit_contradiction_omissions", f"""with {AUDIT_SQL}, {OMIT_SQL} select 'contradiction_omission' as "check", claim_id, null as side, group_id as entity_id from omit""")
def omissions(spark, d):
    o = S.contradiction_omissions(claims(spark, d), synthesis_plans.inconsistent_members(spark, d), audit_studies(spark, d).filter("eligible"))
    return ops.omission_issues(o)


@query("audit_extraction_issues", f"""
with {OUTCOMES_SQL} select case when validation_status = 'failed' then 'invalid_quote' else 'schema_validation_error' end as "check", null as claim_id, null as side, outcome_id as entity_id from outc where validation_status = 'failed' or l_orderkey % 25 = 3""")
def extraction_issues(spark, d):
    o = outcomes(spark, d).select(F.col("outcome_id").alias("entity_id"), F.try_element_at(F.col("evidence.validation_status"), F.lit(1)).alias("s"), "seq", "outcome_id")
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("sk"))
    failed = li.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("outcome_id"), (F.col("sk") % 7 == 0).alias("failed"))
    error = F.when(F.col("failed"), "quote_verification_failed").when(F.col("seq") % 25 == 3, "outcome_schema_validation_failed").otherwise("other")
    return ops.extraction_issues(o.join(failed, "outcome_id").withColumn("error", error))


@query("j31_hash_mismatches", f"""with {STUDIES_SQL} select 'protocol_hash_mismatch' as "check", null as claim_id, null as side, study_id as entity_id from link where protocol_hash = 'old'""")
def j31(spark, d):
    return ops.hash_mismatches(gate.latest_links(links(spark, d)), "new", "study_id")


@query("j32_ineligible_evidence", f"""
with {AUDIT_SQL} select 'included_ineligible_evidence' as "check", null as claim_id, null as side, study_id as entity_id from ast where not eligible and study_id in (select study_id from cst)
union all select 'dropped_eligible_evidence', null, null, study_id from ast where eligible and study_id not in (select study_id from memb where section_id = 'S04')""")
def j32(spark, d):
    s = audit_studies(spark, d)
    return ops.ineligible_evidence(claims(spark, d), s).unionByName(ops.dropped_evidence(s.filter("eligible"), members(spark, d).filter("section_id = 'S04'")))


SECTION_ROWS = """
sec as (select c_custkey as k, 'x' || c_custkey as section_id, c_custkey % 3 <> 0 as ev, case when c_custkey % 10 = 0 then '' else 'text' end as t, c_custkey % 8 <> 0 as valid, c_custkey % 4 = 1 as called,
  c_custkey % 2 as n, c_custkey % 5 <> 0 as ok, c_custkey % 7 <> 0 as re from customer)"""


@query("audit_section_issues", f"""
with {SECTION_ROWS}, e as (
select 'section_text_missing' as c, section_id from sec where t = '' and ev union all select 'claim_coverage_incomplete', section_id from sec where not (t = '' and ev) and not re
union all select 'section_coverage_missing', section_id from sec where not valid union all select 'empty_evidence_writer_called', section_id from sec where valid and not ev and called
union all select 'empty_evidence_section_has_claims', section_id from sec where valid and not ev and n > 0 union all select 'nonempty_section_zero_claims', section_id from sec where valid and ev and n = 0
union all select 'claim_coverage_incomplete', section_id from sec where valid and not ok)
select c as "check", null as claim_id, null as side, section_id as entity_id from e""")
def section_issues(spark, d):
    k = F.col("c_custkey")
    def status(ok):
        return F.when(ok, "passed").otherwise("failed")
    rows = table(spark, d, "customer").select(
        F.concat(F.lit("x"), k.cast("string")).alias("section_id"), (k % 3 != 0).alias("has_evidence"), F.when(k % 10 != 0, "text").alias("section_text"), (k % 8 != 0).alias("validated"),
        (k % 4 == 1).alias("writer_called"), (k % 2).alias("claim_count"), status(k % 5 != 0).alias("coverage_status"), status(k % 7 != 0).alias("recheck_status"), F.lit("available").alias("evidence_status"))
    return ops.section_issues(rows)


@query("audit_missing_sections", """select 'missing_required_section' as "check", null as claim_id, null as side, n_name as entity_id from nation where n_nationkey not in (select c_nationkey from customer where c_acctbal > 9900)""")
def missing_sections(spark, d):
    n = table(spark, d, "nation")
    seen = table(spark, d, "customer").filter("c_acctbal > 9900").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("title"))
    return ops.missing_sections(n.select(F.col("n_name").alias("title")), seen)


@query("audit_unknown_citations", """
select 'unknown_study_citation_in_text' as "check", null as claim_id, null as side, 'study_' || (doc_id % 3000) as entity_id from documents where doc_id % 3000 not in (select c_custkey from customer where c_custkey % 2 = 0)""")
def unknown_citations(spark, d):
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("section_id"), F.concat("text", F.lit("\nSee (study_"), (F.col("doc_id") % 3000).cast("string"), F.lit(").")).alias("text"))
    known = table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.concat(F.lit("study_"), F.col("c_custkey").cast("string")).alias("study_id"))
    return ops.citation_token_issues(citations.study_citations(texts, known))


@query("audit_process_issues", f"""
with {LEDGER_SQL}, {STUDIES_SQL}, {screening_plans.RES_SQL}, inc as ({screening_plans.REQUIRED}), e as (
select 'screening_required_but_incomplete' as c, record_id as id from states where illegal or title_state in ('missing', 'uncertain') or fulltext_state in ('missing', 'uncertain')
union all select 'included_record_lacking_study_link', record_id from inc where record_id not in (select record_id from link where record_id is not null)
union all select 'study_lacking_source_record', study_id from study where study_id not in (select study_id from link where record_id is not null)
union all select 'included_record_lacking_full_text', record_id from inc where record_id not in (select record_id from res))
select c as "check", null as claim_id, null as side, id as entity_id from e""")
def process_issues(spark, d):
    g = screening_plans._gate(spark, d, "required")
    none = table(spark, d, "customer").filter("false").select(F.lit("").alias("record_id"), F.lit("").alias("path"))
    text = gate.fulltext_status(g.included_records, screening_plans.resources(spark, d), none, none.select("path"), links(spark, d), g.studies)
    return ops.process_issues(g.incomplete_records, g.included_records, g.studies, text, "required", "required")


@query("audit_structured_extraction_gate", f"""
with {LEDGER_SQL}, {STUDIES_SQL}, inc as ({screening_plans.OPTIONAL})
select 'included_record_lacking_structured_extraction' as "check", null as claim_id, null as side, record_id as entity_id from inc
where record_id not in (select record_id from link where regexp_matches(record_id, '[13579]$'))""")
def structured_gate(spark, d):
    """Only studies of records with an odd number count as extracted."""
    g = screening_plans._gate(spark, d, "optional")
    none = table(spark, d, "customer").filter("false").select(F.lit("").alias("record_id"), F.lit("").alias("path"))
    extracted = g.studies.filter(F.col("record_id").rlike("[13579]$"))
    text = gate.fulltext_status(g.included_records, screening_plans.resources(spark, d), none, none.select("path"), links(spark, d), extracted, "structured_extraction_allowed")
    return ops.process_issues(g.incomplete_records, g.included_records, g.studies, text, "optional", "structured_extraction_allowed")


# A user's events stand for a run: its last event states the claim map, its dearest the section
# check; views are searches, on or off by value, sign-ups seed records, purchases a placeholder.
@query("audit_run_issues", """
with r as (select user_id::varchar as run_id, arg_max(event_type, event_id) = 'error' as invalid, arg_max(event_type, struct_pack(v := value, e := event_id)) as section, count(*) filter (event_type = 'purchase' and value > 100) > 0 as placeholder,
  count(*) filter (event_type = 'view' and coalesce(value > 50, true)) + count(*) filter (event_type = 'signup' and value > 80) as planned from events group by 1)
select 'claim_map_invalid' as "check", null as claim_id, null as side, run_id as entity_id from r where invalid
union all select 'section_coverage_incomplete', null, null, run_id from r where section = 'error' union all select 'section_coverage_missing', null, null, run_id from r where section = 'signup'
union all select 'placeholder_synthesis_used', null, null, run_id from r where placeholder union all select 'empty_search_plan', null, null, run_id from r where planned = 0""")
def run_issues(spark, d):
    events = table(spark, d, "events").select(F.col("user_id").cast("string").alias("run_id"), "event_id", "event_type", "value")
    kind, value = F.col("event_type"), F.col("value")
    section = F.max_by("event_type", F.struct("value", "event_id"))
    runs = events.groupBy("run_id").agg(
        F.when(F.max_by("event_type", "event_id") == "error", "invalid").otherwise("valid").alias("claim_map_status"),
        F.when(section == "error", "failed").when(section != "signup", "passed").alias("section_validation"),
        F.max((kind == "purchase") & (value > 100)).alias("placeholder"))
    searches = events.filter(kind == "view").select("run_id", (value > 50).alias("enabled"))
    seeds = events.filter((kind == "signup") & (value > 80)).select("run_id")
    return ops.run_record_issues(runs, searches, seeds)


def full_audit(spark, d):
    """All issues of the claims; claims and outcomes are written once, as the stages before leave them."""
    c, o = cut_lineage(synthesis_plans.flagged(spark, d)), synthesis_plans.written_outcomes(spark, d)
    e = cut_lineage(evidence(spark, d, o))
    h, s = history(spark, d, o), audit_studies(spark, d)
    o_issues, ro = ops.outcome_issues(c, o, h, RULES, keep=cut_lineage)
    e_issues, re = ops.evidence_issues(c, e, h, keep=cut_lineage)
    left_out = S.contradiction_omissions(c, synthesis_plans.inconsistent_members(spark, d, o), s.filter("eligible"))
    return ops.union_issues([
        ops.claim_issues(c), ops.study_issues(c, s, members(spark, d)), o_issues, e_issues, ops.linkage_issues(c, ro, re),
        ops.omission_issues(left_out), ops.ineligible_evidence(c, s)])


ALL_ISSUES_SQL = f"""
with {synthesis_plans.FLAGS_SQL}, {UNSUPPORTED_SQL}, {AUDIT_SQL.replace(OUTCOMES_SQL, '').replace(SYNTHESIS_SQL, '').strip().lstrip(',').strip().lstrip(',')}, {STUDY_CTE}, {OUTCOME_CTE}, {EVIDENCE_CTE}, {LINK_CTE}, {OMIT_SQL},
iss as ({CLAIM_ISSUES_SQL} union all {STUDY_ISSUES_SQL} union all {OUTCOME_ISSUES_SQL} union all {EVIDENCE_ISSUES_SQL} union all {LINK_ISSUES_SQL}
  union all select 'contradiction_omission', claim_id, null, group_id from omit
  union all select 'included_ineligible_evidence', null, null, study_id from ast where not eligible and study_id in (select study_id from cst))"""


@query("a18_audit_roll_up", f"""{ALL_ISSUES_SQL}
select "check", count(*) as issues, case when "check" in ('unsupported_claim', 'missing_citation') then 'unsupported_claims'
  when "check" in ('scope_violation', 'adjacent_intervention_leakage', 'population_level_overgeneralization', 'animal_to_human_extrapolation', 'correlation_to_causation_inflation', 'unreported_field_hallucination') then 'scope_violations'
  when "check" in ('invalid_quote', 'unverified_critical_quote') then 'invalid_quotes' when "check" = 'contradiction_omission' then 'contradiction_omissions'
  when "check" in ('citation_key_resolution_failure', 'duplicate_study_counting', 'citation_to_excluded_study', 'citation_to_unlinked_study', 'included_ineligible_evidence', 'superseded_outcome_reference', 'superseded_evidence_reference', 'stale_extraction_reference')
  then 'citation_failures' else 'protocol_compliance' end as category from iss group by 1""")
def a18(spark, d):
    return ops.roll_up(full_audit(spark, d))


@query("a18_audit_status", f"{ALL_ISSUES_SQL} select count(*) as issue_count, 'failed' as status, 2 as exit_code from iss")
def a18b(spark, d):
    return ops.audit_status(full_audit(spark, d))
