"""Queries over section selection and claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from evistrata.common import cut_lineage
from evistrata.functions.text import sentences
from evistrata.functions.values import outcome_filter_reasons
from evistrata.operators import evidence as E
from evistrata.operators import synthesis as ops
from evistrata.plans.bindings import OUTCOMES_SQL, SYNTHESIS_SQL, claims, described_studies, evidence, outcomes
from evistrata.plans.registry import query, table

SECTIONS = [
    {"section_id": "S01", "rule": {"include_all_studies": True}},
    {"section_id": "S02", "rule": {"outcome_domains": ["d1", "d2"], "support_relations": ["supports"], "study_field_equals": {"design": "F"}}},
    {"section_id": "S03", "rule": {"contradiction_only": True, "population_scope": "P1", "study_field_in": {"dose": ["5", "6"]}}},
    {"section_id": "S04", "rule": {"no_evidence": True}},
    {"section_id": "S05", "rule": {}},
    {"section_id": "S06", "rule": {"population_field": "design"}},
]


def written_outcomes(spark, d):
    """Outcomes materialised once for queries that use them several times."""
    return cut_lineage(outcomes(spark, d))


def inconsistent_members(spark, d, o=None):
    """Eligible studies of (publication, domain) groups that disagree."""
    o = outcomes(spark, d) if o is None else o
    s = described_studies(spark, d)
    eligible = s.filter("seq % 4 <> 0")
    o = o.select("study_id", "domain", "effect_direction", "support_relation").join(s.select("study_id", "publication_id"), "study_id")
    groups = E.contradiction_groups(o, ["publication_id", "domain"], eligible).filter("has_directional_inconsistency").select("group_id")
    return E.group_members(o, ["publication_id", "domain"], eligible).join(groups, "group_id", "left_semi")


def selection(spark, d, o=None):
    o = written_outcomes(spark, d) if o is None else o
    return ops.select_sections(described_studies(spark, d), o, SECTIONS, inconsistent_members(spark, d, o))


def written_members(spark, d, o):
    return cut_lineage(ops.section_members(selection(spark, d, o)))


GROUP_SQL = """
om as (select o.*, s.publication_id from outc o join st s using (study_id) where s.k % 4 <> 0),
grp as (select publication_id || '|' || domain as group_id, count(distinct study_id) as size from om group by 1
  having bool_or(support_relation = 'mixed') or (bool_or(support_relation = 'supports') and bool_or(support_relation = 'contradicts'))),
mem as (select distinct publication_id || '|' || domain as group_id, study_id from om where publication_id || '|' || domain in (select group_id from grp))"""
SELECT_SQL = f"""
{OUTCOMES_SQL}, {SYNTHESIS_SQL}, {GROUP_SQL},
m as (select study_id, bool_or(domain in ('d1', 'd2') and support_relation = 'supports') as m2 from outc group by 1),
j as (select st.*, coalesce(m2, false) as m2, st.study_id in (select study_id from mem) as con from st left join m using (study_id)),
sel as (
select study_id, 'S01' as section_id, '' as reasons from j
union all select study_id, 'S02', concat_ws(',', case when not m2 then 'outcome_domain_not_matched' end, case when not m2 then 'support_relation_not_matched' end, case when design <> 'F' then 'study_field_not_equal:design' end) from j
union all select study_id, 'S03', concat_ws(',', case when dose <> '5' then 'study_field_not_in:dose' end, case when pop <> 'P1' then 'population_scope_not_matched' end, case when not con then 'not_in_contradiction_group' end) from j
union all select study_id, 'S04', 'no_evidence_requested' from j union all select study_id, 'S05', 'no_selection_rule' from j union all select study_id, 'S06', 'no_supported_filter' from j)"""


@query("j14_section_selection", f"with {SELECT_SQL} select study_id, section_id, case when reasons = '' then 'included_by_rule' else reasons end as reasons from sel")
def j14(spark, d):
    return selection(spark, d).select("study_id", "section_id", ops.explain("reasons").alias("reasons"))


@query("p48_outcome_filter", f"""
with {OUTCOMES_SQL} select outcome_id, concat_ws(',', case when domain <> 'd3' then 'outcome_domain_not_matched' end, case when effect_direction not in ('increase', 'mixed') then 'effect_direction_not_matched' end) as reasons from outc""")
def p48(spark, d):
    rule = {"outcome_domains": "d3", "effect_directions": ["increase", "mixed"], "support_relations": []}
    reasons = outcome_filter_reasons(rule, F.col("domain"), F.col("effect_direction"), F.col("support_relation"))
    return outcomes(spark, d).select("outcome_id", F.array_join(reasons, ",").alias("reasons"))


@query("a15_section_evidence", f"""
with {SELECT_SQL}, e as (select study_id, 'relation' as kind, support_relation as value from outc union select study_id, 'direction', effect_direction from outc)
select section_id, kind, value, count(*) as studies from sel join e using (study_id) where reasons = '' group by 1, 2, 3""")
def a15(spark, d):
    o = written_outcomes(spark, d)
    e = ops.section_evidence(ops.section_members(selection(spark, d, o)), o)
    return e.groupBy("section_id", "kind", "value").agg(F.count(F.lit(1)).alias("studies"))


@query("a14_w10_evidence_memos", f"""
with {SELECT_SQL}, r as (select *, row_number() over (partition by section_id order by study_id) as rn from sel where reasons = ''),
n as (select study_id, count(*) as n from outc group by 1)
select section_id || '_batch_' || lpad(cast((rn - 1) // 25 + 1 as varchar), greatest(3, length(cast((rn - 1) // 25 + 1 as varchar)))::int, '0') as memo_id, string_agg(r.study_id, ',' order by r.study_id) as studies, coalesce(sum(n), 0)::bigint as outcomes
from r left join n using (study_id) group by section_id, (rn - 1) // 25""")
def a14(spark, d):
    o = written_outcomes(spark, d)
    m = ops.evidence_memos(written_members(spark, d, o), o)
    count = F.aggregate("items", F.lit(0), lambda s, i: s + F.size(i["outcome_ids"]))
    return m.select("memo_id", F.array_join("items.study_id", ",").alias("studies"), count.cast("bigint").alias("outcomes"))


@query("j32_dropped_evidence", f"with {SELECT_SQL} select study_id from st where study_id not in (select study_id from sel where section_id = 'S02' and reasons = '')")
def j32(spark, d):
    o = written_outcomes(spark, d)
    memos = ops.evidence_memos(written_members(spark, d, o).filter("section_id = 'S02'"), o)
    return described_studies(spark, d).select("study_id").join(ops.memo_studies(memos).select("study_id"), "study_id", "left_anti")


@query("j15_resolved_evidence", f"""
with {OUTCOMES_SQL}, {SYNTHESIS_SQL} select claim_id, side, c.evidence_id, e.study_id, (e.study_id is not null)::int as resolved from cet c left join evi e using (evidence_id)""")
def j15(spark, d):
    r = ops.resolve_evidence(claims(spark, d), evidence(spark, d))
    return r.select("claim_id", "side", "evidence_id", "study_id", F.col("resolved").cast("int").alias("resolved"))


WRONG = """wrong as (select claim_id, side, c.outcome_id from cot c left join outc o using (outcome_id)
  where o.study_id is null or not exists (select 1 from cst x where x.claim_id = c.claim_id and x.side = c.side and x.study_id = o.study_id))"""


@query("j16_misplaced_outcomes", f"with {OUTCOMES_SQL}, {SYNTHESIS_SQL}, {WRONG} select claim_id, side, outcome_id from wrong")
def j16(spark, d):
    return ops.misplaced_outcomes(claims(spark, d), outcomes(spark, d))


@query("j17_contradiction_omissions", f"""
with {OUTCOMES_SQL}, {SYNTHESIS_SQL}, {GROUP_SQL},
a as (select claim_id, study_id, bool_or(side = 'supporting' and study_id in (select study_id from st where k % 4 <> 0)) as sup from cst group by 1, 2),
t as (select claim_id, group_id, count(*) as accounted, bool_or(sup) as supported from a join mem using (study_id) group by 1, 2)
select claim_id, group_id, supported::int as supported, accounted, size - accounted as omitted from t join grp using (group_id) where size > accounted""")
def j17(spark, d):
    eligible = described_studies(spark, d).filter("seq % 4 <> 0")
    out = ops.contradiction_omissions(claims(spark, d), inconsistent_members(spark, d), eligible)
    return out.select("claim_id", "group_id", F.col("supported").cast("int").alias("supported"), "accounted", "omitted")


HIERARCHY = ["low", "mid", "high"]


def flagged(spark, d):
    return ops.claim_flags(claims(spark, d), described_studies(spark, d), HIERARCHY, [("low", "high")], core=["x", "z"], adjacent=["y"])


FLAGS_SQL = f"""
{OUTCOMES_SQL}, {SYNTHESIS_SQL},
sup as (select distinct claim_id, study_id from cst where side = 'supporting'),
agg as (select claim_id, bool_or(scope = 'outside') as s1, bool_or(scope = 'adjacent') as s2, bool_or(scope in ('inside', 'core')) as s3, bool_or(summary = 'y') as s4,
  bool_or(summary <> '') as s5, bool_or(strength <> 'causal') as weak, max(case lvl when 'low' then 1 when 'mid' then 2 when 'high' then 3 end) as rank, bool_or(lvl = 'low') as low,
  bool_or(dose = '5') as dosed, string_agg(distinct nullif(lvl, ''), ',' order by nullif(lvl, '')) as levels from sup join st using (study_id) group by 1),
flag as (select c.claim_id, c.section_id, c.k, case when c.k % 17 = 0 then 'outside' when s1 then 'outside' when s2 then 'adjacent' when s3 then 'inside' when s4 then 'adjacent' when s5 then 'inside' else 'unclear' end as scope,
  coalesce(levels, '') as levels, coalesce(case when c.k % 2 = 0 then 3 when c.k % 5 = 0 then 2 end > rank, false)::int as over, coalesce(low and c.k % 2 = 0, false)::int as crossed,
  coalesce(weak and c.k % 2 = 1, false)::int as inflated, case when a.claim_id is null then '' else concat_ws(',', case when c.k % 3 = 1 then 'absent' end, case when not dosed then 'dose' end) end as unreported,
  case when c.k % 13 = 0 then 'never' else '' end as missing from cl c left join agg a using (claim_id))"""


@query("a22_a24_claim_flags", f"with {FLAGS_SQL} select claim_id, scope, levels, over, crossed, inflated, unreported, missing from flag")
def a22(spark, d):
    f = flagged(spark, d)
    names = {"population_overgeneralization": "over", "animal_to_human": "crossed", "causal_inflation": "inflated"}
    return f.select("claim_id", F.col("protocol_scope_status").alias("scope"), F.array_join("population_levels", ",").alias("levels"), *[F.col(c).cast("int").alias(n) for c, n in names.items()],
                    F.array_join("unreported_field_claims", ",").alias("unreported"), F.array_join("missing_required_qualifiers", ",").alias("missing"))


@query("a25_linkage_status", f"""
with {OUTCOMES_SQL}, {SYNTHESIS_SQL}, {WRONG},
r as (select claim_id, count(e.evidence_id) as ok, count(*) - count(e.evidence_id) as bad from cet c left join evi e using (evidence_id) group by 1),
n as (select claim_id, (select count(*) from cst x where x.claim_id = cl.claim_id) as studies, (select count(*) from cot x where x.claim_id = cl.claim_id) + (select count(*) from cet x where x.claim_id = cl.claim_id) as explicit from cl)
select claim_id, case when studies > 0 and explicit = 0 then 'study_only_linkage' when claim_id in (select claim_id from wrong) or coalesce(bad, 0) > 0 then 'evidence_linkage_incomplete'
  when studies > 0 and coalesce(ok, 0) > 0 then 'complete' else 'evidence_linkage_incomplete' end as linkage_status from n left join r using (claim_id)""")
def a25(spark, d):
    o = written_outcomes(spark, d)
    return ops.linkage_status(claims(spark, d), evidence(spark, d, o), o)


@query("j34_section_plan", """
with r as (select n_nationkey as p, n_name as title, case when n_nationkey % 5 = 0 then 'R' || n_nationkey end as id, 'r' || n_regionkey as kind from nation where n_nationkey % 3 <> 1),
c as (select n_nationkey as p, n_name as title, case when n_nationkey % 2 = 0 then 'C' || n_nationkey end as id, 'c' as kind, 'e' || n_nationkey as extra from nation),
b as (select coalesce(r.title, c.title) as title, coalesce(r.id, c.id) as id, coalesce(r.kind, c.kind) as kind, c.extra, case when r.p is not null then r.p else 1000 + c.p end as o from r full join c on r.title = c.title)
select row_number() over (order by o) as position, coalesce(id, 'S' || lpad(cast(row_number() over (order by o) as varchar), 2, '0')) as section_id, title, kind, extra from b""")
def j34(spark, d):
    n = table(spark, d, "nation")
    k = F.col("n_nationkey")
    required = n.filter(k % 3 != 1).select(k.alias("position"), F.col("n_name").alias("title"), F.when(k % 5 == 0, F.concat(F.lit("R"), k.cast("string"))).alias("section_id"),
                                           F.create_map(F.lit("kind"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))).alias("attributes"))
    configured = n.select(k.alias("position"), F.col("n_name").alias("title"), F.when(k % 2 == 0, F.concat(F.lit("C"), k.cast("string"))).alias("section_id"),
                          F.create_map(F.lit("kind"), F.lit("c"), F.lit("extra"), F.concat(F.lit("e"), k.cast("string"))).alias("attributes"))
    return ops.overlay_plan(required, configured).select("position", "section_id", "title", F.col("attributes.kind").alias("kind"), F.col("attributes.extra").alias("extra"))


def written_sections(spark, d):
    """Conversation turns as section texts that cite a study; their claims cover all or the first sentence."""
    c = table(spark, d, "conversations")
    study = F.concat(F.lit("study_"), (F.col("conv_id") % 20).cast("string"))
    text = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("\nSeen in ["), study, F.lit("] and pub_z."))).otherwise(""))
    first = F.get(sentences(text), 0)
    claim = F.struct(F.when(F.col("turn") % 3 == 0, F.col("_t")).otherwise(F.col("_f")).alias("sentence"), F.array("_s").alias("study_ids"), F.when(F.col("turn") % 4 == 1, F.array("_s")).alias("citations"))
    rows = c.select(F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("section_id"), text.alias("_t"), first.alias("_f"), study.alias("_s"), "turn", "conv_id")
    none = F.array().cast("array<struct<sentence:string,study_ids:array<string>,citations:array<string>>>")
    return rows.select("section_id", F.col("_t").alias("section_text"), F.when(F.col("turn") == 5, none).otherwise(F.array(claim)).alias("claims"), "conv_id", "_s")


def _coverage(spark, d):
    sections = written_sections(spark, d)
    members = sections.filter("conv_id % 3 <> 0").select("section_id", F.col("_s").alias("study_id"))
    eligible = sections.filter("conv_id % 20 < 15").select(F.col("_s").alias("study_id")).distinct()
    return sections, ops.section_coverage_errors(sections.drop("conv_id", "_s"), members, eligible)


COVER_SQL = r"""
b as (select conv_id || '-' || turn as section_id, conv_id, turn, text, 'study_' || (conv_id % 20) as s,
  text || case when turn % 2 = 0 then chr(10) || 'Seen in [study_' || (conv_id % 20) || '] and pub_z.' else '' end as t from conversations),
l as (select section_id, n, regexp_replace(regexp_replace(line, '^\s*([-*+]\s+|>\s+|#{1,6}\s+)', ''), '^[\s\pZ]+|[\s\pZ]+$', '', 'g') as line from
  (select section_id, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as n from b)),
p0 as (select section_id, n, unnest(string_split(regexp_replace(line, '([.!?。！？])\s+', '\1' || chr(1), 'g'), chr(1))) as s, generate_subscripts(string_split(regexp_replace(line, '([.!?。！？])\s+', '\1' || chr(1), 'g'), chr(1)), 1) as m from l where line <> ''),
p as (select section_id, s as sent, row_number() over (partition by section_id order by n, m) as rn, lower(trim(regexp_replace(regexp_replace(s, '[`*_]', '', 'g'), '[\s\pZ]+', ' ', 'g'))) as norm from p0 where s <> ''),
c as (select b.section_id, case when turn % 3 = 0 then t else sent end as claim, turn, s from b left join p on p.section_id = b.section_id and rn = 1 where turn <> 5),
cn as (select *, lower(trim(regexp_replace(regexp_replace(claim, '[`*_]', '', 'g'), '[\s\pZ]+', ' ', 'g'))) as cnorm from c),
ev as (select section_id from b where conv_id % 3 <> 0), ok as (select distinct 'study_' || (conv_id % 20) as s from b where conv_id % 20 < 15),
known as (select s from ok union select s from b where conv_id % 3 <> 0),
tok as (select section_id, s as token from b where turn % 2 = 0 union all select section_id, 'pub_z' from b where turn % 2 = 0),
err as (
select section_id, 'nonempty_section_zero_claims' as error, '' as detail from b where turn = 5 and section_id in (select section_id from ev)
union all select section_id, 'empty_evidence_section_has_claims', '' from b where turn <> 5 and section_id not in (select section_id from ev)
union all select section_id, 'substantive_sentence_not_mapped', sent from p where norm <> '' and not exists (select 1 from cn where cn.section_id = p.section_id and (contains(cnorm, norm) or contains(norm, cnorm)))
union all select section_id, 'citation_not_in_sentence_or_citation_field', s from cn where turn % 4 <> 1 and not contains(claim, s)
union all select section_id, case when section_id not in (select section_id from ev) then 'study_outside_section' else 'study_not_eligible' end, s from cn where section_id not in (select section_id from ev) or s not in (select s from ok)
union all select section_id, 'section_citation_not_in_claim_map', token from tok where token = 'pub_z' or section_id not in (select section_id from cn)
union all select section_id, 'unknown_study_citation_in_text', token from tok where token not in (select s from known)
union all select section_id, 'evidence_section_has_no_study_citation', '' from b where turn % 2 = 1 and section_id in (select section_id from ev))"""


@query("j30_section_coverage_errors", f"with {COVER_SQL} select section_id, error, detail from err")
def j30(spark, d):
    return _coverage(spark, d)[1].select("section_id", "error", "detail")


@query("j30_section_coverage", f"with {COVER_SQL} select b.section_id, case when turn = 5 then 0 else 1 end as claim_count, count(error) as errors, case when count(error) = 0 then 'passed' else 'failed' end as coverage_status from b left join err using (section_id) group by 1, 2")
def j30b(spark, d):
    sections, errors = _coverage(spark, d)
    return ops.section_coverage(sections, errors)


@query("x4_fixture_claims", f"""
with {SELECT_SQL}, f as (select section_id, s.study_id, arg_min(outcome_id, outcome_id) as outcome_id, arg_min(support_relation, outcome_id) as rel from sel s join outc o using (study_id)
  where reasons = '' and n_evidence > 0 and (section_id <> 'S02' or (domain in ('d1', 'd2') and support_relation = 'supports')) group by 1, 2),
r as (select *, (row_number() over (partition by section_id order by study_id) - 1) // 25 as batch from f)
select section_id, string_agg(case when rel <> 'contradicts' then outcome_id end, ',' order by study_id) as supporting, string_agg(case when rel = 'contradicts' then outcome_id end, ',' order by study_id) as contradicting,
  'Eligible evidence for this section was reported by ' || count(*) || ' study record(s) ' || string_agg('[' || study_id || ']', ' ' order by study_id) || '.' as sentence from r group by section_id, batch""")
def x4(spark, d):
    o = written_outcomes(spark, d)
    first = F.when(F.size("evidence") > 0, F.concat(F.lit("e"), "outcome_id", F.lit("-0")))
    rules = {s["section_id"]: s["rule"] for s in SECTIONS}
    c = ops.fixture_claims(written_members(spark, d, o), o.withColumn("evidence_id", first), rules)
    sides = {s: F.nullif(F.array_join(f"{s}_outcomes", ","), F.lit("")).alias(s) for s in ("supporting", "contradicting")}
    return c.select("section_id", sides["supporting"], sides["contradicting"], "sentence")
