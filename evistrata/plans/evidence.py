"""Queries over evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from evistrata.operators import evidence as ops
from evistrata.plans.bindings import OUTCOMES_SQL, outcomes, studies
from evistrata.plans.registry import query, table

DIMENSIONS = ["domain", "timepoint"]


def arms(spark, d):
    """Studies with up to three arms; every fourth has no comparator."""
    s = studies(spark, d)
    def arm(name, role):
        return F.struct(F.concat(F.col("study_id"), F.lit(name)).alias("arm_id"), role.alias("role"))
    k = F.col("seq")
    second = F.when(k % 4 == 0, "intervention").when(k % 4 == 1, "control").otherwise("comparator")
    return s.withColumn("arms", F.array(arm("a", F.lit("intervention")), arm("b", second), arm("c", F.when(k % 2 == 0, "intervention").otherwise("control"))))


def eligible(spark, d):
    return studies(spark, d).filter("seq % 10 <> 3")


ELIGIBLE = "l_orderkey % 10 <> 3"


def matrix(spark, d, per_comparison=False):
    publications = table(spark, d, "customer").select(F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("publication_id"), F.col("c_name").alias("title"))
    return ops.evidence_matrix(arms(spark, d), publications, outcomes(spark, d), eligible(spark, d), per_comparison)


@query("a8_j9_evidence_matrix", f"""
with {OUTCOMES_SQL}, x as (select study_id, string_agg(distinct domain, ',' order by domain) as dm, string_agg(distinct effect_direction, ',' order by effect_direction) as dr,
  string_agg(distinct support_relation, ',' order by support_relation) as rl, string_agg(distinct case when n_evidence > 0 then validation_status end, ',' order by case when n_evidence > 0 then validation_status end) as st from outc group by 1)
select 's' || o_orderkey as study_id, c_name as title, coalesce(dm, '') as domains, coalesce(dr, '') as directions, coalesce(rl, '') as relations, coalesce(st, 'not_reported') as quotes
from orders left join customer on c_custkey = o_custkey left join x on study_id = 's' || o_orderkey where o_orderkey % 10 <> 3""")
def a8(spark, d):
    m = matrix(spark, d)
    names = {"outcome_domains": "domains", "effect_directions": "directions", "support_relations": "relations", "quote_statuses": "quotes"}
    return m.select("study_id", "title", *[F.array_join(c, ",").alias(n) for c, n in names.items()])


@query("j10_comparisons", """
with s as (select 's' || o_orderkey as s, o_orderkey as k from orders where o_orderkey % 10 <> 3),
a as (select s, s || 'a' as arm, 'x' as role from s union all select s, s || 'b', case when k % 4 = 0 then 'x' else 'c' end from s union all select s, s || 'c', case when k % 2 = 0 then 'x' else 'c' end from s)
select s as study_id, e.arm || '__vs__' || c.arm as comparison_id from a e join a c using (s) where e.role = 'x' and c.role = 'c'
union all select s, 'not_applicable' from s where s not in (select s from a where role = 'c')""")
def j10(spark, d):
    return matrix(spark, d, True).select("study_id", "comparison_id")


@query("a9_a10_contradiction_groups", f"""
with {OUTCOMES_SQL} select domain || '|' || timepoint as group_id, count(*) as outcomes, count(distinct study_id) as studies, string_agg(distinct effect_direction, ',' order by effect_direction) as directions,
  string_agg(distinct support_relation, ',' order by support_relation) as relations,
  (bool_or(support_relation = 'mixed') or (bool_or(support_relation = 'supports') and bool_or(support_relation = 'contradicts')))::int as inconsistent from outc where {ELIGIBLE} group by domain, timepoint""")
def a9(spark, d):
    g = ops.contradiction_groups(outcomes(spark, d), DIMENSIONS, eligible(spark, d))
    return g.select("group_id", "outcomes", "studies", F.array_join("effect_directions", ",").alias("directions"), F.array_join("support_relations", ",").alias("relations"),
                    F.col("has_directional_inconsistency").cast("int").alias("inconsistent"))


@query("a9_group_members", f"with {OUTCOMES_SQL} select distinct domain || '|' || timepoint as group_id, study_id from outc where {ELIGIBLE}")
def a9b(spark, d):
    return ops.group_members(outcomes(spark, d), DIMENSIONS, eligible(spark, d))


@query("a11_moderator_candidates", f"""
with {OUTCOMES_SQL}, m as (select study_id as g, unnest(['design', 'dose']) as moderator, unnest([design, dose]) as value from outc where {ELIGIBLE}),
v as (select g, moderator from m group by 1, 2 having count(distinct value) > 1) select distinct g as group_id, moderator, value from m join v using (g, moderator)""")
def a11(spark, d):
    return ops.moderator_candidates(outcomes(spark, d), ["study_id"], ["design", "dose"], eligible(spark, d))


@query("a9_interpretation", f"""
with {OUTCOMES_SQL}, v as (select study_id, count(distinct design) > 1 or count(distinct dose) > 1 as has_some from outc group by 1)
select study_id as group_id, case when has_some then 'candidate_explanation_only' else 'observation_only' end as interpretation from v""")
def a9c(spark, d):
    o = outcomes(spark, d)
    groups = o.select(F.col("study_id").alias("group_id")).distinct()
    return ops.interpreted(groups, ops.moderator_candidates(o, ["study_id"], ["design", "dose"])).select("group_id", "interpretation")
