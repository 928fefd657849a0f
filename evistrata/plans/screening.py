"""Queries over the screening ledger and the gates behind it."""

from __future__ import annotations

from pyspark.sql import functions as F

from evistrata.operators import eligibility as gate
from evistrata.operators import screening as ops
from evistrata.plans.bindings import LEDGER_SQL, STUDIES_SQL, ledger, links, studies, universe
from evistrata.plans.registry import query, table


def latest(spark, d):
    """Latest decisions, reduced to the decision before they are shuffled."""
    return ops.latest_decisions(ledger(spark, d).select("record_id", "stage", "decision", "seq"))


@query("w1_latest_decisions", f"with {LEDGER_SQL} select record_id, stage, decision, seq from latest")
def w1(spark, d):
    return latest(spark, d).select("record_id", "stage", "decision", "seq")


@query("w2_previous_decision", f"""
with {LEDGER_SQL} select seq, decision, lag(decision) over (partition by record_id, stage order by seq) as previous_decision from ledger""")
def w2(spark, d):
    return ops.with_previous_decision(ledger(spark, d)).select("seq", "decision", "previous_decision")


@query("p47_decision_validity", f"""
with {LEDGER_SQL} select seq, case when decision = 'maybe' then 'unknown_decision'
  when decision in ('exclude', 'duplicate') and reason_code is null then 'reason_required'
  when reason_code = 'odd_reason' then 'reason_not_declared' when ai = 'perhaps' then 'invalid_ai_recommendation' else 'valid' end as fault from ledger""")
def p47(spark, d):
    good, bad = ops.split_decisions(ledger(spark, d), ["wrong_outcome"])
    return good.select("seq", F.lit("valid").alias("fault")).unionByName(bad.select("seq", "fault"))


@query("a5_prisma_counts", f"""
with {LEDGER_SQL} select stage, count(*) as total, count(*) filter (where decision = 'duplicate') as duplicate,
  count(*) filter (where decision = 'exclude') as exclude, count(*) filter (where decision = 'include') as include,
  count(*) filter (where decision = 'uncertain') as uncertain from latest group by stage""")
def a5(spark, d):
    return ops.prisma_counts(latest(spark, d))


@query("a5_identified_unique", f"with {LEDGER_SQL} select count(distinct record_id) as identified_unique from latest")
def a5b(spark, d):
    return ops.identified_unique(latest(spark, d))


@query("j11_u4_completeness", f"""
with {LEDGER_SQL} select record_id, title_state, fulltext_state, illegal::int as illegal, inc::int as title_included from states""")
def j11(spark, d):
    s = ops.completeness(universe(spark, d), latest(spark, d))
    return s.select("record_id", "title_state", "fulltext_state", F.col("illegal").cast("int").alias("illegal"), F.col("title_included").cast("int").alias("title_included"))


@query("j11_incomplete_records", f"""
with {LEDGER_SQL} select record_id from states where illegal or title_state in ('missing', 'uncertain') or fulltext_state in ('missing', 'uncertain')""")
def j11b(spark, d):
    return ops.incomplete_records(ops.completeness(universe(spark, d), latest(spark, d))).select("record_id")


@query("w4_latest_links", f"with {STUDIES_SQL} select study_id, coalesce(record_id, '') as record_id from link")
def w4(spark, d):
    return gate.latest_links(links(spark, d)).select("study_id", "record_id")


def _gate(spark, d, enforcement):
    return gate.resolve_eligibility(
        studies(spark, d), links(spark, d), latest(spark, d), universe(spark, d), enforcement)


def _gate_sql(included: str) -> str:
    return f"""
with {LEDGER_SQL}, {STUDIES_SQL}, inc as ({included})
select s.study_id, case when l.record_id is null then 'unlinked' when l.record_id in (select record_id from inc) then 'included' else 'not_included' end as study_state,
  case when l.record_id in (select record_id from inc) then 1 else 0 end as eligible from study s left join link l using (study_id)"""


REQUIRED = "select record_id from states where inc and f = 'include'"
OPTIONAL = "select record_id from states where known and f = 'include'"


@query("j13_eligibility_required", _gate_sql(REQUIRED))
def j13(spark, d):
    return _gate(spark, d, "required").studies.select("study_id", "study_state", F.col("eligible").cast("int").alias("eligible"))


@query("j13_eligibility_optional", _gate_sql(OPTIONAL))
def j13b(spark, d):
    return _gate(spark, d, "optional").studies.select("study_id", "study_state", F.col("eligible").cast("int").alias("eligible"))


@query("j13_included_records", f"""
with {LEDGER_SQL}, {STUDIES_SQL} select record_id, case when record_id in (select record_id from link where record_id is not null) then 1 else 0 end as linked from ({REQUIRED})""")
def j13c(spark, d):
    return _gate(spark, d, "required").included_records.select("record_id", F.col("linked").cast("int").alias("linked"))


def resources(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        F.concat(F.lit("c"), k.cast("string")).alias("record_id"), F.when(k % 3 == 0, "file.txt").otherwise("").alias("path"),
        F.when(k % 5 == 0, False).when(k % 7 == 0, True).alias("available"))


RES_SQL = "res as (select 'c' || c_custkey as record_id from customer where c_custkey % 5 <> 0 and (c_custkey % 3 = 0 or c_custkey % 7 = 0))"


@query("s18_declared_resources", f"with {RES_SQL} select record_id from res")
def s18(spark, d):
    return gate.declared_resources(resources(spark, d))


@query("j12_fulltext_status", f"""
with {LEDGER_SQL}, {STUDIES_SQL}, {RES_SQL}, inc as ({OPTIONAL}),
disk as (select 'c' || c_custkey as record_id from customer where c_acctbal > 5000 and c_custkey % 2 = 0),
st as (select record_id, record_id in (select record_id from res union all select record_id from disk) as txt,
  record_id in (select record_id from link where record_id is not null) as ext from inc)
select record_id, txt::int as fulltext_available, ext::int as structured_available, (txt and ext)::int as both_available, (not txt)::int as blocking from st""")
def j12(spark, d):
    included = _gate(spark, d, "optional").included_records
    c = table(spark, d, "customer")
    path = F.concat(F.lit("/full/"), F.col("c_custkey").cast("string"), F.lit(".txt"))
    named = c.filter("c_custkey % 2 = 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("record_id"), path.alias("path"))
    out = gate.fulltext_status(included, resources(spark, d), named, c.filter("c_acctbal > 5000").select(path.alias("path")), links(spark, d), studies(spark, d))
    flags = ("fulltext_available", "structured_available", "both_available", "blocking")
    return out.select("record_id", *[F.col(f).cast("int").alias(f) for f in flags])


@query("j33_route_documents", f"""
with {LEDGER_SQL}, doc as (select doc_id, case when doc_id % 5 = 0 then null else 'c' || (doc_id % 200) end as record_id from documents)
select doc_id, case when l.decision is not null and l.decision <> 'include' then 'skip' when l.decision is null then 'error' else 'process' end as route
from doc left join latest l on l.record_id = doc.record_id and l.stage = 'fulltext'""")
def j33(spark, d):
    doc = F.col("doc_id")
    docs = table(spark, d, "documents").select("doc_id", F.when(doc % 5 != 0, F.concat(F.lit("c"), (doc % 200).cast("string"))).alias("record_id"))
    return gate.route_documents(docs, latest(spark, d), "required").select("doc_id", "route")


@query("u3_id_set_algebra", f"""
with {LEDGER_SQL}, {STUDIES_SQL}, a as ({OPTIONAL}), b as (select record_id from link where record_id is not null)
select 'both' as side, record_id from (select record_id from a intersect select record_id from b)
union all select 'included_only', record_id from (select record_id from a except select record_id from b)
union all select 'linked_only', record_id from (select record_id from b except select record_id from a)""")
def u3(spark, d):
    a = _gate(spark, d, "optional").included_records.select("record_id")
    b = gate.latest_links(links(spark, d)).select("record_id").filter("record_id <> ''")
    sides = {"both": a.intersect(b), "included_only": a.subtract(b), "linked_only": b.subtract(a)}
    parts = [df.select(F.lit(name).alias("side"), "record_id") for name, df in sides.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
