"""Queries over search records."""

from __future__ import annotations

from pyspark.sql import functions as F

from evistrata.common import first_n, first_seen
from evistrata.functions import keys as K
from evistrata.functions import rules as R
from evistrata.functions import text as X
from evistrata.operators import records as ops
from evistrata.plans.bindings import RECORDS_SQL, records
from evistrata.plans.registry import query, table

FIELDS = ["title", "doi", "pmid", "lang", "n_chars", "source"]


@query("p1_norm_doi", """
select doc_id, case when doc_id % 6 = 3 then null when doc_id % 6 in (4, 5) then null
  else '10.' || (doc_id % 97) || '/ab' end as doi,
  case when doc_id % 6 = 4 then cast(doc_id as varchar) end as pmid
from documents""")
def p1(spark, d):
    doc = F.col("doc_id")
    n = (doc % 97).cast("string")
    own = (F.when(doc % 6 == 0, F.concat(F.lit(" HTTPS://doi.org/10."), n, F.lit("/AB")))
           .when(doc % 6 == 1, F.concat(F.lit("http://dx.doi.org/10."), n, F.lit("/ab ")))
           .when(doc % 6 == 4, F.concat(F.lit("PMID:"), doc.cast("string"))).otherwise(""))
    other = F.when(doc % 6 == 2, F.concat(F.lit("10."), n, F.lit("/Ab")))
    return table(spark, d, "documents").select("doc_id", K.norm_doi(own, other).alias("doi"), K.pmid_from_doi_slot(own).alias("pmid"))


@query("p2_p3_title_and_record_key", f"with {RECORDS_SQL} select seq, title_key, record_key from rec")
def p2(spark, d):
    r = records(spark, d)
    return r.select("seq", K.title_key("title").alias("title_key"), K.record_key("doi", "title", "raw_record_id").alias("record_key"))


@query("p4_stable_id", """
select doc_id, 'doc_' || substr(sha256(to_json([lower(trim(source)), cast(n_chars as varchar), lower(trim(split_part(text, chr(10), 1)))])::varchar), 1, 16) as id
from documents""")
def p4(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", K.stable_id("doc", "source", "n_chars", F.substring_index("text", "\n", 1)).alias("id"))


@query("p5_json_digest", """
select doc_id, sha256('{"chars":' || n_chars || ',"lang":"' || lang || '","source":"' || source || '"}') as digest from documents""")
def p5(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", K.json_digest({"source": "source", "lang": "lang", "chars": "n_chars"}).alias("digest"))


@query("p6_processing_key", """
select doc_id, substr(sha256('{"cache_version":"v1","content_sha256":"' || sha256(text) ||
  '","input_mode":"evidence_pack","model":"m","question":"q","rerank":false,"vectors":true}'), 1, 24) as key from documents""")
def p6(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", K.processing_key(F.sha2("text", 256), "q", "m", "v1", vectors=True).alias("key"))


@query("p40_entity_ids", """
select l_orderkey, l_linenumber,
  'pub_' || substr(sha256(to_json(['10.' || l_partkey])::varchar), 1, 16) as publication_id,
  'study_' || substr(sha256(to_json(['o' || l_orderkey, 'label ' || l_suppkey, cast(l_linenumber as varchar)])::varchar), 1, 16) as study_id,
  'study-key_' || substr(sha256(to_json(['o' || l_orderkey, 'label ' || l_suppkey])::varchar), 1, 16) as identity_key,
  'evidence_' || substr(sha256(to_json(['s', 'o', lower(l_returnflag), cast(l_linenumber as varchar), '', '', '', '0'])::varchar), 1, 16) as evidence_id
from lineitem""")
def p40(spark, d):
    li = table(spark, d, "lineitem")
    pub = F.concat(F.lit("O"), F.col("l_orderkey").cast("string"))
    label = F.concat(F.lit("Label "), F.col("l_suppkey").cast("string"))
    blank = F.lit("")
    return li.select(
        "l_orderkey", "l_linenumber",
        K.publication_id(blank, blank, F.concat(F.lit("10."), F.col("l_partkey").cast("string"))).alias("publication_id"),
        K.study_id(pub, label, "l_linenumber").alias("study_id"), K.study_identity_key(pub, label).alias("identity_key"),
        K.evidence_id(F.lit("s"), F.lit("o"), "l_returnflag", "l_linenumber", blank, blank, blank, F.lit(0)).alias("evidence_id"))


@query("p41_outcome_identity", """
with o as (select l_orderkey, l_linenumber, l_partkey,
  case when l_linenumber = 1 then 'X' || l_partkey else '' end as oid,
  case when l_linenumber = 2 then 'K' || l_partkey else '' end as ikey,
  case when l_linenumber in (3, 4) then l_returnflag end as dom,
  case when l_linenumber = 3 then 'n/a' else l_linestatus end as tp, 's' || l_orderkey as study from lineitem)
select l_orderkey, l_linenumber, l_partkey,
  case when oid <> '' then 'outcome-id:' || oid when ikey <> '' then ikey
    when l_linenumber = 3 then 'outcome-configured-key_' || substr(sha256(to_json([study, 'domain=' || lower(dom)])::varchar), 1, 16)
    when dom is not null then 'outcome-configured-key_' || substr(sha256(to_json([study, 'domain=' || lower(dom), 'timepoint=' || lower(tp)])::varchar), 1, 16)
    else 'outcome-configured-key_' || substr(sha256(to_json([study, 'timepoint=' || lower(tp)])::varchar), 1, 16) end as identity_key,
  case when oid <> '' then 'explicit_outcome_id' when ikey <> '' then 'explicit_identity_key' else 'configured_fields' end as identity_source,
  'outcome-key_' || substr(sha256(to_json([study, lower(coalesce(dom, '')), cast(l_linenumber as varchar)])::varchar), 1, 16) as fallback_key
from o""")
def p41(spark, d):
    line = F.col("l_linenumber")
    blank = F.lit("")
    o = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.concat(F.lit("s"), F.col("l_orderkey").cast("string")).alias("study"),
        F.when(line == 1, F.concat(F.lit("X"), F.col("l_partkey").cast("string"))).otherwise("").alias("oid"),
        F.when(line == 2, F.concat(F.lit("K"), F.col("l_partkey").cast("string"))).otherwise("").alias("ikey"),
        F.when(line.isin(3, 4), F.col("l_returnflag")).alias("dom"),
        F.when(line == 3, "n/a").otherwise(F.col("l_linestatus")).alias("tp"))
    full = K.outcome_identity("study", "oid", "ikey", "dom", "l_linenumber", [("domain", "dom"), ("timepoint", "tp")])
    plain = K.outcome_identity("study", blank, blank, "dom", "l_linenumber")
    return o.select("l_orderkey", "l_linenumber", "l_partkey", full["identity_key"].alias("identity_key"),
                    full["identity_source"].alias("identity_source"), plain["identity_key"].alias("fallback_key"))


@query("a2_merge_duplicates", f"""
with {RECORDS_SQL}
select record_id, arg_min(title, seq) filter (where title <> '') as title, arg_min(doi, seq) filter (where doi <> '') as doi,
  arg_min(pmid, seq) filter (where pmid <> '') as pmid, arg_min(lang, seq) filter (where lang <> '') as lang,
  arg_min(n_chars, seq) filter (where n_chars <> 0) as n_chars, arg_min(source, seq) as source, count(*) as members, min(seq) as first_seq
from keyed group by record_id""")
def a2(spark, d):
    return ops.merge_duplicates(ops.with_record_key(records(spark, d)), FIELDS).drop("record_key")


@query("a3_duplicate_groups", f"""
with {RECORDS_SQL}, g as (select record_key from keyed group by 1 having count(*) > 1)
select record_id, raw_record_id, seq from keyed where record_key in (select record_key from g)""")
def a3(spark, d):
    return ops.duplicate_members(ops.with_record_key(records(spark, d)))


@query("a4_provenance", f"""
with {RECORDS_SQL}
select record_id, run_id, search_id, min(seq) as first_seq, arg_min(source, seq) as source from keyed group by 1, 2, 3""")
def a4(spark, d):
    return ops.provenance(ops.with_record_key(records(spark, d)))


@query("u1_union_searches", """
select case when doc_id % 3 = 0 then 'seed' else 's' || (doc_id % 3) end as search_id,
  case when doc_id % 3 = 0 then 'seed' when doc_id % 3 = 1 then 'alpha' else 'beta' end as source,
  case when doc_id % 3 = 0 then 'seed' else 'r1' end as run_id, count(*) as n, count(distinct doc_id) as ids
from documents group by 1, 2, 3""")
def u1(spark, d):
    r = records(spark, d).drop("raw_record_id", "search_id", "run_id", "source", "pmid")
    runners = {"alpha": lambda q, n: r.filter("seq % 3 = 1"), "beta": lambda q, n: r.filter("seq % 3 = 2")}
    plan = [{"id": "s1", "source": "alpha", "query": "a"}, {"id": "s2", "source": "beta", "query": "b"},
            {"id": "s3", "source": "gone", "query": "c"}, {"id": "s4", "source": "alpha", "query": "d", "enabled": False}]
    raw, _ = ops.run_searches(spark, plan, runners, "r1", seeds=r.filter("seq % 3 = 0"))
    return raw.groupBy("search_id", "source", "run_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("raw_record_id").alias("ids"))


def _searched(spark, d):
    """Seeds and four searches: one reads to the end, one fails while it is read, one lacks a runner, one lacks a query."""
    r = records(spark, d).drop("raw_record_id", "search_id", "run_id", "source")
    broken = F.when(F.col("seq") % 6 == 4, F.raise_error(F.lit("the source broke off")).cast("string")).otherwise(F.col("title"))
    runners = {"alpha": lambda q, n: r.filter("seq % 3 = 1"), "beta": lambda q, n: r.filter("seq % 3 <> 0").withColumn("title", broken)}
    plan = [{"id": "s1", "source": "alpha", "query": "a"}, {"id": "s2", "source": "beta", "query": "b"},
            {"id": "s3", "source": "gone", "query": "c"}, {"id": "s4", "source": "alpha", "query": ""}]
    return ops.run_searches(spark, plan, runners, "r1", seeds=r.filter("seq % 3 = 0"), protocol_hash="p")


# Records of a failed search are lost as a whole; seeds and s1 stay.
SEARCHED_SQL = f"""{RECORDS_SQL}, found as (
  select case when seq % 3 = 0 then 'seed' else 's1' end as search_id,
    case when doi is not null then 'doi:' || doi when title_key <> '' then 'title:' || title_key else 'raw:' || seq end as record_key
  from tit where seq % 3 < 2)"""


@query("u1_search_log", """
with n as (select count(*) as n from documents where doc_id % 3 = 1)
select * from (values ('s1', 'alpha', 'a'), ('s2', 'beta', 'b'), ('s3', 'gone', 'c'), ('s4', 'alpha', '')) t(search_id, source, exact_query),
lateral (select case search_id when 's1' then n else 0 end as raw_count, case search_id when 's1' then n else 0 end as accepted_count, search_id <> 's1' as failed,
  search_id = 's2' as broke_off, 'p' as protocol_hash from n)""")
def u1_log(spark, d):
    _, log = _searched(spark, d)
    return log.select("search_id", "source", "exact_query", "raw_count", "accepted_count", F.col("error").isNotNull().alias("failed"),
                      F.coalesce(F.col("error").contains("the source broke off"), F.lit(False)).alias("broke_off"), "protocol_hash")


@query("a16_searched_counts", f"""
with {SEARCHED_SQL}, c as (select search_id, count(*) as raw_count, count(distinct record_key) as unique_count from found group by 1),
l as (select * from (values ('s1', 1, 0), ('s2', 1, 1), ('s3', 1, 1), ('s4', 1, 1)) t(search_id, runs, failures))
select search_id, coalesce(runs, 0)::bigint as runs, coalesce(failures, 0)::bigint as failures,
  coalesce(raw_count, 0) as raw_count, coalesce(unique_count, 0) as unique_count from l full join c using (search_id)""")
def a16_counts(spark, d):
    raw, log = _searched(spark, d)
    return ops.search_summary(log, ops.with_record_key(raw))


@query("a16_run_summary", f"""
with {SEARCHED_SQL} select count(*) as raw_records, count(distinct record_key) as unique_records, 3::bigint as failures from found""")
def a16_run(spark, d):
    raw, log = _searched(spark, d)
    return ops.run_summary(log, ops.with_record_key(raw))


KNOWN = "select distinct '10.' || (doc_id % 97) || '/x' as doi from labels where toxic = 1"


def known_dois(spark, d):
    return table(spark, d, "labels").filter("toxic = 1").select(F.concat(F.lit("10."), (F.col("doc_id") % 97).cast("string"), F.lit("/x")).alias("doi"))


@query("j6_drop_known", f"""
with {RECORDS_SQL}, known as ({KNOWN})
select seq, doi from rec r where doi is null or not exists (select 1 from known k where k.doi = r.doi)""")
def j6(spark, d):
    return ops.drop_known(records(spark, d).select("seq", "doi"), known_dois(spark, d)).select("seq", "doi")


@query("j7_known_records", f"with {RECORDS_SQL}, known as ({KNOWN}) select seq, doi from rec where doi in (select doi from known)")
def j7(spark, d):
    return ops.known_records(records(spark, d).select("seq", "doi"), known_dois(spark, d)).select("seq", "doi")


@query("w9_first_seen", f"""
with {RECORDS_SQL}, x as (select seq, doi, row_number() over (partition by doi order by seq) as rn from rec)
select seq, doi from x where doi is null or rn = 1""")
def w9(spark, d):
    return first_seen(records(spark, d).select("seq", "doi"), "doi", "seq")


@query("j8_match_extractions", f"""
with {RECORDS_SQL},
base as (select *, source || '/file' || (seq % 200) || '.pdf' as source_file from rec),
ext as (
  select seq + 1000000 as extraction_id, case when seq % 11 = 0 then 'given' || seq else ' ' end as source_record_id,
    case when seq % 5 = 0 then '10.' || (seq % 97 + 1) || '/x' end as doi, pmid,
    case when seq % 2 = 0 then title_key else '' end as title_key, 'file' || (seq % 300) || '.pdf' as fname from base),
d1 as (select doi, min(raw_record_id) as r from base where doi is not null group by 1 having count(*) = 1),
d2 as (select pmid, min(raw_record_id) as r from base where pmid is not null group by 1 having count(*) = 1),
d3 as (select title_key, min(raw_record_id) as r from base where title_key <> '' group by 1 having count(*) = 1),
d4 as (select split_part(source_file, '/', 2) as fname, arg_min(raw_record_id, seq) as r from base group by 1)
select extraction_id,
  case when extraction_id % 11 = 1000000 % 11 then 'given' || (extraction_id - 1000000)
    else coalesce(d1.r, d2.r, d3.r, d4.r) end as record_id,
  case when extraction_id % 11 = 1000000 % 11 then 'explicit_input' when d1.r is not null then 'doi' when d2.r is not null then 'pmid'
    when d3.r is not null then 'title' when d4.r is not null then 'manual' else 'unlinked' end as link_method
from ext left join d1 using (doi) left join d2 on d2.pmid = ext.pmid
left join d3 on d3.title_key = coalesce(nullif(ext.title_key, ''), replace(ext.fname, '.pdf', ''))
left join d4 on d4.fname = ext.fname""")
def j8(spark, d):
    seq = F.col("seq")
    base = records(spark, d).withColumn(
        "source_file", F.concat("source", F.lit("/file"), (seq % 200).cast("string"), F.lit(".pdf"))).withColumn("record_id", F.col("raw_record_id"))
    ext = base.select(
        (seq + 1000000).alias("extraction_id"),
        F.when(seq % 11 == 0, F.concat(F.lit("given"), seq.cast("string"))).otherwise(" ").alias("source_record_id"),
        F.when(seq % 5 == 0, F.concat(F.lit("10."), (seq % 97 + 1).cast("string"), F.lit("/x"))).alias("doi"), "pmid",
        F.when(seq % 2 == 0, F.col("title")).otherwise("").alias("title"),
        F.concat(F.lit("file"), (seq % 300).cast("string"), F.lit(".pdf")).alias("source_file"))
    return ops.match_extractions(ext, base).select("extraction_id", "record_id", "link_method")


@query("j28_reconcile", f"""
with {RECORDS_SQL}, known as ({KNOWN})
select doi, case when doi in (select doi from known) then 1 else 0 end as found from (select distinct doi from rec where doi is not null)""")
def j28(spark, d):
    out = ops.reconcile(records(spark, d).select(F.upper("doi").alias("doi")), known_dois(spark, d))
    return out.select("doi", F.col("found").cast("int").alias("found"))


@query("a16_search_summary", """
select event_type as search_id, count(*) as runs, count(*) filter (where event_id % 10 = 0) as failures from events group by 1""")
def a16(spark, d):
    log = table(spark, d, "events").select(
        F.col("event_type").alias("search_id"), F.when(F.col("event_id") % 10 == 0, "failed").alias("error"))
    return ops.search_summary(log)


# --- rule screening -------------------------------------------------------

RULES = {"categories": {
    "topic": {"terms": ["the", "and"], "weight": 3, "required_for_tier_a": True},
    "method": {"terms": ["with", "from", "der"], "weight": 2, "required_for_tier_a": True},
    "phrase": {"terms": ["of the", "it on"], "weight": 1},
    "noise": {"terms": ["que", "und"], "weight": -2},
}}


def candidates(spark, d):
    doc = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", "text", "source").select(
        doc.alias("seq"), (2010 + doc % 16).cast("int").alias("year"), (doc % 12).cast("int").alias("citations"),
        F.when(doc % 3 == 0, F.concat(F.lit("10."), (doc % 211).cast("string"), F.lit("/x"))).alias("doi"),
        X.text_blob(F.substring_index("text", "\n", 1), "text", "source").alias("blob"))


def _has(term: str) -> str:
    if " " in term:
        return f"contains(blob, '{term}')"
    return f"regexp_matches(blob, '(^|[^a-z0-9]){term}([^a-z0-9]|$)')"


def _any(category: str) -> str:
    return "(" + " or ".join(_has(t) for t in RULES["categories"][category]["terms"]) + ")"


CAND_SQL = """
cand as (select doc_id as seq, 2010 + doc_id % 16 as year, doc_id % 12 as citations,
  case when doc_id % 3 = 0 then '10.' || (doc_id % 211) || '/x' end as doi,
  lower(split_part(text, chr(10), 1) || ' ' || text || ' ' || source) as blob from documents)"""
SCREEN_SQL = f"""{CAND_SQL},
hit as (select *, {_any('topic')} as h1, {_any('method')} as h2, {_any('phrase')} as h3, {_any('noise')} as h4,
  case when year >= 2024 then 0 when year >= 2021 then case when citations < 3 then -1 else 0 end
    when citations < 5 then -2 when citations < 10 then -1 else 0 end as penalty from cand),
scored as (select *, 3 * h1::int + 2 * h2::int + h3::int - 2 * h4::int + penalty as score from hit),
screened as (select *, case when h1 and h2 then 'A' when score >= 4 then 'B' else 'C' end as tier from scored)"""


@query("p7_p8_matched_terms", f"""
with {CAND_SQL} select seq, list_aggregate(list_filter([case when {_has('and')} then 'and' end, case when {_has('it on')} then 'it on' end,
  case when {_has('of the')} then 'of the' end, case when {_has('the')} then 'the' end], lambda x: x is not null), 'string_agg', '|') as hits,
  length(blob) as blob_chars from cand""")
def p8(spark, d):
    c = candidates(spark, d)
    joined = F.array_join(R.matched_terms("blob", ["the", "and", "of the", "it on"]), "|")
    return c.select("seq", F.nullif(joined, F.lit("")).alias("hits"), F.length("blob").cast("bigint").alias("blob_chars"))


@query("p9_citation_penalty", f"with {SCREEN_SQL} select seq, cast(penalty as bigint) as penalty from hit")
def p9(spark, d):
    return candidates(spark, d).select("seq", R.citation_penalty("year", "citations").cast("bigint").alias("penalty"))


@query("p10_screen", f"with {SCREEN_SQL} select seq, cast(score as bigint) as score, tier, case when score >= 4 then 1 else 0 end as keep from screened")
def p10(spark, d):
    s = candidates(spark, d).select("seq", R.screen("blob", "year", "citations", R.categories_from(RULES)).alias("s"))
    return s.select("seq", F.col("s.score").cast("bigint").alias("score"), F.col("s.tier").alias("tier"), F.col("s.keep").cast("int").alias("keep"))


@query("t7_screen_reasons", f"""
with {SCREEN_SQL}
select seq, concat_ws('; ', case when h1 then 'topic:' || concat_ws(',', case when {_has('and')} then 'and' end, case when {_has('the')} then 'the' end) end,
  case when h2 then 'method:' || concat_ws(',', case when {_has('der')} then 'der' end, case when {_has('from')} then 'from' end, case when {_has('with')} then 'with' end) end,
  case when not (h1 and h2) and h3 then 'phrase:' || concat_ws(',', case when {_has('it on')} then 'it on' end, case when {_has('of the')} then 'of the' end) end,
  case when h1::int + h2::int + h3::int < 2 and h4 then 'exclude:' || concat_ws(',', case when {_has('que')} then 'que' end, case when {_has('und')} then 'und' end) end,
  case when h1::int + h2::int + h3::int + h4::int < 2 and penalty <> 0 then citations || ' citations for ' || case when year < 2021 then 'older paper' else cast(year as varchar) end end) as reasons
from screened""")
def t7(spark, d):
    s = candidates(spark, d).select("seq", R.screen("blob", "year", "citations", R.categories_from(RULES)).alias("s"))
    return s.select("seq", F.array_join(first_n("s.reasons", 2), "; ").alias("reasons"))


@query("p11_p12_filter_candidates", f"""
with {SCREEN_SQL}, known as (select distinct '10.' || (doc_id % 211) || '/x' as doi from labels where toxic = 1),
fresh as (select *, row_number() over (partition by doi order by seq) as rn from screened
  where doi is null or doi not in (select doi from known))
select seq, 'base|screen:' || tier || '|score:' || score as tags from fresh where (doi is null or rn = 1) and score >= 4""")
def p11(spark, d):
    known = table(spark, d, "labels").filter("toxic = 1").select(F.concat(F.lit("10."), (F.col("doc_id") % 211).cast("string"), F.lit("/x")).alias("doi"))
    out = ops.filter_candidates(candidates(spark, d), known, R.categories_from(RULES), base_tag="base")
    return out.select("seq", F.array_join("tags", "|").alias("tags"))


@query("p11_min_citations", f"""
with {CAND_SQL}, fresh as (select *, row_number() over (partition by doi order by seq) as rn from cand)
select seq, citations from fresh where (doi is null or rn = 1) and citations >= 5""")
def p11b(spark, d):
    c = candidates(spark, d)
    return ops.filter_candidates(c, c.select("doi").filter("false"), min_citations=5).select("seq", F.col("citations").cast("bigint").alias("citations"))


@query("p15_author_name", """
with n as (select c_custkey, case when c_custkey % 3 = 0 then c_name when c_custkey % 3 = 1 then c_mktsegment || ', ' || c_name
  else c_name || '  van  ' || c_mktsegment end as name from customer)
select c_custkey, case when c_custkey % 3 = 1 then c_mktsegment when c_custkey % 3 = 2 then c_mktsegment end as last_name,
  case when c_custkey % 3 = 1 then c_name when c_custkey % 3 = 2 then c_name || ' van' end as first_name,
  case when c_custkey % 3 = 0 then c_name end as single_name from customer""")
def p15(spark, d):
    k = F.col("c_custkey") % 3
    name = (F.when(k == 0, F.col("c_name")).when(k == 1, F.concat("c_mktsegment", F.lit(", "), "c_name"))
            .otherwise(F.concat("c_name", F.lit("  van  "), "c_mktsegment")))
    a = X.author_name(name)
    return table(spark, d, "customer").select("c_custkey", a["last"].alias("last_name"), a["first"].alias("first_name"), a["name"].alias("single_name"))


@query("p16_year", """
select o_orderkey, case when o_orderkey % 4 = 3 then null else year(o_orderdate) end as year from orders""")
def p16(spark, d):
    k = F.col("o_orderkey") % 4
    text = (F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "yyyy MMM"))
            .when(k == 2, F.date_format("o_orderdate", "' 'yyyy")).otherwise(F.date_format("o_orderdate", "MMM-yyyy")))
    return table(spark, d, "orders").select("o_orderkey", X.year_of(text).cast("bigint").alias("year"))
