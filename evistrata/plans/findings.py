"""Queries over findings, verdicts and table views."""

from __future__ import annotations

from pyspark.sql import functions as F

from evistrata.common import cut_lineage
from evistrata.functions import findings as N
from evistrata.functions import values as V
from evistrata.operators import findings as ops
from evistrata.plans.registry import query, table


def tag(prefix, col, m):
    return F.concat(F.lit(prefix), (F.col(col) % m).cast("string"))


def payloads(spark, d):
    """One JSON result per event, written the loose ways such results come in."""
    e = F.col("event_id")
    kind = F.col("event_type")
    level = F.when(kind == "click", " Direct").when(kind == "view", "indirect").when(kind == "purchase", "background").when(kind == "signup", "unheard").otherwise("irrelevant")
    direction = F.when(e % 4 == 0, "Increase").when(e % 4 == 1, "upwards").when(e % 4 == 2, "mixed")
    variables = F.concat(
        F.lit('[{"name":"'), tag("V", "event_id", 5), F.lit('","role":"Outcome"},"plain",{"name":"","role":"x"},{"name":"W","role":"odd"}]'))
    finding = F.concat(
        F.lit('{"claim":"c'), e.cast("string"), F.lit('","relevance_level":"'), level, F.lit('"'),
        F.when(e % 10 == 3, ',"include_in_main_report":false').otherwise(""),
        F.lit(',"relation":{"subject":" '), tag("S", "event_id", 7), F.lit('","object":"'), tag("O", "event_id", 11), F.lit('"'),
        F.when(direction.isNotNull(), F.concat(F.lit(',"direction":"'), direction, F.lit('"'))).otherwise(""), F.lit("}"),
        F.when(e % 6 == 5, ',"context":"none"').otherwise(F.concat(F.lit(',"context":{"condition":"'), tag("C", "user_id", 5), F.lit('","sample_or_system":"'), tag("P", "user_id", 3), F.lit('"}'))),
        F.lit(',"variables":'), variables, F.lit(',"constraints":["k ",null,""],"'),
        F.when(e % 2 == 0, "topic_tags").otherwise("tags"), F.lit('":{"area":"'), tag("T", "event_id", 3), F.lit('","blank":""}}'))
    payload = F.concat(F.lit('{"relevant":'), F.when(e % 3 == 0, "true").otherwise("false"), F.lit(',"findings":["text",'), finding, F.lit("]}"))
    return table(spark, d, "events").select(F.col("user_id").alias("doc_id"), e.alias("seq"), F.concat(F.lit("title "), (F.col("user_id") % 40).cast("string")).alias("title"), payload.alias("payload"))


def findings(spark, d):
    return ops.normalize_findings(payloads(spark, d))


def written_findings(spark, d):
    """Findings materialised once, as a pipeline would before using them several times."""
    return cut_lineage(findings(spark, d))


FINDINGS_SQL = """
f0 as (select user_id as doc_id, event_id as seq, 'title ' || (user_id % 40) as title, event_id % 3 = 0 as rel0,
  case event_type when 'click' then 'direct' when 'view' then 'indirect' when 'purchase' then 'background' when 'error' then 'irrelevant'
    else case when event_id % 3 = 0 then 'direct' else 'irrelevant' end end as relevance_level,
  'S' || (event_id % 7) as subject, 'O' || (event_id % 11) as object,
  case event_id % 4 when 0 then 'increase' when 2 then 'mixed' else 'not_applicable' end as direction,
  case when event_id % 6 = 5 then '' else 'C' || (user_id % 5) end as condition, case when event_id % 6 = 5 then '' else 'P' || (user_id % 3) end as sample,
  'V' || (event_id % 5) as var, 'T' || (event_id % 3) as area, event_id from events),
f as (select *, relevance_level = 'direct' and event_id % 10 <> 3 as inc from f0 where relevance_level <> 'irrelevant')"""


@query("p24_p25_normalized_findings", f"""
with {FINDINGS_SQL} select seq, 'c' || seq as claim, relevance_level, inc::int as include, subject, direction, condition, var || ':outcome,plain:unknown,W:unknown' as variables, 'k' as constraints, 'area=' || area as tags from f""")
def p24(spark, d):
    f = findings(spark, d)
    variables = F.array_join(F.transform("variables", lambda v: F.concat(v["name"], F.lit(":"), v["role"])), ",")
    tags = F.array_join(F.transform(F.map_entries("topic_tags"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return f.select("seq", "claim", "relevance_level", F.col("include_in_main_report").cast("int").alias("include"), F.col("relation.subject").alias("subject"),
                    F.col("relation.direction").alias("direction"), F.col("context.condition").alias("condition"), variables.alias("variables"),
                    F.array_join("constraints", ",").alias("constraints"), tags.alias("tags"))


@query("p25_document_relevance", f"with {FINDINGS_SQL} select event_id as seq, (rel0 or relevance_level <> 'irrelevant')::int as relevant from f0")
def p25(spark, d):
    return ops.document_relevance(payloads(spark, d)).select("seq", F.col("relevant").cast("int").alias("relevant"))


@query("p26_metadata_text", f"""
with {FINDINGS_SQL} select seq, 'relation: subject=' || subject || '; object=' || object || case when direction <> 'not_applicable' then '; direction=' || direction else '' end ||
  case when condition <> '' then ' | context: sample_or_system=' || sample || '; condition=' || condition else '' end || ' | variables: ' || var || '(outcome), plain(unknown), W(unknown) | topic_tags: area=' || area as metadata from f""")
def p26(spark, d):
    return findings(spark, d).select("seq", N.metadata_text(F.col("relation"), F.col("context"), F.col("variables"), F.col("topic_tags")).alias("metadata"))


@query("a6_relevance_counts", f"""
with {FINDINGS_SQL} select count(*) as findings, count(*) filter (where relevance_level = 'direct') as direct, count(*) filter (where relevance_level = 'indirect') as indirect,
  count(*) filter (where relevance_level = 'background') as background, count(distinct doc_id) as relevant_documents from f""")
def a6(spark, d):
    return ops.relevance_counts(findings(spark, d))


DIM_SQL = """
dim as (select 'field' as kind, unnest(['subject', 'object', 'direction', 'condition', 'sample_or_system', 'variable', 'variable', 'variable']) as dimension,
    unnest([subject, object, nullif(direction, 'not_applicable'), nullif(condition, ''), nullif(sample, ''), var, 'plain', 'W']) as value from f
  union all select 'tag', 'area', area from f),
cnt as (select kind, dimension, value, count(*) as n from dim where value is not null group by 1, 2, 3)"""


@query("a7_dimension_counts", f"with {FINDINGS_SQL}, {DIM_SQL} select kind, dimension, value, n from cnt")
def a7(spark, d):
    return ops.dimension_counts(findings(spark, d))


@query("a7_leading_dimension", f"""
with {FINDINGS_SQL}, {DIM_SQL}, best as (select kind, dimension from cnt where (kind = 'field' and n >= 3) or (kind = 'tag' and n >= 2) order by kind, n desc, dimension, value limit 1)
select kind, dimension, value, n from cnt join best using (kind, dimension) order by n desc, value limit 4""")
def a7b(spark, d):
    return ops.leading_dimension(ops.dimension_counts(written_findings(spark, d))).select("kind", "dimension", "value", "n")


def references(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("doc_id")).distinct().select("doc_id", (F.col("doc_id") + 1).alias("ref_num"), (F.col("doc_id") % 20 + 2000).alias("year"))


def indexed(spark, d):
    return cut_lineage(ops.index_findings(written_findings(spark, d), references(spark, d)))


IDX_SQL = "idx as (select *, row_number() over (order by seq) - 1 as index, doc_id + 1 as ref_num, doc_id % 20 + 2000 as year from f)"


@query("j20_indexed_findings", f"with {FINDINGS_SQL}, {IDX_SQL} select seq, index, ref_num, year from idx")
def j20(spark, d):
    return indexed(spark, d).select("seq", "index", "ref_num", "year")


@query("u5_main_findings", f"""
with {FINDINGS_SQL} select seq, 'all' as pool from f where inc union all select seq, 'spare' from f where relevance_level in ('indirect', 'background')""")
def u5(spark, d):
    f = written_findings(spark, d).select("seq", "relevance_level", "include_in_main_report")
    spare = ops.main_findings(f.filter("relevance_level <> 'direct'")).select("seq", F.lit("spare").alias("pool"))
    return ops.main_findings(f).select("seq", F.lit("all").alias("pool")).unionByName(spare)


LEAVES = [
    {"heading": "A", "criteria": [("relation", "subject", "S1"), ("context", "condition", "C2")]},
    {"heading": "B", "criteria": [("variables", "", "V3"), ("topic_tags", "area", "T1"), ("relation", "direction", "mixed")]},
    {"heading": "C", "criteria": [("relation", "subject", "nobody")]},
]
LEAF_SQL = f"""
{FINDINGS_SQL}, {IDX_SQL}, main as (select * from idx where inc),
m as (select 0 as leaf, index, (subject = 'S1')::int + (condition = 'C2')::int as matches from main
  union all select 1, index, (var = 'V3')::int + (area = 'T1')::int + (direction = 'mixed')::int from main),
r as (select *, row_number() over (partition by leaf order by matches desc, index) as rank from m where matches > 0),
leafm as (select leaf, index, matches, rank from r where rank <= 8 union all
  select 2, index, 0, row_number() over (order by index) from (select index from main order by index limit 8))"""


@query("j23_match_leaves", f"with {LEAF_SQL} select leaf, index, matches, cast(rank as int) as rank from leafm")
def j23(spark, d):
    return ops.match_leaves(ops.main_findings(indexed(spark, d)), LEAVES).select("leaf", "index", "matches", "rank")


@query("a19_match_coverage", f"""
with {LEAF_SQL} select (select count(*) from main) as candidates, (select count(distinct index) from leafm) as matched, (select count(*) from main) - (select count(distinct index) from leafm) as dropped,
  round((select count(distinct index) from leafm) / (select count(*) from main), 4) as coverage""")
def a19(spark, d):
    main = ops.main_findings(indexed(spark, d))
    return ops.match_coverage(ops.match_leaves(main, LEAVES), main)


@query("t3_accepted_matches", f"""
with {FINDINGS_SQL}, {IDX_SQL}, p as (select 'leaf' || (l_suppkey % 10) as leaf, l_partkey as index, min(l_orderkey * 10 + l_linenumber) as position from lineitem group by 1, 2),
r as (select *, row_number() over (partition by leaf order by position, index) as rank from p where index in (select index from idx where inc))
select leaf, count(*) as n, min(position) as first_position, max(position) as last_position from r where rank <= 8 group by 1""")
def t3(spark, d):
    li = table(spark, d, "lineitem")
    p = li.select(tag("leaf", "l_suppkey", 10).alias("leaf"), F.col("l_partkey").alias("index"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"))
    out = ops.accepted_matches(p, ops.main_findings(indexed(spark, d)))
    return out.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("first_position"), F.max("position").alias("last_position"))


@query("a20_candidate_values", f"""
with {FINDINGS_SQL} select distinct kind, value from (select unnest(['population', 'intervention', 'outcome', 'seed', 'variable', 'variable', 'variable']) as kind, unnest([nullif(sample, ''), subject, object, title, var, 'plain', 'W']) as value from f) where value is not null""")
def a20(spark, d):
    return ops.candidate_values(findings(spark, d))


def cells(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return table(spark, d, "lineitem").join(part, "l_partkey").select("p_brand", F.concat("l_returnflag", (F.col("l_suppkey") % 400).cast("string")).alias("cell"))


CELL_SQL = "c as (select p_brand as row_value, l_returnflag || (l_suppkey % 400) as column_value, count(*) as n from lineitem join part on p_partkey = l_partkey group by 1, 2)"


@query("a31_crosstab", f"with {CELL_SQL} select row_value, column_value, n from c")
def a31(spark, d):
    return ops.crosstab(cells(spark, d), "p_brand", "cell")


@query("a31_crosstab_gaps", f"""
with {CELL_SQL} select r.row_value, k.column_value from (select distinct row_value from c) r cross join (select distinct column_value from c) k
where not exists (select 1 from c where c.row_value = r.row_value and c.column_value = k.column_value)""")
def a31b(spark, d):
    return ops.crosstab_gaps(ops.crosstab(cells(spark, d), "p_brand", "cell"))


@query("a31_gap_counts", f"""
with {CELL_SQL} select row_value, count(*) as filled, (select count(distinct column_value) from c) - count(*) as empty from c group by 1""")
def a31c(spark, d):
    return ops.crosstab_gap_counts(ops.crosstab(cells(spark, d), "p_brand", "cell"))


# The gaps of the brands that make the dearest part of a size.
@query("a31_asked_gaps", f"""
with {CELL_SQL}, asked as (select arg_max(p_brand, (p_retailprice, p_partkey)) as row_value from part group by p_size)
select r.row_value, k.column_value from (select distinct row_value from c where row_value in (select row_value from asked)) r
cross join (select distinct column_value from c) k
where not exists (select 1 from c where c.row_value = r.row_value and c.column_value = k.column_value)""")
def a31d(spark, d):
    asked = table(spark, d, "part").groupBy("p_size").agg(F.max_by("p_brand", F.struct("p_retailprice", "p_partkey")).alias("row_value"))
    return ops.crosstab_gaps(ops.crosstab(cells(spark, d), "p_brand", "cell"), asked)


def views(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    view = V.table_view(
        F.when(k % 3 != 0, F.col("o_orderpriority")), F.when(k % 11 != 0, F.concat(F.lit(" rows "), "o_orderstatus")), F.lit("columns"), F.lit(""),
        F.when(k % 2 == 0, "because"), F.when(k % 5 == 0, "high").otherwise((F.col("o_totalprice") / 400000 - 0.05).cast("string")), k)
    return o.select("o_custkey", k.alias("position"), view.alias("v")).filter("v is not null").select("o_custkey", "position", "v.*")


VIEW_SQL = """
v as (select o_custkey, o_orderkey as position, case when o_orderkey % 3 <> 0 then o_orderpriority else 'Summary table ' || o_orderkey end as title, 'rows ' || o_orderstatus as row_dimension,
  'finding; strength; citation' as cell_schema, case when o_orderkey % 2 = 0 then 'because' else '' end as why,
  case when o_orderkey % 5 = 0 then 0.0 else greatest(0.0, least(1.0, o_totalprice / 400000 - 0.05)) end as coverage from orders where o_orderkey % 11 <> 0)"""


@query("p49_table_views", f"with {VIEW_SQL} select position, title, row_dimension, cell_schema, why as coverage_rationale, coverage::double as coverage from v")
def p49(spark, d):
    return views(spark, d).select("position", "title", "row_dimension", "cell_schema", "coverage_rationale", "coverage")


@query("t4_best_views", f"""
with {VIEW_SQL}, r as (select *, row_number() over (partition by o_custkey order by coverage desc, why <> '' desc, length(row_dimension) desc, position) as rn from v)
select o_custkey, position, title from r where rn = 1""")
def t4(spark, d):
    return ops.best_views(views(spark, d), ["o_custkey"]).select("o_custkey", "position", "title")


@query("p53_notes", """
select 'd' || doc_id as file, '' as original_title, '' as title_cn, source as authors, '' as journal_impact, case when doc_id % 4 = 0 then '' else cast(2000 + doc_id % 20 as varchar) end as year, '' as background,
  '' as objective, '' as methods, lang as results, '' as conclusion, '' as limitations, '' as innovation from documents""")
def p53(spark, d):
    doc = F.col("doc_id")
    r = table(spark, d, "documents").select(
        F.concat(F.lit("d"), doc.cast("string")).alias("file"), F.col("source").alias("authors"), F.when(doc % 4 != 0, 2000 + doc % 20).alias("year"),
        F.col("lang").alias("results"), F.lit("dropped").alias("extra"))
    return ops.notes(r)


def verdicts(spark, d):
    lab = table(spark, d, "labels")
    level = (F.when((F.col("quality") == 1) & (F.col("toxic") == 0), F.when(F.col("doc_id") % 2 == 0, "full").otherwise("partial"))
             .when(F.col("quality") == 1, "weak").when(F.col("toxic") == 0, "none").otherwise("contradictory"))
    return lab.select((F.col("doc_id") % 300).alias("claim_id"), F.col("doc_id").alias("paper"), level.alias("level"))


VERDICT_SQL = """verdict as (select doc_id % 300 as claim_id, doc_id as paper, case when quality = 1 and toxic = 0 then case when doc_id % 2 = 0 then 'full' else 'partial' end
  when quality = 1 then 'weak' when toxic = 0 then 'none' else 'contradictory' end as level from labels)"""


@query("a29_support_counts", f"""
with {VERDICT_SQL} select claim_id, count(*) filter (where level = 'full') as "full", count(*) filter (where level = 'partial') as partial, count(*) filter (where level = 'weak') as weak,
  count(*) filter (where level = 'none') as "none", count(*) filter (where level = 'contradictory') as contradictory from verdict group by 1""")
def a29(spark, d):
    return ops.support_counts(verdicts(spark, d))


@query("j36_claims_with_verdicts", f"with {VERDICT_SQL} select doc_id as claim_id, paper, level, (level is not null)::int as verified from documents left join verdict on claim_id = doc_id")
def j36(spark, d):
    claims = table(spark, d, "documents").select(F.col("doc_id").alias("claim_id"))
    return ops.claims_with_verdicts(claims, verdicts(spark, d)).select("claim_id", "paper", "level", F.col("verified").cast("int").alias("verified"))


@query("p55_claim_shape", """
select doc_id, length(left(text, 1000)) as claim_chars, length(left(text, 500)) as scope_chars, case when doc_id % 2 = 0 then doc_id || ',7' else '7' end as refs,
  case when doc_id % 3 = 0 then 'high' else 'unclear' end as certainty, length(left(text, 300)) as location_chars from documents""")
def p55(spark, d):
    doc = F.col("doc_id")
    refs = F.array(F.when(doc % 2 == 0, doc.cast("string")).otherwise("x1"), F.lit(" 7"), F.lit(None).cast("string"))
    c = table(spark, d, "documents").select("doc_id", N.claim_shape(F.col("text"), F.col("text"), refs, F.when(doc % 3 == 0, "high"), F.col("text")).alias("c"))
    sizes = [F.length(f"c.{n}").cast("bigint").alias(f"{n}_chars") for n in ("claim", "scope", "location")]
    return c.select("doc_id", *sizes, F.array_join(F.col("c.evidence_refs").cast("array<string>"), ",").alias("refs"), F.col("c.certainty").alias("certainty"))


@query("j22_relevant_documents", r"""
with a as (select item_id as claim_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_\-]{3,}'))) as term from benchmark),
o as (select doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_\-]{3,}'))) as term from documents),
w as (select term, length(bin((select count(*) from documents) // count(*))) as weight from o group by 1),
s as (select claim_id, doc_id, count(*) as shared, sum(weight)::bigint as score from a join o using (term) join w using (term) group by 1, 2),
r as (select *, row_number() over (partition by claim_id order by score desc, doc_id) as rank from s)
select claim_id, doc_id, score, shared, cast(rank as int) as rank from r where rank <= 3""")
def j22(spark, d):
    claims = table(spark, d, "benchmark").select(F.col("item_id").alias("claim_id"), F.col("text").alias("claim"))
    return ops.relevant_documents(claims, table(spark, d, "documents").select("doc_id", "text"))
