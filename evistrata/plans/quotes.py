"""Queries over quotes, citations and prose."""

from __future__ import annotations

from pyspark.sql import functions as F

from evistrata.functions import text as X
from evistrata.functions.values import id_union
from evistrata.operators import quotes as ops
from evistrata.plans.registry import query, table


def quotes(spark, d):
    """One quote per document: a copied passage, or a damaged, re-cased, short or missing one."""
    k = F.col("doc_id") % 6
    passage = F.substring("text", 11, 90)
    q = (F.when(k == 0, passage).when(k == 1, F.translate(F.regexp_replace(passage, r"[^\p{L}\p{N}_]+", " "), "aeinrst", "AEINRST")).when(k == 2, F.concat(F.lit("zq"), passage))
         .when(k == 3, F.substring("text", 11, 5)).when(k == 4, "").otherwise(F.concat(F.substring("text", 11, 70), F.lit("zzqq"))))
    return table(spark, d, "documents").select("doc_id", q.alias("quote"))


QUOTES_SQL = r"""
q as (select doc_id, text, case doc_id % 6 when 0 then substr(text, 11, 90) when 1 then translate(regexp_replace(substr(text, 11, 90), '[^\p{L}\p{N}_]+', ' ', 'g'), 'aeinrst', 'AEINRST')
  when 2 then 'zq' || substr(text, 11, 90) when 3 then substr(text, 11, 5) when 4 then '' else substr(text, 11, 70) || 'zzqq' end as quote from documents),
n as (select doc_id, text, quote, regexp_replace(lower(text), '[^\p{L}\p{N}_]+', '', 'g') as lt, regexp_replace(lower(substr(quote, 1, 60)), '[^\p{L}\p{N}_]+', '', 'g') as q60,
  regexp_replace(lower(quote), '[^\p{L}\p{N}_]+', '', 'g') as qf, regexp_replace(quote, '^[\s\pZ]+|[\s\pZ]+$', '', 'g') as sq,
  trim(regexp_replace(lower(replace(nfc_normalize(text), 'ß', 'ss')), '[^\p{L}\p{N}]+', ' ', 'g')) as ft,
  trim(regexp_replace(lower(replace(nfc_normalize(quote), 'ß', 'ss')), '[^\p{L}\p{N}]+', ' ', 'g')) as fq from q),
v as (select *, quote = '' or (q60 <> '' and contains(lt, q60)) or (qf <> '' and contains(lt, qf)) as found from n)"""


def docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


@query("j21_p28_prefix_quotes", f"with {QUOTES_SQL} select doc_id, found::int as found from v")
def p28(spark, d):
    return ops.verify_prefixes(quotes(spark, d), docs(spark, d)).select("doc_id", F.col("found").cast("int").alias("found"))


@query("a17_pass_rates", f"""
with {QUOTES_SQL} select doc_id % 6 as kind, count(*) as quotes, count(*) filter (where not found) as failed,
  round(count(*) filter (where found) * 100.0 / count(*), 6)::double as pass_rate from v group by 1""")
def a17(spark, d):
    v = ops.verify_prefixes(quotes(spark, d), docs(spark, d)).withColumn("kind", F.col("doc_id") % 6)
    return ops.pass_rates(v, ["kind"]).withColumn("pass_rate", F.round("pass_rate", 6))


@query("j21_p27_validated_quotes", f"""
with {QUOTES_SQL} select doc_id, case when length(sq) < 12 then 'failed' when contains(text, sq) then 'passed' when length(fq) >= 12 and contains(ft, fq) then 'passed' else 'failed' end as status,
  case when length(sq) < 12 then 'none' when contains(text, sq) then 'exact' else 'normalized' end as method from v""")
def p27(spark, d):
    v = ops.validate_quotes(quotes(spark, d), docs(spark, d))
    return v.select("doc_id", F.col("check.validation_status").alias("status"), F.col("check.validation_method").alias("method"))


# Reports: prose citing numbers, with a reference list for most documents.
def reports(spark, d):
    doc = F.col("doc_id")
    n = doc % 9 + 1
    cite = F.concat(F.lit("\nSeen [1, 3-5] and ["), n.cast("string"), F.lit("] not [9-2] or ["), (n + 20).cast("string"), F.lit("-"), (n + 21).cast("string"), F.lit("] x []."))
    refs = F.concat(F.lit("\n## References\n[1] Au One. *Title 1 of "), doc.cast("string"), F.lit("*. 2001.\n[3] Au Two. *Other*. 2003.\n[3] Twice\n[4] Au Four. *Title 4 of "),
                    doc.cast("string"), F.lit("*. 1999.\n["), (n + 30).cast("string"), F.lit("] Orphan. 2000."))
    report = F.concat("text", cite, F.when(doc % 4 != 0, refs).otherwise(""))
    return table(spark, d, "documents").select(doc.alias("report_id"), report.alias("report"))


def known_refs(spark, d):
    doc = F.col("doc_id")
    row = F.explode(F.array(*[F.lit(i) for i in (1, 3, 4, 5, 24)]))
    return table(spark, d, "documents").select(doc.alias("report_id"), row.alias("num")).select(
        "report_id", "num", F.lit("Au").alias("authors"),
        F.concat(F.lit("Title "), F.col("num").cast("string"), F.lit(" of "), F.col("report_id").cast("string")).alias("title"), (F.col("num") + 2000).alias("year"))


CITES_SQL = """
n as (select doc_id as report_id, doc_id % 9 + 1 as n, doc_id % 4 <> 0 as listed from documents),
cite as (select report_id, unnest([1, 3, 4, 5, n, n + 20, n + 21]) as num from n),
body as (select distinct report_id, num from cite),
refs as (select report_id, unnest([1, 3, 3, 4, n + 30]) as num, unnest(['Au One. *Title 1 of ' || report_id || '*. 2001.', 'Au Two. *Other*. 2003.', 'Twice', 'Au Four. *Title 4 of ' || report_id || '*. 1999.', 'Orphan. 2000.']) as line
  from n where listed),
ref as (select report_id, num, count(*) as k, min(line) as line from refs group by 1, 2),
known as (select doc_id as report_id, unnest([1, 3, 4, 5, 24]) as num from documents)"""


@query("p29_numeric_citations", f"with {CITES_SQL} select report_id, string_agg(cast(num as varchar), ',' order by i) as numbers from (select report_id, unnest([1, 3, 4, 5, n, n + 20, n + 21]) as num, unnest([1,2,3,4,5,6,7]) as i from n) group by 1")
def p29(spark, d):
    r = reports(spark, d).select("report_id", X.split_references("report")["body"].alias("b"))
    return r.select("report_id", F.array_join(X.numeric_citations("b").cast("array<string>"), ",").alias("numbers"))


@query("p30_sanitized_citations", """
select doc_id as report_id, md5(text || chr(10) || 'Seen [1, 4] and ' || case when n in (1, 4) then '[' || n || ']' else '' end || ' not  or ' ||
  case when n = 4 then '[24, 25]' when n = 3 then '[24]' when n = 5 then '[25]' else '' end || ' x [].') as digest from (select doc_id, text, doc_id % 9 + 1 as n from documents)""")
def p30(spark, d):
    r = reports(spark, d).select("report_id", X.split_references("report")["body"].alias("body"))
    allowed = F.array(*[F.lit(i).cast("bigint") for i in (25, 4, 1, 24)])
    return r.select("report_id", F.md5(X.sanitize_citations("body", allowed)).alias("digest"))


@query("j24_reference_issues", f"""
with {CITES_SQL}, e as (
select report_id, num, 'missing_reference' as issue, 'error' as severity from body where (report_id, num) not in (select (report_id, num) from ref)
union all select report_id, num, 'orphan_reference', 'warning' from ref where (report_id, num) not in (select (report_id, num) from body)
union all select report_id, num, 'unknown_citation', 'error' from body where (report_id, num) not in (select (report_id, num) from known)
union all select report_id, num, 'unknown_reference', 'error' from ref where (report_id, num) not in (select (report_id, num) from known)
union all select report_id, num, 'duplicate_reference', 'error' from ref where k > 1
union all select report_id, num, 'year_missing', 'warning' from ref join known using (report_id, num) where not contains(line, cast(num + 2000 as varchar))
union all select report_id, num, 'title_mismatch', 'warning' from ref join known using (report_id, num) where not contains(line, 'Title ' || num || ' of ' || report_id)
union all select report_id, null, 'reference_list_missing', 'error' from n where not listed)
select report_id, cast(num as bigint) as num, issue, severity from e""")
def j24(spark, d):
    return ops.reference_issues(reports(spark, d), known_refs(spark, d))


@query("j25_cited_references", f"with {CITES_SQL} select report_id, cast(num as bigint) as num from known where (report_id, num) in (select (report_id, num) from body)")
def j25(spark, d):
    return ops.cited_references(reports(spark, d), known_refs(spark, d)).select("report_id", "num")


@query("j25_clean_reports", f"""
with {CITES_SQL}, keep as (select report_id, string_agg('[' || num || '] Au. *Title ' || num || ' of ' || report_id || '*. ' || (num + 2000) || '.', chr(10) order by num) as lines
  from known where (report_id, num) in (select (report_id, num) from body) group by 1)
select report_id, chr(10) || lines as refs from keep join n using (report_id) where listed""")
def j25b(spark, d):
    out = ops.clean_reports(reports(spark, d), known_refs(spark, d)).filter("report_id % 4 <> 0")
    return out.select("report_id", F.substring_index("report", "\n## References\n", -1).alias("refs"))


@query("p46_reference_lines", f"with {CITES_SQL} select report_id, cast(num as bigint) as num, line from refs")
def p46(spark, d):
    r = reports(spark, d).select("report_id", F.explode_outer(X.reference_lines(X.split_references("report")["references"])).alias("l"))
    return r.filter("l is not null").select("report_id", "l.num", "l.line")


@query("p31_study_citations", """
with t as (select doc_id as section_id, doc_id % 50 as a, doc_id % 70 as b from documents),
known as (select unnest(['study_' || c_custkey, 'trial-' || c_custkey || 'x', 'RCT-2020-smith-' || c_custkey || '-a-b', 'arm_' || c_custkey]) as id from customer),
tok as (select section_id, unnest(['study_' || a, 'pub_u' || b, 'cohort_' || b, 'arm_z' || b, 'RCT-2020-smith-' || (a + 1) || '-a-b', case when a % 2 = 0 then 'trial-' || b || 'x' end]) as token from t)
select distinct section_id, token, case when token in (select id from known) then 1 else 0 end as known from tok where token is not null and (regexp_matches(token, '^(study|pub|cohort|arm)_') or token in (select id from known))""")
def p31(spark, d):
    doc = F.col("doc_id")
    a, b = (doc % 50).cast("string"), (doc % 70).cast("string")
    trial = F.when(doc % 50 % 2 == 0, F.concat(F.lit(" see trial-"), b, F.lit("x;"))).otherwise("")
    own = F.concat(F.lit("\nAs [study_"), a, F.lit("] and pub_u"), b, F.lit(", mystudy_9, pre-arm_z"), b, F.lit(" or cohort_"), b, F.lit(" show; (RCT-2020-smith-"), (doc % 50 + 1).cast("string"), F.lit("-a-b)."), trial)
    text = F.concat("text", own)
    texts = table(spark, d, "documents").select(doc.alias("section_id"), text.alias("text"))
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("k"))
    shapes = F.array(F.concat(F.lit("study_"), "k"), F.concat(F.lit("trial-"), "k", F.lit("x")), F.concat(F.lit("RCT-2020-smith-"), "k", F.lit("-a-b")), F.concat(F.lit("arm_"), "k"))
    known = c.select(F.explode(shapes).alias("study_id"))
    return ops.study_citations(texts, known, prefixes=["cohort"]).select("section_id", "token", F.col("known").cast("int").alias("known"))


@query("p32_sentences", r"""
with l as (select conv_id, turn, n, regexp_replace(regexp_replace(line, '^\s*([-*+]\s+|>\s+|#{1,6}\s+)', ''), '^[\s\pZ]+|[\s\pZ]+$', '', 'g') as line from
  (select conv_id, turn, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from conversations)),
p as (select conv_id, turn, unnest(string_split(regexp_replace(line, '([.!?。！？])\s+', '\1' || chr(1), 'g'), chr(1))) as s from l where line <> '')
select conv_id, turn, count(*) as sentences, sum(length(s))::bigint as chars, max(s) as last from p where s <> '' group by 1, 2""")
def p32(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.explode(X.sentences("text")).alias("s"))
    return c.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("sentences"), F.sum(F.length("s")).alias("chars"), F.max("s").alias("last"))


@query("p33_coverage_text", r"""
select conv_id, turn, md5(replace(lower(trim(regexp_replace(replace(replace(replace(text, '*', ''), '_', ''), '`', ''), '[\s\pZ]+', ' ', 'g'))), 'ß', 'ss')) as digest from conversations""")
def p33(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(X.coverage_text("text")).alias("digest"))


@query("p45_report_sections", """
select conv_id, turn, 'A' as title, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) as body from conversations
union all select conv_id, turn, 'B', md5('tail') from conversations""")
def p45(spark, d):
    c = table(spark, d, "conversations")
    report = F.concat(F.lit("# Top\nintro\n## A\n\n"), "text", F.lit("\n## AB\nnot this\n## B\ntail \n"))
    r = c.select("conv_id", "turn", report.alias("r"))
    parts = [r.select("conv_id", "turn", F.lit(t).alias("title"), F.md5(X.report_section("r", F.lit(t))).alias("body")) for t in ("A", "B")]
    return parts[0].unionByName(parts[1])


@query("p45_report_headings", r"""
with h as (select conv_id, turn, role, list_transform(regexp_extract_all(chr(10) || coalesce(text, ''), '\n##[ \t]+[^\n]*'), lambda x: regexp_replace(substr(x, 4), '^\s+|\s+$', '', 'g')) as own from conversations)
select conv_id, turn, array_to_string(['A', 'AB'] || list_filter(list_distinct(own), lambda x: x not in ('', 'A', 'AB', role)) || [role], ',') as headings from h""")
def p45b(spark, d):
    report = F.concat(F.lit("# Top\n## A\nx\n## AB \n## A\n"), F.coalesce("text", F.lit("")), F.lit("\n## "), "role", F.lit("\ny ## no"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(X.report_headings(report), ",").alias("headings"))


@query("p44_lenient_json", """
select conv_id, turn, case when turn % 4 = 3 then null else role end as role, case when turn % 4 = 3 then null else turn end as t from conversations""")
def p44(spark, d):
    body = F.to_json(F.struct("role", F.col("turn").alias("t")))
    k = F.col("turn") % 4
    text = (F.when(k == 0, F.concat(F.lit("```json\n"), body, F.lit("\n``` "))).when(k == 1, body)
            .when(k == 2, F.concat(F.lit("Sure {x: "), body, F.lit(" done"))).otherwise("no json here {"))
    parsed = table(spark, d, "conversations").select("conv_id", "turn", X.lenient_json(text).alias("j"))
    return parsed.select("conv_id", "turn", F.get_json_object("j", "$.role").alias("role"), F.get_json_object("j", "$.t").cast("bigint").alias("t"))


@query("p50_missing_qualifiers", """
select conv_id, turn, array_to_string(list_filter(['THE', 'Que', role], lambda q: not contains(lower(text), lower(q))), ',') as missing from conversations""")
def p50(spark, d):
    required = F.array(F.lit("THE"), F.lit("Que"), F.col("role"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(X.missing_qualifiers("text", required), ",").alias("missing"))


@query("p51_claim_study_ids", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, string_agg(x, ',' order by i) as ids from (select *, row_number() over (partition by l_orderkey, l_linenumber, l_partkey, l_suppkey, x order by i) as rn from
 (select l_orderkey, l_linenumber, l_partkey, l_suppkey, unnest(['p' || l_partkey % 5, 's' || l_suppkey % 3, 'p' || l_suppkey % 5, l_returnflag]) as x, unnest([1, 2, 3, 4]) as i from (select distinct l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag from lineitem)))
where rn = 1 group by all""")
def p51(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").distinct()
    def tag(prefix, col, m):
        return F.concat(F.lit(prefix), (F.col(col) % m).cast("string"))
    ids = id_union(F.array(tag(" p", "l_partkey", 5), tag("s", "l_suppkey", 3)), F.array(F.lit(" "), tag("p", "l_suppkey", 5)), F.lit(None).cast("array<string>"), F.array("l_returnflag"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join(ids, ",").alias("ids"))


@query("p52_outline_nodes", """
with n as (select n_regionkey, string_agg(n_name, ',' order by n_nationkey) as kids from nation group by 1)
select r_name, 1 as depth, r_name as heading, case when n_regionkey is null then 1 else 0 end as is_leaf from region left join n on n_regionkey = r_regionkey
union all select r_name, 2, n_name, 0 from region join nation on n_regionkey = r_regionkey
union all select r_name, 3, n_name || ' detail', 1 from region join nation on n_regionkey = r_regionkey""")
def p52(spark, d):
    n = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("kids"))
    r = table(spark, d, "region").join(n, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    detail = F.transform("kids", lambda k: F.struct(k["n_name"].alias("heading"), F.array(F.struct(F.concat(k["n_name"], F.lit(" detail")).alias("heading"))).alias("subsections")))
    outline = F.to_json(F.array(F.struct(F.col("r_name").alias("heading"), detail.alias("subsections"))))
    nodes = r.select("r_name", F.inline(X.outline_nodes(F.from_json(outline, X.OUTLINE_SCHEMA))))
    return nodes.select("r_name", "depth", "heading", F.col("is_leaf").cast("int").alias("is_leaf"))
