"""Queries over sources, sinks, runs, extension points and streams."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from evistrata.common import cut_lineage, fresh_path, ordered
from evistrata.functions.keys import record_key
from evistrata.operators import audit as A
from evistrata.operators import extend, packing, runs
from evistrata.operators import synthesis as S
from evistrata.plans import packing as packing_plans
from evistrata.plans import synthesis as synthesis_plans
from evistrata.plans.audit import AUDIT_SQL, STUDY_CTE, STUDY_ISSUES_SQL, study_issues
from evistrata.plans.bindings import LEDGER_SQL, RECORDS_SQL
from evistrata.plans.registry import query, table
from evistrata.sources import bibliography as B
from evistrata.sources import ledgers as L
from evistrata.streaming import ledger as R


@query("s1_s2_jsonl_ledger", """
select c_custkey as id, c_name as name, c_acctbal as amount from customer union all select c_custkey, c_name, c_acctbal from customer where c_custkey % 2 = 0""")
def s1(spark, d):
    path = fresh_path(spark, "ledger")
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("amount"))
    schema = "id bigint, name string, amount double"
    before = L.read_jsonl(spark, path, schema)
    L.append(rows, path)
    L.append(rows.filter("id % 2 = 0"), path)
    return before.unionByName(L.read_jsonl(spark, path, schema))


@query("s3_published_artifact", "select c_custkey as id, 'v2' as version from customer where c_custkey % 3 = 0")
def s3(spark, d):
    base = fresh_path(spark, "artifact")
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    L.publish(rows.withColumn("version", F.lit("v1")), base, "r1")
    old = L.read_published(spark, base)
    L.publish(old.filter("id % 3 = 0").withColumn("version", F.lit("v2")), base, "r2")
    return L.read_published(spark, base)


@query("s4_s5_csv", r"""
select cast(conv_id as varchar) as record_id, role as decision, regexp_replace(text, '^\s+|\s+$', '', 'g') as note from conversations""")
def s4(spark, d):
    path = fresh_path(spark, "csv")
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.concat(F.lit(" "), "role").alias("status"), F.col("text").alias("why"), "turn")
    L.export_csv(rows, ["id", "status", "why"], path)
    return L.import_csv(spark, path, {"record_id": "id", "decision": "status", "note": "why"}, ["record_id", "decision"])


@query("s6_markdown_rows", r"""
select '| ' || conv_id || ' | ' || role || ' | ' || replace(replace(text || '|', chr(10), '<br>'), '|', '\|') || ' |' as line from conversations""")
def s6(spark, d):
    path = fresh_path(spark, "markdown")
    rows = table(spark, d, "conversations").select("conv_id", "role", F.concat("text", F.lit("|")).alias("text"))
    rows.select(L.markdown_row(["conv_id", "role", "text"]).alias("value")).write.text(path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("s7_ris_entries", """
select doc_id, concat_ws(chr(10), 'TY  - JOUR', 'ID  - ss_' || doc_id, 'T1  - T ' || doc_id, 'TI  - T ' || doc_id, 'AU  - ' || source, 'PY  - ' || (2000 + doc_id % 20), 'DA  - ' || (2000 + doc_id % 20) || '//',
  case when doc_id % 3 = 0 then 'DO  - 10.' || doc_id end, case when doc_id % 3 = 0 then 'UR  - https://doi.org/10.' || doc_id end, 'JO  - ' || lang, 'JF  - ' || lang, case when doc_id % 2 = 0 then 'VL  - 7' end, 'AB  - ' || nullif(text, ''),
  'KW  - rag', 'KW  - screen:A', 'KW  - score:' || (doc_id % 5), 'ER  - ') as entry from documents""")
def s7(spark, d):
    doc = F.col("doc_id")
    n = doc.cast("string")
    doi = F.when(doc % 3 == 0, F.concat(F.lit("10."), n)).when(doc % 3 == 1, F.concat(F.lit("PMID:"), n)).otherwise("")
    tag = F.concat(F.lit("rag; screen:A; ;score:"), (doc % 5).cast("string"))
    nothing = F.lit(None).cast("string")
    entry = B.ris_entry(doc, F.concat(F.lit("T "), n), F.array(F.col("source"), F.lit("")), 2000 + doc % 20, doi, F.col("lang"), F.when(doc % 2 == 0, "7"), nothing, F.col("text"), tag)
    return table(spark, d, "documents").select("doc_id", entry.alias("entry"))


def article_xml():
    doc = F.col("doc_id")
    n = doc.cast("string")
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    own = F.when(doc % 4 != 0, F.concat(F.lit('<ArticleId IdType="doi">10.5/'), n, F.lit("</ArticleId>"))).otherwise("")
    year = F.when(doc % 3 == 0, F.lit("<MedlineDate>1999 Jan-Feb</MedlineDate>")).otherwise(F.concat(F.lit("<Year>"), (2000 + doc % 20).cast("string"), F.lit("</Year>")))
    return F.concat(
        F.lit('<PubmedArticle><MedlineCitation><PMID Version="1">'), n, F.lit("</PMID><Article><Journal><JournalIssue><PubDate>"), year,
        F.lit("</PubDate></JournalIssue><Title>"), "lang", F.lit("</Title></Journal><ArticleTitle>The <i>study</i> "), n,
        F.lit('</ArticleTitle><Abstract><AbstractText Label="OBJECTIVE">To &amp; test '), "source",
        F.lit("</AbstractText><AbstractText>"), escaped, F.lit("</AbstractText></Abstract><AuthorList><Author><LastName>Doe</LastName><ForeName>"), "source",
        F.lit("</ForeName></Author><Author><CollectiveName>Group</CollectiveName></Author></AuthorList></Article></MedlineCitation><PubmedData><ArticleIdList>"), own,
        F.lit('<ArticleId IdType="pubmed">1</ArticleId></ArticleIdList><ReferenceList><Reference><ArticleIdList><ArticleId IdType="doi">10.9/other</ArticleId></ArticleIdList></Reference></ReferenceList></PubmedData></PubmedArticle>'))


ARTICLE_SQL = """
select doc_id, cast(doc_id as varchar) as pmid, 'The study ' || doc_id as title, 'Doe ' || source || ';Group' as authors, case when doc_id % 3 = 0 then 1999 else 2000 + doc_id % 20 end as year, lang as journal,
  case when doc_id % 4 <> 0 then '10.5/' || doc_id end as doi, concat_ws(chr(10), 'OBJECTIVE: To & test ' || source, nullif(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '')) as abstract from documents"""


@query("s8_article_xml", ARTICLE_SQL)
def s8(spark, d):
    out = B.parse_articles(table(spark, d, "documents").select("doc_id", article_xml().alias("xml")), "xml", "doc_id")
    return out.select("doc_id", "pmid", "title", F.array_join("authors.name", ";").alias("authors"), F.col("year").cast("bigint").alias("year"), "journal", "doi", "abstract")


@query("s8_article_files", ARTICLE_SQL)
def s8b(spark, d):
    path = fresh_path(spark, "xml")
    table(spark, d, "documents").select(article_xml().alias("value")).write.text(path)
    out = B.read_articles(spark, path)
    return out.select(F.col("pmid").cast("bigint").alias("doc_id"), "pmid", "title", F.array_join("authors.name", ";").alias("authors"), F.col("year").cast("bigint").alias("year"), "journal", "doi", "abstract")


@query("s9_search_responses", """
select o_custkey, o_orderkey as citations, 't' || o_orderkey as title, case when o_orderkey % 2 = 0 then '10.' || o_orderkey end as doi from orders""")
def s9(spark, d):
    k = F.col("o_orderkey")
    ids = F.when(k % 2 == 0, F.create_map(F.lit("DOI"), F.concat(F.lit("10."), k.cast("string"))))
    item = F.to_json(F.struct(F.concat(F.lit("t"), k.cast("string")).alias("title"), k.alias("citationCount"), ids.alias("externalIds")))
    body = F.concat(F.lit('{"total":1,"data":['), item, F.lit("]}"))
    out = B.response_records(table(spark, d, "orders").select("o_custkey", body.alias("body")), "body", "o_custkey")
    return out.select("o_custkey", F.col("citationCount").alias("citations"), "title", F.col("externalIds.DOI").alias("doi"))


@query("s10_catalog_tables", "select n_name, count(*) as customers from nation join customer on n_nationkey = c_nationkey group by 1")
def s10(spark, d):
    t = L.read_tables(spark, {n: f"{d}/{n}.parquet" for n in ("nation", "customer")})
    return t["customer"].groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers")).join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "customers")


@query("s11_text_folder", "select lang, sum(length(text) + 1)::bigint as chars from documents group by 1")
def s11(spark, d):
    path = fresh_path(spark, "texts")
    table(spark, d, "documents").select("lang", F.col("text").alias("value")).write.partitionBy("lang").text(path)
    files = L.read_texts(spark, path, "*.txt")
    return files.groupBy(F.regexp_extract("path", "lang=([a-z]+)", 1).alias("lang")).agg(F.sum(F.length("text")).alias("chars"))


@query("s12_json_results", "select event_id as id, event_type as kind from events where event_id % 7 <> 0")
def s12(spark, d):
    path = fresh_path(spark, "results")
    good = F.to_json(F.struct(F.col("event_id").alias("id"), F.array(F.struct(F.col("event_type").alias("kind"))).alias("findings")))
    table(spark, d, "events").select(F.when(F.col("event_id") % 7 == 0, F.substring(good, 1, 20)).otherwise(good).alias("value")).write.text(path)
    rows = L.read_results(spark, path, "id bigint, findings array<struct<kind:string>>", whole_files=False)
    return rows.select("id", F.explode("findings.kind").alias("kind"))


@query("s13_fingerprints", "select doc_id as path, case when doc_id % 5 = 0 then 'missing' else sha256(text) end as fingerprint from documents")
def s13(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("path"), "text")
    return L.with_fingerprints(docs.select("path"), docs.filter("path % 5 <> 0").select("path", F.sha2("text", 256).alias("fingerprint")))


@query("s14_s15_upsert_batches", """
with n as (select c_custkey, (row_number() over (order by c_custkey) - 1) // 50 + 1 as batch from customer)
select batch, count(*) as items, string_agg('Customer#' || lpad(cast(c_custkey as varchar), 9, '0') || '/' || case when c_custkey % 2 = 0 then '10.' || c_custkey else '' end || '/' || case when c_custkey % 2 = 1 then 'PMID:' || c_custkey else '' end || '/Doe', ',' order by c_custkey) as listed from n group by 1""")
def s14(spark, d):
    k = F.col("c_custkey")
    n = k.cast("string")
    doi = F.concat(F.when(k % 2 == 0, "10.").otherwise("PMID:"), n)
    item = B.catalog_item(F.col("c_name"), F.array(F.lit("Doe, J"), F.lit("")), F.lit(2020), doi, F.col("c_mktsegment"), F.lit(None).cast("string"), F.array(F.lit("a"), F.lit("")), "COLL")
    b = B.upsert_batches(table(spark, d, "customer").select(k.alias("seq"), item.alias("item")))
    listed = F.array_join(F.transform("payload", lambda p: F.concat_ws("/", p["item"]["title"], p["item"]["DOI"], F.coalesce(p["item"]["extra"], F.lit("")), F.get(p["item"]["creators"], 0)["last"])), ",")
    return b.select("batch", F.size("payload").cast("bigint").alias("items"), listed.alias("listed"))


@query("s16_memo_files", f"""
with {synthesis_plans.SELECT_SQL} select section_id, count(*) as studies, (count(*) + 24) // 25 as memos from sel where reasons = '' group by 1""")
def s16(spark, d):
    path = fresh_path(spark, "memos")
    o = synthesis_plans.written_outcomes(spark, d)
    L.write_memos(S.evidence_memos(synthesis_plans.written_members(spark, d, o), o), path)
    back = spark.read.json(path)
    return back.groupBy("section_id").agg(F.sum(F.size("items")).alias("studies"), F.count(F.lit(1)).alias("memos"))


@query("s17_audit_report", f"""
with {AUDIT_SQL}, {STUDY_CTE}, i as ({STUDY_ISSUES_SQL})
select case when "check" in ('duplicate_study_counting', 'citation_key_resolution_failure', 'citation_to_excluded_study', 'citation_to_unlinked_study') then 'citation_failures' else 'protocol_compliance' end as category,
  '- [' || "check" || '] {{"claim_id":"' || claim_id || '","entity_id":"' || entity_id || '","side":"' || side || '"}}' as line from i
union all select unnest(['unsupported_claims', 'scope_violations', 'invalid_quotes', 'contradiction_omissions']), 'No issues detected.'""")
def s17(spark, d):
    path = fresh_path(spark, "report")
    issues = study_issues(spark, d).withColumn("category", A.category())
    L.write_report(L.report_lines(issues, [*A.CATEGORIES, A.OTHER_CATEGORY]), path)
    return spark.read.text(path).select("category", F.col("value").alias("line"))


# --- runs -----------------------------------------------------------------

@query("a27_config_drift", """
select c_custkey, 'segment' as name, c_mktsegment as old_value, 'X' as new_value, 'changed' as change from customer where c_custkey % 3 = 0 and c_mktsegment <> 'X'
union all select c_custkey, 'note', null, 'n', 'added' from customer where c_custkey % 4 = 0 union all select c_custkey, 'balance', 'b', null, 'removed' from customer where c_custkey % 5 = 0""")
def a27(spark, d):
    k = F.col("c_custkey")
    c = table(spark, d, "customer")
    def entries(*pairs):
        return c.select("c_custkey", F.inline(F.array_compact(F.array(*[F.when(keep, F.struct(F.lit(n).alias("name"), v.alias("value"))) for n, v, keep in pairs]))))
    yes = F.lit(True)
    before = entries(("segment", F.col("c_mktsegment"), yes), ("balance", F.lit("b"), yes))
    after = entries(("segment", F.when(k % 3 == 0, "X").otherwise(F.col("c_mktsegment")), yes), ("balance", F.lit("b"), k % 5 != 0), ("note", F.lit("n"), k % 4 == 0))
    return runs.config_drift(before, after, ["c_custkey"])


RUN_SQL = """
rl as (select 'run' || (user_id % 50) as run_id, 'stage' || (event_id % 4) as stage, case event_type when 'click' then 'completed' when 'error' then 'failed' else 'running' end as status, ts, event_id from events),
rs as (select run_id, stage, arg_max(status, event_id) as status, count(*) as entries from rl group by 1, 2)"""


def run_ledger(spark, d):
    e = table(spark, d, "events")
    kind = F.col("event_type")
    return e.select(F.concat(F.lit("run"), (F.col("user_id") % 50).cast("string")).alias("run_id"), F.concat(F.lit("stage"), (F.col("event_id") % 4).cast("string")).alias("stage"),
                    F.when(kind == "click", "completed").when(kind == "error", "failed").otherwise("running").alias("status"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))


@query("a28_run_status", f"with {RUN_SQL} select run_id, stage, status, entries from rs")
def a28(spark, d):
    return runs.run_status(run_ledger(spark, d)).select("run_id", "stage", "status", "entries")


@query("a28_output_states", f"""
with {RUN_SQL}, o as (select run_id, stage, run_id || '/' || stage as path, substr(run_id, 4)::int as n from rs where status = 'completed')
select path, case when n % 3 = 0 then 'missing' when n % 3 = 1 then 'changed' else path end as current_fingerprint, (n % 3 = 2)::int as unchanged from o""")
def a28b(spark, d):
    stages = runs.run_status(run_ledger(spark, d))
    path = F.concat_ws("/", "run_id", "stage")
    n = F.substring("run_id", 4, 9).cast("int")
    outputs = stages.select("run_id", "stage", path.alias("path"), path.alias("fingerprint"))
    now = stages.filter(n % 3 != 0).select(path.alias("path"), F.when(n % 3 == 1, "changed").otherwise(path).alias("fingerprint"))
    return runs.output_states(stages, outputs, now).select("path", "current_fingerprint", F.col("unchanged").cast("int").alias("unchanged"))


@query("j27_pending_work", "select doc_id from documents where sha256(text) not in (select sha256(text) from documents where doc_id % 3 = 0)")
def j27(spark, d):
    work = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    return runs.pending(work, work.filter("doc_id % 3 = 0"), ["key"]).select("doc_id")


@query("t5_t6_ordered_limit", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def t5(spark, d):
    return ordered(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), "o_orderkey"], 25)


# --- extension points -----------------------------------------------------

def _measure(pack: str, path: str) -> dict:
    """Stand-in extractor: fails on every tenth document."""
    if path.endswith("0"):
        raise ValueError("no reading")
    return {"path": path, "chars": len(pack)}


@query("x3_extractor", """
select doc_id, case when doc_id % 10 = 0 then null else length(text) end as chars, case when doc_id % 10 = 0 then 'ValueError: no reading' end as detail from documents""")
def x3(spark, d):
    packs = table(spark, d, "documents").select("doc_id", F.col("text").alias("pack"), F.col("doc_id").cast("string").alias("path"))
    done, failed = extend.run_extractor(packs, _measure)
    ok = done.select("doc_id", F.get_json_object("payload", "$.chars").cast("bigint").alias("chars"), F.lit(None).cast("string").alias("detail"))
    return ok.unionByName(failed.select("doc_id", F.lit(None).cast("bigint").alias("chars"), "detail"))


def _outline(section: str, items: str) -> dict:
    """Stand-in section writer."""
    studies = [i["study_id"] for i in json.loads(items)]
    return {"section_text": f"{section} has {len(studies)}", "claims": studies[:1]}


@query("x4_section_writer", f"""
with {synthesis_plans.SELECT_SQL}, r as (select section_id, (row_number() over (partition by section_id order by study_id) - 1) // 25 as batch from sel where reasons = '')
select section_id, section_id || ' has ' || count(*) as section_text, 'available' as evidence_status from r group by section_id, batch
union all select section_id, 'Evidence is insufficient for this protocol-required section.', 'insufficient' from (select distinct section_id from sel) where section_id not in (select section_id from r)""")
def x4(spark, d):
    o = synthesis_plans.written_outcomes(spark, d)
    selection = cut_lineage(synthesis_plans.selection(spark, d, o))
    memos = S.evidence_memos(S.section_members(selection), o)
    return extend.write_sections(memos, selection.select("section_id").distinct(), _outline).select("section_id", "section_text", "evidence_status")


@query("x2_quote_validator", """
select doc_id, case when length(text) < 50 or doc_id % 3 = 0 then 'failed' else 'passed' end as status from documents""")
def x2(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, "zzzz qqqq zzzz qqqq").otherwise(F.substring("text", 5, 40)).alias("quote"))
    out = extend.validate_with(rows, lambda quote, text: F.struct(F.when((F.length(text) >= 50) & text.contains(quote), "passed").otherwise("failed").alias("validation_status")))
    return out.select("doc_id", F.col("check.validation_status").alias("status"))


_HITS = " || ".join(f"case when n{i} > 0 then ', {t}' else '' end" for i, t in enumerate(packing_plans.TERMS))


# The pack's length: header, text and separator of each chunk.
@query("x3_pack_to_extractor", f"""
with {packing_plans.PACK_SQL}, piece as (select inc.doc_id, length('[chunk ' || chunk_id || ' | source=' || scored.source || ' | section=' || section || ' | chars=' || scored.a || '-' || b || ' | hits='
    || case when nhits = 0 then 'none' else substr({_HITS}, 3) end || ']' || chr(10)) + sent as n from inc join scored using (doc_id, chunk_id) where sent > 0)
select doc_id, '{{"path": "' || doc_id || '", "chars": ' || coalesce(n, 0) || '}}' as payload from documents left join (select doc_id, sum(n)::bigint + 7 * (count(*) - 1) as n from piece group by 1) using (doc_id) where doc_id % 10 <> 0""")
def x3_pack(spark, d):
    packs = packing.build_evidence_pack(packing_plans.headed(spark, d), packing_plans.TERMS, budget=packing_plans.BUDGET, **packing_plans.SIZES)
    done, _ = extend.run_extractor(packs.select("doc_id", "pack", F.col("doc_id").cast("string").alias("path")), _measure)
    return done


# --- streams --------------------------------------------------------------

def _stream(spark, d, name):
    schema = table(spark, d, name).schema
    return spark.readStream.schema(schema).parquet(f"{d}/{name}*.parquet")


def _run(spark, stream, name, mode="update"):
    base = fresh_path(spark, name)
    R.write_changes(stream, f"{base}/changes", f"{base}/checkpoint", mode).awaitTermination()
    return f"{base}/changes"


def _decision_changes(spark, d):
    events = ledger_columns(_stream(spark, d, "events"))
    return _run(spark, R.latest_decision_stream(events), "decisions")


def ledger_columns(events):
    """The ledger binding on a stream of events."""
    e, kind = F.col("event_id"), F.col("event_type")
    decision = (F.when(kind == "click", "include").when(kind == "view", "exclude").when(kind == "purchase", "uncertain").when(kind == "signup", "include")
                .when(e % 3 == 0, "maybe").otherwise("duplicate"))
    return events.select(e.alias("seq"), F.concat(F.when(F.col("user_id") % 25 == 9, "x").otherwise("c"), F.col("user_id").cast("string")).alias("record_id"),
                         F.when(e % 2 == 0, "title_abstract").otherwise("fulltext").alias("stage"), decision.alias("decision"))


@query("r1_streaming_decisions", f"with {LEDGER_SQL} select record_id, stage, decision, seq from latest")
def r1(spark, d):
    return R.current_decisions(spark, _decision_changes(spark, d)).select("record_id", "stage", "decision", "seq")


@query("r2_streaming_prisma", f"""
with {LEDGER_SQL} select stage, count(*) as total, count(*) filter (where decision = 'duplicate') as duplicate, count(*) filter (where decision = 'exclude') as exclude,
  count(*) filter (where decision = 'include') as include, count(*) filter (where decision = 'uncertain') as uncertain from latest group by stage""")
def r2(spark, d):
    return R.current_prisma(spark, _decision_changes(spark, d))


def _resumed_decisions(spark, d, parts=3):
    """The ledger in three deliveries, each holding early and late rows; the stream is started anew for each.

    Returns the change folders, the snapshots (made after every second batch) and the checkpoint.
    """
    base = fresh_path(spark, "resumed")
    events = table(spark, d, "events")
    dealt = events.withColumn("_part", F.pmod(F.xxhash64("event_id"), F.lit(parts)))
    for part in range(parts):
        dealt.filter(F.col("_part") == part).drop("_part").write.mode("append").parquet(f"{base}/in")
        stream = ledger_columns(spark.readStream.schema(events.schema).parquet(f"{base}/in"))
        R.write_changes(R.latest_decision_stream(stream), f"{base}/changes", f"{base}/checkpoint", snapshots=f"{base}/state", every=2).awaitTermination()
    return f"{base}/changes", f"{base}/state"


@query("r1_resumed_decisions", f"with {LEDGER_SQL} select record_id, stage, decision, seq from latest")
def r1_resumed(spark, d):
    return R.current_decisions(spark, *_resumed_decisions(spark, d)).select("record_id", "stage", "decision", "seq")


@query("r2_resumed_prisma", f"""
with {LEDGER_SQL} select stage, count(*) as total, count(*) filter (where decision = 'duplicate') as duplicate, count(*) filter (where decision = 'exclude') as exclude,
  count(*) filter (where decision = 'include') as include, count(*) filter (where decision = 'uncertain') as uncertain from latest group by stage""")
def r2_resumed(spark, d):
    return R.current_prisma(spark, *_resumed_decisions(spark, d))


HORIZON_DAYS = 2


# Deliveries come in time order, so every key is met in time. Which of its rows stay depends on the batches,
# but kept rows of a key are always more than the horizon apart.
@query("r3_horizon_dedup", "select distinct user_id, event_type, true as apart from events")
def r3_horizon(spark, d, parts=4):
    base = fresh_path(spark, "horizon")
    events = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    seconds = F.col("ts").cast("double")
    low, width = events.agg(F.min(seconds)).scalar(), events.agg((F.max(seconds) - F.min(seconds)) / parts).scalar()
    dealt = events.withColumn("_part", F.coalesce(F.least(F.floor((seconds - low) / width), F.lit(parts - 1)), F.lit(0)))
    for part in range(parts):
        dealt.filter(F.col("_part") == part).drop("_part").write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{base}/in")
        kept = R.distinct_records(stream, ["user_id", "event_type"], "ts", f"{HORIZON_DAYS} days")
        R.write_changes(kept, f"{base}/changes", f"{base}/checkpoint", "append").awaitTermination()
    kept = spark.read.schema(events.schema).parquet(f"{base}/changes")
    gap = seconds - F.lag(seconds).over(Window.partitionBy("user_id", "event_type").orderBy("ts"))
    apart = kept.withColumn("_apart", F.coalesce(gap > HORIZON_DAYS * 86_400, F.lit(True)))
    return apart.groupBy("user_id", "event_type").agg(F.bool_and("_apart").alias("apart"))


@query("r3_streaming_dedup", f"with {RECORDS_SQL} select distinct record_key from keyed where record_key not like 'raw:%'")
def r3(spark, d):
    doc = F.col("doc_id")
    doi = F.when(doc % 5 < 2, F.concat(F.lit("10."), (doc % 97).cast("string"), F.lit("/x")))
    key = record_key(doi, F.substring_index("text", "\n", 1), doc.cast("string"))
    stream = R.distinct_records(_stream(spark, d, "documents").select(key.alias("record_key")))
    return spark.read.parquet(_run(spark, stream, "dedup", "append")).select("record_key").filter("record_key not like 'raw:%'")


@query("r4_streaming_work_list", "select doc_id from documents where sha256(text) not in (select sha256(text) from documents where doc_id % 3 = 0)")
def r4(spark, d):
    done = table(spark, d, "documents").filter("doc_id % 3 = 0").select(F.sha2("text", 256).alias("key"))
    stream = R.pending_stream(_stream(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("key")), done, ["key"])
    return spark.read.parquet(_run(spark, stream, "work", "append")).select("doc_id")
