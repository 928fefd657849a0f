"""Entity views over the given tables, and the same views as SQL for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evistrata.functions.keys import norm_doi
from evistrata.plans.registry import table


def records(spark: SparkSession, d: str) -> DataFrame:
    """Search records: documents titled by their first line, found by two searches in three runs."""
    doc = F.col("doc_id")
    bucket = (doc % 97).cast("string")
    return table(spark, d, "documents").select(
        doc.alias("seq"),
        F.concat(F.lit("raw_"), doc.cast("string")).alias("raw_record_id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.when(doc % 5 == 0, F.concat(F.lit("https://DOI.org/10."), bucket, F.lit("/X "))).alias("doi_field"),
        F.when(doc % 5 == 1, F.concat(F.lit("10."), bucket, F.lit("/x"))).alias("external_doi"),
        F.when(doc % 7 == 0, F.concat(F.lit("PM"), (doc % 50).cast("string"))).alias("pmid"),
        F.when(doc % 4 != 0, F.col("lang")).otherwise("").alias("lang"),
        F.when(doc % 3 != 0, F.col("n_chars")).otherwise(0).alias("n_chars"),
        "source",
        F.concat(F.lit("s"), (doc % 2).cast("string")).alias("search_id"),
        F.concat(F.lit("run"), (doc % 3).cast("string")).alias("run_id"),
    ).withColumn("doi", norm_doi("doi_field", "external_doi")).drop("doi_field", "external_doi")


RECORDS_SQL = """
raw_rec as (
  select doc_id as seq, 'raw_' || doc_id as raw_record_id, split_part(text, chr(10), 1) as title,
         case when doc_id % 7 = 0 then 'PM' || (doc_id % 50) end as pmid,
         case when doc_id % 4 <> 0 then lang else '' end as lang,
         case when doc_id % 3 <> 0 then n_chars else 0 end as n_chars,
         source, 's' || (doc_id % 2) as search_id, 'run' || (doc_id % 3) as run_id,
         case when doc_id % 5 in (0, 1) then '10.' || (doc_id % 97) || '/x' end as doi
  from documents),
tit as (select *, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) as title_key from raw_rec),
rec as (
  select *, case when doi is not null then 'doi:' || doi when title_key <> '' then 'title:' || title_key
                 else 'raw:' || raw_record_id end as record_key from tit),
keyed as (
  select *, 'record_' || substr(sha256(to_json([lower(trim(record_key))])::varchar), 1, 16) as record_id from rec)
"""


# --- catalog: region > nation > customer as collections, orders as items -----

def catalog(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    r = table(spark, d, "region").select((F.col("r_regionkey") + 1).cast("bigint").alias("collection_id"), F.col("r_name").alias("name"), F.lit(None).cast("bigint").alias("parent_id"))
    n = table(spark, d, "nation").select((F.col("n_nationkey") + 100).cast("bigint").alias("collection_id"), F.col("n_name").alias("name"), (F.col("n_regionkey") + 1).cast("bigint").alias("parent_id"))
    c = table(spark, d, "customer").select((F.col("c_custkey") + 1000).alias("collection_id"), F.col("c_name").alias("name"), (F.col("c_nationkey") + 100).cast("bigint").alias("parent_id"))
    o = table(spark, d, "orders")
    key = F.col("o_orderkey")
    kind = key % 4
    name = F.concat(key.cast("string"), F.lit(".pdf"))
    path = (
        F.when(kind == 0, F.concat(F.lit("storage:"), name)).when(kind == 1, F.concat(F.lit("attachments:sub\\"), name))
        .when(kind == 2, F.concat(F.lit("C:\\Papers\\"), name)).otherwise(F.concat(F.lit("/abs/"), name))
    )
    attachments = o.filter("o_orderstatus = 'F'").select(
        (key + 100_000_000_000).alias("item_id"), key.alias("parent_id"), F.concat(F.lit("K"), key.cast("string")).alias("key"),
        path.alias("path"), F.when(key % 10 == 3, "text/html").otherwise("application/pdf").alias("content_type"), key.alias("seq"))
    full = (
        F.when(kind == 0, F.concat(F.lit("/lib/storage/K"), key.cast("string"), F.lit("/"), name))
        .when(kind == 1, F.concat(F.lit("/linked/sub/"), name)).when(kind == 2, F.concat(F.lit("/mnt/papers/"), name))
        .otherwise(F.concat(F.lit("/abs/"), name))
    )
    return {
        "collections": r.unionByName(n).unionByName(c),
        "collection_items": o.select((F.col("o_custkey") + 1000).alias("collection_id"), key.alias("item_id")),
        "attachments": attachments,
        "notes": o.select(key.alias("item_id"), F.when(key % 50 == 7, key - 1).alias("parent_id")),
        "files": o.filter("o_totalprice > 100000").select(full.alias("path")),
    }


CATALOG_SQL = """
coll as (
  select r_regionkey + 1 as collection_id, r_name as name, null::bigint as parent_id from region
  union all select n_nationkey + 100, n_name, n_regionkey + 1 from nation
  union all select c_custkey + 1000, c_name, c_nationkey + 100 from customer),
paths as (
  select c.collection_id, c.name as path, 1 as depth from coll c where parent_id is null
  union all select n.collection_id, r.name || ' > ' || n.name, 2 from coll n join coll r on n.parent_id = r.collection_id where r.parent_id is null
  union all select c.collection_id, r.name || ' > ' || n.name || ' > ' || c.name, 3 from coll c join coll n on c.parent_id = n.collection_id
    join coll r on n.parent_id = r.collection_id),
members as (select o_custkey + 1000 as collection_id, o_orderkey as item_id from orders where o_orderkey % 50 <> 7),
resolved as (select o_orderkey as item_id, case o_orderkey % 4 when 0 then '/lib/storage/K' || o_orderkey || '/' when 1 then '/linked/sub/'
    when 2 then '/mnt/papers/' else '/abs/' end || o_orderkey || '.pdf' as pdf_path
  from orders where o_orderstatus = 'F' and o_totalprice > 100000),
with_pdf as (select * from resolved where item_id % 10 <> 3)
"""


# --- screening ledger: events as decisions on customers ----------------------

def ledger(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    kind = F.col("event_type")
    decision = (
        F.when(kind == "click", "include").when(kind == "view", "exclude").when(kind == "purchase", "uncertain")
        .when(kind == "signup", "include").when(e % 3 == 0, "maybe").otherwise("duplicate")
    )
    return table(spark, d, "events").select(
        e.alias("seq"),
        F.concat(F.when(F.col("user_id") % 25 == 9, "x").otherwise("c"), F.col("user_id").cast("string")).alias("record_id"),
        F.when(e % 2 == 0, "title_abstract").otherwise("fulltext").alias("stage"), decision.alias("decision"),
        F.when(e % 4 != 0, "wrong_outcome").when(e % 8 == 0, "odd_reason").alias("reason_code"),
        F.when(e % 9 == 0, "perhaps").when(e % 9 == 1, "include").alias("ai_recommendation"), F.col("ts").alias("timestamp"))


def universe(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("record_id"))


LEDGER_SQL = """
ledger as (
  select event_id as seq, case when user_id % 25 = 9 then 'x' else 'c' end || user_id as record_id,
    case when event_id % 2 = 0 then 'title_abstract' else 'fulltext' end as stage,
    case event_type when 'click' then 'include' when 'view' then 'exclude' when 'purchase' then 'uncertain' when 'signup' then 'include'
      else case when event_id % 3 = 0 then 'maybe' else 'duplicate' end end as decision,
    case when event_id % 4 <> 0 then 'wrong_outcome' when event_id % 8 = 0 then 'odd_reason' end as reason_code,
    case event_id % 9 when 0 then 'perhaps' when 1 then 'include' end as ai from events),
latest as (select record_id, stage, arg_max(decision, seq) as decision, max(seq) as seq from ledger group by 1, 2),
universe as (select 'c' || c_custkey as record_id from customer),
wide as (
  select coalesce(u.record_id, l.record_id) as record_id, u.record_id is not null as known, l.t, l.f
  from universe u full join (select record_id, max(decision) filter (where stage = 'title_abstract') as t,
    max(decision) filter (where stage = 'fulltext') as f from latest group by 1) l on u.record_id = l.record_id),
states as (
  select *, known and coalesce(t = 'include', false) as inc,
    case when not known then null when t is null then 'missing' when t in ('include', 'exclude', 'duplicate') then 'complete'
      when t = 'uncertain' then 'uncertain' else 'illegal' end as title_state,
    case when not (known and coalesce(t = 'include', false)) then null when f is null then 'missing'
      when f in ('include', 'exclude', 'duplicate') then 'complete' when f = 'uncertain' then 'uncertain' else 'illegal' end as fulltext_state,
    (not known) or coalesce(t = 'maybe', false) or coalesce(f = 'maybe', false) or (known and f is not null and coalesce(t, '') <> 'include') as illegal
  from wide)
"""


# --- extraction: orders as studies, customers as publications and records ----

def links(spark: SparkSession, d: str) -> DataFrame:
    """Two link generations per study; every seventh study has none, every eleventh an empty one."""
    o = table(spark, d, "orders").filter("o_orderkey % 7 <> 0")
    key = F.col("o_orderkey")

    def generation(number: int, record, status):
        return o.select(
            F.concat(F.lit("s"), key.cast("string")).alias("study_id"), record.alias("record_id"), status.alias("status"),
            (key * 2 + number).alias("seq"), F.when(key % 13 == 0, "old").otherwise("new").alias("protocol_hash"))

    first = F.concat(F.lit("c"), ((F.col("o_custkey") + 1) % 150).cast("string"))
    second = F.when(key % 11 == 0, "").otherwise(F.concat(F.lit("c"), (F.col("o_custkey") % 150).cast("string")))
    return generation(0, first, F.lit("active")).unionByName(
        generation(1, second, F.when(F.col("o_orderstatus") == "P", "superseded").otherwise("active")))


def studies(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("study_id"),
        F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("publication_id"), F.col("o_orderkey").alias("seq"))


STUDIES_SQL = """
study as (select 's' || o_orderkey as study_id, 'p' || o_custkey as publication_id, o_orderkey as seq from orders),
link as (select 's' || o_orderkey as study_id, case when o_orderstatus = 'P' then 'c' || ((o_custkey + 1) % 150)
    when o_orderkey % 11 = 0 then null else 'c' || (o_custkey % 150) end as record_id,
    case when o_orderkey % 13 = 0 then 'old' else 'new' end as protocol_hash
  from orders where o_orderkey % 7 <> 0)
"""


def outcomes(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """One outcome per order and line; each has an evidence location, some two or none.

    ``more`` names columns of the aggregated line items to keep: pk, sk, rf or ls.
    """
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"]
    li = table(spark, d, "lineitem").select(columns).groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_partkey").alias("pk"), F.min("l_suppkey").alias("sk"), F.min("l_returnflag").alias("rf"), F.min("l_linestatus").alias("ls"))
    pk, sk = F.col("pk"), F.col("sk")
    order, line = F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")
    relation = F.when(F.col("rf") == "A", "supports").when(F.col("rf") == "R", "contradicts").when(sk % 3 == 0, "neutral").when(sk % 3 == 1, "mixed").otherwise("unclear")
    direction = F.element_at(F.array(*[F.lit(x) for x in ("increase", "decrease", "no_change", "mixed", "unclear")]), (pk % 5 + 1).cast("int"))
    status = F.when(sk % 7 == 0, "failed").when(sk % 7 == 1, "unverified").otherwise("passed")

    def location(page: str):
        return F.struct(F.concat(F.lit("quote "), order, F.lit("-"), line).alias("quote"), F.lit(page).alias("page"), status.alias("validation_status"))

    evidence = F.when(pk % 9 == 0, F.array().cast("array<struct<quote:string,page:string,validation_status:string>>")).when(
        pk % 9 == 1, F.array(location("1"), location("2"))).otherwise(F.array(location("1")))
    return li.select(
        F.concat(F.lit("o"), order, F.lit("-"), line).alias("outcome_id"), F.concat(F.lit("s"), order).alias("study_id"),
        F.concat(F.lit("d"), (pk % 6).cast("string")).alias("domain"), direction.alias("effect_direction"), relation.alias("support_relation"),
        F.when(sk % 4 == 0, "").otherwise(F.concat(F.lit("t"), (sk % 4).cast("string"))).alias("timepoint"), F.col("ls").alias("design"),
        F.concat(F.lit("m"), (pk % 50 / 25).cast("int").cast("string")).alias("dose"), evidence.alias("evidence"), F.col("l_orderkey").alias("seq"), *more)


OUTCOMES_SQL = """
lo as (select l_orderkey, l_linenumber, min(l_partkey) as pk, min(l_suppkey) as sk, min(l_returnflag) as rf, min(l_linestatus) as ls from lineitem group by 1, 2),
outc as (select 'o' || l_orderkey || '-' || l_linenumber as outcome_id, 's' || l_orderkey as study_id, l_orderkey, l_linenumber, pk, sk, 'd' || (pk % 6) as domain,
  case pk % 5 when 0 then 'increase' when 1 then 'decrease' when 2 then 'no_change' when 3 then 'mixed' else 'unclear' end as effect_direction,
  case rf when 'A' then 'supports' when 'R' then 'contradicts' else case sk % 3 when 0 then 'neutral' when 1 then 'mixed' else 'unclear' end end as support_relation,
  case when sk % 4 = 0 then 'not_reported' else 't' || (sk % 4) end as timepoint, ls as design, 'm' || (pk % 50 // 25) as dose,
  case sk % 7 when 0 then 'failed' when 1 then 'unverified' else 'passed' end as validation_status, case pk % 9 when 0 then 0 when 1 then 2 else 1 end as n_evidence from lo)
"""


def described_studies(spark: SparkSession, d: str) -> DataFrame:
    """Studies with declared fields."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    k, c = F.col("o_orderkey"), F.col("o_custkey")

    def pick(index, *values: str):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))

    fields = F.create_map(
        F.lit("population.scope"), F.concat(F.lit("P"), F.substring("o_orderpriority", 1, 1)), F.lit("design"), F.col("o_orderstatus"),
        F.lit("intervention.scope"), pick(k % 9, "outside", "adjacent", "inside", "core", "", "", "", "", ""),
        F.lit("intervention.summary"), pick(k % 4, "x", "y", "z", ""), F.lit("population.evidence_level"), pick(c % 4, "low", "mid", "high", ""),
        F.lit("study.causal_strength"), pick(k % 3, "descriptive", "associational", "causal"), F.lit("dose"), F.when(k % 4 == 0, "not_reported").otherwise("5"))
    return o.select(
        F.concat(F.lit("s"), k.cast("string")).alias("study_id"), F.concat(F.lit("p"), c.cast("string")).alias("publication_id"), fields.alias("fields"), k.alias("seq"))


def evidence(spark: SparkSession, d: str, from_outcomes: DataFrame | None = None) -> DataFrame:
    """Current evidence locations, named by outcome and position."""
    source = outcomes(spark, d) if from_outcomes is None else from_outcomes
    rows = source.select("outcome_id", "study_id", F.posexplode_outer("evidence").alias("i", "e")).filter("e is not null")
    name = F.concat(F.lit("e"), "outcome_id", F.lit("-"), F.col("i").cast("string"))
    return rows.select(name.alias("evidence_id"), "study_id", "outcome_id", F.col("e.validation_status").alias("validation_status"))


def claims(spark: SparkSession, d: str) -> DataFrame:
    """One claim per order, with the faults an audit looks for at regular intervals."""
    o = table(spark, d, "orders").select("o_orderkey")
    k = F.col("o_orderkey")

    def name(prefix: str, key, suffix: str = ""):
        return F.concat(F.lit(prefix), key.cast("string"), F.lit(suffix))

    def some(*pairs):
        return F.array_compact(F.array(*[F.when(cond, value) for cond, value in pairs]))

    yes = F.lit(True)
    return o.select(
        name("k", k).alias("claim_id"), name("S0", k % 4 + 1).alias("section_id"), name("Order ", k, " was Shipped late.").alias("sentence"),
        some((k % 50 != 1, name("s", k)), (k % 3 == 0, name("s", k + 1)), (k % 40 == 0, name("s", k)), (k % 50 == 2, name("sX", k))).alias("supporting_studies"),
        some((k % 6 == 0, name("s", k + 2))).alias("contradicting_studies"),
        some((k % 10 != 9, name("o", k, "-1")), (k % 5 == 0, name("old", k)), (k % 23 == 0, name("nowhere", k))).alias("supporting_outcomes"),
        some((k % 6 == 0, name("o", k + 2, "-2"))).alias("contradicting_outcomes"),
        some((k % 8 != 0, name("eo", k, "-1-0")), (k % 7 == 0, name("eo", k + 1, "-1-0")), (k % 9 == 0, name("stale", k)), (k % 11 == 0, name("ghost", k))).alias("supporting_evidence_refs"),
        some((k % 12 == 0, name("eo", k + 2, "-2-0"))).alias("contradicting_evidence_refs"),
        F.when(k % 31 == 0, "unsupported").otherwise("supported").alias("support_level"),
        F.when(k % 17 == 0, "outside").otherwise("unclear").alias("scope_status"),
        some((k % 2 == 0, F.lit("high")), (k % 5 == 0, F.lit("mid"))).alias("claimed_levels"),
        F.when(k % 2 == 1, "causal").otherwise("descriptive").alias("causal_strength"),
        some((yes, F.lit("dose")), (k % 3 == 1, F.lit("absent"))).alias("asserted_fields"),
        some((yes, F.lit("shipped")), (k % 13 == 0, F.lit("never"))).alias("required_qualifiers"),
        F.when(k % 19 == 0, "because").otherwise("").alias("relation_explanation"), k.alias("seq"))


SYNTHESIS_SQL = """
st as (select 's' || o_orderkey as study_id, 'p' || o_custkey as publication_id, o_orderkey as k, 'P' || left(o_orderpriority, 1) as pop, o_orderstatus as design,
  case o_orderkey % 9 when 0 then 'outside' when 1 then 'adjacent' when 2 then 'inside' when 3 then 'core' else '' end as scope,
  case o_orderkey % 4 when 0 then 'x' when 1 then 'y' when 2 then 'z' else '' end as summary, case o_custkey % 4 when 0 then 'low' when 1 then 'mid' when 2 then 'high' else '' end as lvl,
  case o_orderkey % 3 when 0 then 'descriptive' when 1 then 'associational' else 'causal' end as strength, case when o_orderkey % 4 = 0 then 'not_reported' else '5' end as dose from orders),
evi as (select 'e' || outcome_id || '-' || i as evidence_id, study_id, outcome_id, validation_status from (select *, unnest(generate_series(0, n_evidence - 1)) as i from outc where n_evidence > 0)),
cl as (select o_orderkey as k, 'k' || o_orderkey as claim_id, 'S0' || (o_orderkey % 4 + 1) as section_id from orders),
cs as (select claim_id, section_id, k, 'supporting' as side, unnest([case when k % 50 <> 1 then 's' || k end, case when k % 3 = 0 then 's' || (k + 1) end, case when k % 40 = 0 then 's' || k end, case when k % 50 = 2 then 'sX' || k end]) as study_id from cl
  union all select claim_id, section_id, k, 'contradicting', case when k % 6 = 0 then 's' || (k + 2) end from cl),
cst as (select * from cs where study_id is not null),
co as (select claim_id, section_id, k, 'supporting' as side, unnest([case when k % 10 <> 9 then 'o' || k || '-1' end, case when k % 5 = 0 then 'old' || k end, case when k % 23 = 0 then 'nowhere' || k end]) as outcome_id from cl
  union all select claim_id, section_id, k, 'contradicting', case when k % 6 = 0 then 'o' || (k + 2) || '-2' end from cl),
cot as (select * from co where outcome_id is not null),
ce as (select claim_id, section_id, k, 'supporting' as side, unnest([case when k % 8 <> 0 then 'eo' || k || '-1-0' end, case when k % 7 = 0 then 'eo' || (k + 1) || '-1-0' end, case when k % 9 = 0 then 'stale' || k end, case when k % 11 = 0 then 'ghost' || k end]) as evidence_id from cl
  union all select claim_id, section_id, k, 'contradicting', case when k % 12 = 0 then 'eo' || (k + 2) || '-2-0' end from cl),
cet as (select * from ce where evidence_id is not null)
"""
