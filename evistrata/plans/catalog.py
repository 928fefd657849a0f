"""Queries over the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from evistrata.functions import text as X
from evistrata.operators import catalog as ops
from evistrata.plans.bindings import CATALOG_SQL, catalog
from evistrata.plans.registry import query, table


def resolved(c):
    candidates = ops.attachment_candidates(c["attachments"], "/lib", "/linked", [("D:\\", "/other/"), ("c:/papers/", "/mnt/papers/")])
    return ops.resolve_attachments(candidates, c["files"])


def pdfs(c):
    return ops.item_attachment(c["attachments"], resolved(c))


def members(c):
    return ops.parent_items(c["collection_items"], c["attachments"], c["notes"])


@query("j5_collection_paths", f"with {CATALOG_SQL} select collection_id, path, depth from paths")
def j5(spark, d):
    return ops.collection_paths(catalog(spark, d)["collections"])


@query("j5_find_collection", f"with {CATALOG_SQL} select collection_id, path from paths where path = 'ASIA' or path like '% > NATION_2'")
def j5b(spark, d):
    paths = ops.collection_paths(catalog(spark, d)["collections"])
    return ops.find_collections(paths, "ASIA").unionByName(ops.find_collections(paths, "NATION_2")).select("collection_id", "path")


@query("j4_parent_items", f"with {CATALOG_SQL} select collection_id, item_id from members")
def j4(spark, d):
    return members(catalog(spark, d)).select("collection_id", "item_id")


@query("p14_resolve_attachments", f"with {CATALOG_SQL} select item_id as parent_id, pdf_path as full_path from resolved")
def p14(spark, d):
    return resolved(catalog(spark, d)).select("parent_id", "full_path")


@query("j3_item_attachment", f"with {CATALOG_SQL} select item_id, pdf_path from with_pdf")
def j3(spark, d):
    return pdfs(catalog(spark, d)).select("item_id", "pdf_path")


@query("a1_collection_coverage", f"""
with {CATALOG_SQL}
select m.collection_id, p.path as name, count(*) as total, count(w.item_id) as has_attachment, count(*) - count(w.item_id) as missing
from members m join paths p using (collection_id) left join with_pdf w on w.item_id = m.item_id group by 1, 2""")
def a1(spark, d):
    c = catalog(spark, d)
    return ops.collection_coverage(ops.collection_paths(c["collections"]), members(c), pdfs(c))


def item_data(spark, d):
    c = table(spark, d, "customer")
    fields = [("title", F.concat(F.lit("<i>"), "c_name", F.lit("</i> ")), F.lit(True)), ("date", F.col("c_acctbal").cast("bigint").cast("string"), F.col("c_custkey") % 3 != 0),
              ("publicationTitle", F.col("c_mktsegment"), F.lit(True)), ("DOI", F.concat(F.lit("10."), F.col("c_custkey").cast("string")), F.col("c_custkey") % 2 == 0),
              ("extra", F.lit("x"), F.lit(True))]
    rows = F.array(*[F.when(keep, F.struct(F.lit(n).alias("field"), v.alias("value"))) for n, v, keep in fields])
    return c.select(F.col("c_custkey").alias("item_id"), F.inline(F.array_compact(rows)))


@query("j1_item_fields", """
select c_custkey as item_id, '<i>' || c_name || '</i> ' as title, case when c_custkey % 3 <> 0 then cast(cast(trunc(c_acctbal) as bigint) as varchar) end as date,
  c_mktsegment as "publicationTitle", case when c_custkey % 2 = 0 then '10.' || c_custkey end as "DOI" from customer""")
def j1(spark, d):
    return ops.item_fields(item_data(spark, d))


def creators(spark, d):
    s = table(spark, d, "supplier")
    first = F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("F"), F.col("s_suppkey").cast("string")))
    return s.select(F.col("s_nationkey").cast("bigint").alias("item_id"), (-F.col("s_suppkey")).cast("int").alias("order_index"), F.col("s_name").alias("last"), first.alias("first"))


@query("j2_a26_item_authors", """
select s_nationkey::bigint as item_id, string_agg(s_name || case when s_suppkey % 3 <> 0 then ', F' || s_suppkey else '' end, '; ' order by s_suppkey desc) as authors
from supplier group by 1""")
def j2(spark, d):
    return ops.item_authors(creators(spark, d))


PAPERS_SQL = """
authors as (select s_nationkey::bigint as item_id, string_agg(s_name || case when s_suppkey % 3 <> 0 then ', F' || s_suppkey else '' end, '; ' order by s_suppkey desc) as authors
  from supplier group by 1),
papers as (select c_custkey as item_id, c_name as title, coalesce(a.authors, '') as authors, c_mktsegment as journal,
  case when c_custkey % 3 <> 0 then cast(cast(trunc(c_acctbal) as bigint) as varchar) else '' end as date,
  case when c_custkey % 2 = 0 then '10.' || c_custkey else '' end as doi, coalesce(w.pdf_path, '') as pdf_path
  from customer c left join authors a on a.item_id = c.c_custkey left join with_pdf w on w.item_id = c.c_custkey)"""


def papers(spark, d):
    items = table(spark, d, "customer").select(F.col("c_custkey").alias("item_id"))
    return ops.catalog_papers(items, ops.item_fields(item_data(spark, d)), ops.item_authors(creators(spark, d)), pdfs(catalog(spark, d)))


@query("p54_papers_with_full_text", f"""
with {CATALOG_SQL}, {PAPERS_SQL} select item_id, title, authors, journal, date, doi, pdf_path from papers where pdf_path <> ''""")
def p54(spark, d):
    return ops.with_full_text(papers(spark, d)).drop("pdf_available")


@query("a30_listing_summary", f"""
with {CATALOG_SQL}, {PAPERS_SQL} select journal, count(*) as total, count(*) filter (where pdf_path <> '') as with_full_text from papers group by 1""")
def a30(spark, d):
    return ops.listing_summary(papers(spark, d), ["journal"])


@query("j29_missing_path_segments", f"""
with {CATALOG_SQL},
t as (select r_name as a, n_name as b, c_name || case when c_custkey % 4 = 0 then 'x' else '' end as c, 'Notes' as e
  from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)
select distinct depth, path from (select 3 as depth, a || ' > ' || b || ' > ' || c as path from t union all select 4, a || ' > ' || b || ' > ' || c || ' > ' || e from t)
where path not in (select path from paths)""")
def j29(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    t = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    mark = F.when(F.col("c_custkey") % 4 == 0, "x").otherwise("")
    targets = t.select(F.concat("r_name", F.lit(">"), "n_name", F.lit(" > > "), "c_name", mark, F.lit(">Notes ")).alias("target"))
    return ops.missing_path_segments(targets, ops.collection_paths(catalog(spark, d)["collections"])).select("depth", "path")


@query("j6_catalog_doi_index", "select distinct '10.' || c_custkey as doi from customer where c_custkey % 2 = 0")
def doi_index(spark, d):
    return ops.doi_index(item_data(spark, d))


@query("p13_strip_html", r"""
select page_id, md5(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '^[\s\pZ]+|[\s\pZ]+$', '', 'g')) as plain from pages""")
def p13(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(X.strip_html("html")).alias("plain"))
