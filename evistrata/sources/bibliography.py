"""Bibliographic formats: citation export, article XML, search responses, catalog items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evistrata.common import as_col, batch_number, blank_to_null, number_rows
from evistrata.functions.text import author_name, strip_html

ARTICLE_SCHEMA = """
MedlineCitation struct<PMID:string, Article:struct<ArticleTitle:string,
  AuthorList:struct<Author:array<struct<LastName:string, ForeName:string, CollectiveName:string>>>,
  Journal:struct<Title:string, ISOAbbreviation:string, JournalIssue:struct<PubDate:struct<Year:string, MedlineDate:string>>>,
  Abstract:struct<AbstractText:array<struct<_Label:string, _VALUE:string>>>>>,
PubmedData struct<ArticleIdList:struct<ArticleId:array<struct<_IdType:string, _VALUE:string>>>>
"""
RESPONSE_SCHEMA = """
data array<struct<title:string, abstract:string, year:int, citationCount:bigint, authors:array<struct<name:string>>,
  externalIds:map<string,string>, journal:struct<name:string, volume:string, pages:string>>>
"""
INLINE_MARKUP = r"</?(?:i|b|u|em|strong|sup|sub)(?:\s[^>]*)?>"


def _article_columns(citation: Column, ids: Column) -> list[Column]:
    article = citation["Article"]
    authors = F.transform(F.coalesce(article["AuthorList"]["Author"], F.array()), lambda a: F.coalesce(
        F.when(a["LastName"].isNotNull() & a["ForeName"].isNotNull(), F.concat(a["LastName"], F.lit(" "), a["ForeName"])), a["CollectiveName"], a["LastName"]))
    named = F.transform(F.filter(authors, lambda a: a.isNotNull()), lambda a: F.struct(a.alias("name")))
    date = article["Journal"]["JournalIssue"]["PubDate"]
    year = F.coalesce(blank_to_null(date["Year"]), F.element_at(F.split(date["MedlineDate"], " "), 1)).try_cast("int")

    def own_id(kind: str) -> Column:
        return F.try_element_at(F.transform(F.filter(F.coalesce(ids, F.array()), lambda i: i["_IdType"] == kind), lambda i: i["_VALUE"]), F.lit(-1))

    parts = F.transform(F.coalesce(article["Abstract"]["AbstractText"], F.array()), lambda p: F.concat(
        F.coalesce(F.concat(blank_to_null(p["_Label"]), F.lit(": ")), F.lit("")), strip_html(p["_VALUE"])))
    return [
        citation["PMID"].alias("pmid"), strip_html(article["ArticleTitle"]).alias("title"), named.alias("authors"), year.alias("year"),
        F.coalesce(blank_to_null(article["Journal"]["Title"]), article["Journal"]["ISOAbbreviation"], F.lit("Unknown Journal")).alias("journal"),
        own_id("doi").alias("doi"), own_id("pmc").alias("pmc"), F.array_join(parts, "\n").alias("abstract"),
    ]


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Records of article XML files.

    Files are split at the end tag of an article, so one large file is read by
    many tasks; each piece then goes through :func:`parse_articles`.
    """
    pieces = spark.read.text(path, lineSep="</PubmedArticle>")
    start = F.regexp_extract("value", r"(?s)<PubmedArticle(?:\s[^>]*)?>.*", 0)
    whole = pieces.select(start.alias("_start")).filter("_start <> ''").select(F.concat("_start", F.lit("</PubmedArticle>")).alias("xml"))
    return parse_articles(whole, "xml")


def parse_articles(df: DataFrame, xml: str | Column, *keep: str) -> DataFrame:
    """Records of single article elements held in a column.

    Only the article's own id list counts, never the ids of its references.
    """
    plain = F.regexp_replace(as_col(xml), INLINE_MARKUP, "")
    parsed = df.withColumn("_a", F.from_xml(plain, ARTICLE_SCHEMA))
    return parsed.select(*keep, *_article_columns(F.col("_a.MedlineCitation"), F.col("_a.PubmedData.ArticleIdList.ArticleId")))


def response_records(df: DataFrame, body: str | Column, *keep: str) -> DataFrame:
    """Records of search-response JSON."""
    parsed = df.withColumn("_r", F.from_json(as_col(body), RESPONSE_SCHEMA))
    rows = parsed.select(*keep, F.posexplode_outer("_r.data").alias("position", "_d")).filter("_d is not null")
    return rows.select(*keep, "position", "_d.*")


def ris_entry(
    number: Column, title: Column, authors: Column, year: Column, doi: Column, journal: Column,
    volume: Column, pages: Column, abstract: Column, tag: Column,
) -> Column:
    """Citation-manager entry of one record (S7); a ``PMID:`` id is never written as a DOI."""
    def line(code: str, value: Column) -> Column:
        text = blank_to_null(value.cast("string"))
        return F.when(text.isNotNull(), F.concat(F.lit(f"{code}  - "), text))

    real_doi = F.when(~doi.startswith("PMID:"), doi)
    names = F.transform(F.filter(authors, lambda a: F.coalesce(a, F.lit("")) != ""), lambda a: F.concat(F.lit("AU  - "), a))
    words = F.filter(F.transform(F.split(F.coalesce(tag, F.lit("")), ";"), lambda t: F.trim(t)), lambda t: t != "")
    given_year = F.when(year != 0, year).cast("string")
    return F.concat_ws(
        "\n", F.lit("TY  - JOUR"), F.concat(F.lit("ID  - ss_"), number.cast("string")), line("T1", title), line("TI", title), names,
        line("PY", given_year), line("DA", F.concat(given_year, F.lit("//"))), line("DO", real_doi),
        line("UR", F.concat(F.lit("https://doi.org/"), blank_to_null(real_doi))), line("JO", journal), line("JF", journal), line("VL", volume),
        line("SP", pages), line("AB", abstract), F.transform(words, lambda w: F.concat(F.lit("KW  - "), w)), F.lit("ER  - "))


def catalog_item(title: Column, authors: Column, year: Column, doi: Column, journal: Column, abstract: Column, tags: Column, collection: str | None) -> Column:
    """Catalog item of one record."""
    doi = F.coalesce(doi, F.lit(""))
    is_pmid = doi.startswith("PMID:")
    real = F.when(is_pmid, "").otherwise(doi)
    blank = F.lit("")
    creators = F.transform(F.filter(authors, lambda a: F.trim(F.coalesce(a, blank)) != ""), author_name)
    return F.struct(
        F.lit("journalArticle").alias("itemType"), F.coalesce(title, blank).alias("title"), creators.alias("creators"),
        F.coalesce(year.cast("string"), blank).alias("date"), F.coalesce(journal, blank).alias("publicationTitle"), real.alias("DOI"),
        F.coalesce(abstract, blank).alias("abstractNote"),
        F.transform(F.filter(tags, lambda t: F.coalesce(t, blank) != ""), lambda t: F.struct(t.alias("tag"))).alias("tags"),
        F.array(*([F.lit(collection)] if collection else [])).cast("array<string>").alias("collections"),
        F.when(real != "", F.concat(F.lit("https://doi.org/"), real)).alias("url"), F.when(is_pmid, doi).alias("extra"))


def upsert_batches(items: DataFrame, order: str = "seq", size: int = 50) -> DataFrame:
    """Payload batches of at most ``size`` items in input order."""
    numbered = number_rows(items, [], order, "_rank").withColumn("batch", batch_number("_rank", size))
    rest = [c for c in items.columns if c != order]
    payload = F.array_sort(F.collect_list(F.struct(order, *rest)))
    return numbered.groupBy("batch").agg(payload.alias("payload"))
