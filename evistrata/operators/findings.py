"""Finding counts, matching and tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evistrata.common import latest_by, number_rows, same_row, top_k, written
from evistrata.functions import findings as N
from evistrata.functions.text import search_terms

# Support levels of a verdict, best first, and the note fields of a document breakdown.
SUPPORT_LEVELS = ("full", "partial", "weak", "none", "contradictory")
NOTE_FIELDS = (
    "original_title", "title_cn", "authors", "journal_impact", "year", "background",
    "objective", "methods", "results", "conclusion", "limitations", "innovation",
)


def normalize_findings(results: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per usable finding with its document's relevance."""
    keys = [c for c in results.columns if c != payload]
    shaped = results.select(*keys, N.normalize_payload(payload)["findings"].alias("_findings"))
    rows = shaped.select(*keys, F.posexplode_outer("_findings").alias("position", "_f")).filter("_f is not null")
    return rows.select(*keys, F.lit(True).alias("relevant"), "position", "_f.*")


def document_relevance(results: DataFrame, payload: str = "payload") -> DataFrame:
    """Relevance per document: stated, or kept by a usable finding (P25)."""
    shaped = results.withColumn("_r", N.normalize_payload(payload))
    relevant = F.col("_r.relevant") | (F.size("_r.findings") > 0)
    return shaped.select(*[c for c in results.columns if c != payload], relevant.alias("relevant"))


def relevance_counts(findings: DataFrame) -> DataFrame:
    """Findings per relevance level and relevant documents."""
    levels = [F.count_if(F.col("relevance_level") == name).alias(name) for name in ("direct", "indirect", "background")]
    return findings.agg(
        F.count(F.lit(1)).alias("findings"), *levels, F.countDistinct(F.when(F.col("relevant"), F.col("doc_id"))).alias("relevant_documents"))


def dimension_rows(findings: DataFrame) -> DataFrame:
    """(kind, dimension, value) of every given finding field of relevant documents."""
    pairs = [("subject", "relation.subject"), ("object", "relation.object"), ("direction", "relation.direction")]
    pairs += [(name, f"context.{name}") for name in N.CONTEXT_FIELDS]

    def entry(kind: str, dimension: Column, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), dimension.alias("dimension"), value.alias("value"))

    fields = F.array(*[entry("field", F.lit(n), F.col(c)) for n, c in pairs])
    variables = F.transform("variables", lambda v: entry("field", F.lit("variable"), v["name"]))
    tags = F.transform(F.map_entries("topic_tags"), lambda e: entry("tag", e["key"], e["value"]))
    rows = findings.filter("relevant").select(F.inline_outer(F.concat(fields, variables, tags)))
    return rows.filter((F.coalesce("value", F.lit("")) != "") & ~((F.col("dimension") == "direction") & (F.col("value") == "not_applicable")))


def dimension_counts(findings: DataFrame) -> DataFrame:
    return dimension_rows(findings).groupBy("kind", "dimension", "value").agg(F.count(F.lit(1)).alias("n"))


def leading_dimension(counts: DataFrame, field_minimum: int = 3, tag_minimum: int = 2, values: int = 4) -> DataFrame:
    """Most frequent values of the best dimension (A7): fields first, tags when no field repeats enough."""
    enough = ((F.col("kind") == "field") & (F.col("n") >= field_minimum)) | ((F.col("kind") == "tag") & (F.col("n") >= tag_minimum))
    order = [F.when(F.col("kind") == "field", 0).otherwise(1).asc(), F.col("n").desc(), F.col("dimension"), F.col("value")]
    best = counts.filter(enough).orderBy(*order).limit(1).select("kind", "dimension")
    of_best = counts.join(best, ["kind", "dimension"], "left_semi")
    return top_k(of_best, ["kind", "dimension"], [F.col("n").desc(), F.col("value")], values)


def index_findings(findings: DataFrame, references: DataFrame, seq: str = "seq") -> DataFrame:
    """Findings of relevant documents with reference data and a running 0-based index.

    ``references``: doc_id, ref_num, title, authors, year; ``seq`` orders all findings.
    """
    numbered = number_rows(findings.filter("relevant"), [], seq, "_rank")
    return numbered.join(references, "doc_id").withColumn("index", F.col("_rank") - 1).drop("_rank")


def main_findings(findings: DataFrame) -> DataFrame:
    """Findings for the main report; indirect and background ones when there are none."""
    any_main = findings.agg(F.coalesce(F.bool_or("include_in_main_report"), F.lit(False)).alias("any")).scalar()
    spare = ~any_main & F.col("relevance_level").isin("indirect", "background")
    return findings.filter(F.col("include_in_main_report") | spare)


def _criterion(group: str, name: str, value: str) -> Column:
    if group == "variables":
        return F.exists("variables", lambda v: v["name"] == value)
    if group == "topic_tags":
        return F.coalesce(F.try_element_at(F.col("topic_tags"), F.lit(name)) == value, F.lit(False))
    return F.coalesce(F.col(f"{group}.{name}") == value, F.lit(False))


def match_leaves(findings: DataFrame, leaves: Sequence[Mapping], limit: int = 8, index: str = "index") -> DataFrame:
    """Best findings per outline leaf by matching criteria.

    ``leaves``: heading and criteria as (group, name, value).  A leaf that matches
    nothing gets the first findings.  Rows: leaf, index, matches, rank.
    """
    scores = []
    for number, leaf in enumerate(leaves):
        matched = F.lit(0)
        for group, name, value in leaf["criteria"]:
            matched = matched + _criterion(group, name, value).cast("int")
        scores.append(F.struct(F.lit(number).alias("leaf"), matched.alias("matches")))
    hits = findings.select(index, F.inline_outer(F.filter(F.array(*scores), lambda s: s["matches"] > 0))).filter("leaf is not null")
    best = top_k(hits, ["leaf"], [F.col("matches").desc(), F.col(index)], limit)
    spark = findings.sparkSession
    empty = spark.createDataFrame([(n,) for n in range(len(leaves))], "leaf int").join(best.select("leaf").distinct(), "leaf", "left_anti")
    first = findings.select(index).orderBy(index).limit(limit)
    numbers = F.array_sort(F.collect_list(index))  # at most ``limit`` entries
    spare = empty.withColumn("_first", first.agg(numbers.alias("a")).scalar()).select("leaf", F.posexplode("_first").alias("p", index))
    return best.unionByName(spare.select(index, "leaf", F.lit(0).alias("matches"), (F.col("p") + 1).alias("rank")))


def accepted_matches(proposed: DataFrame, findings: DataFrame, limit: int = 8) -> DataFrame:
    """First ``limit`` distinct proposed findings per leaf that are candidates."""
    once = proposed.groupBy("leaf", "index").agg(F.min("position").alias("position"))
    valid = once.join(findings.select("index"), "index", "left_semi")
    return top_k(valid, ["leaf"], [F.col("position")], limit)


def match_coverage(matched: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates, matched ones, dropped ones and their ratio."""
    flags = candidates.select("index").join(matched.select("index").distinct().withColumn("_m", F.lit(1)), "index", "left")
    return flags.agg(F.count(F.lit(1)).alias("candidates"), F.count("_m").alias("matched")).select(
        "candidates", "matched", (F.col("candidates") - F.col("matched")).alias("dropped"),
        F.when(F.col("candidates") > 0, F.round(F.col("matched") / F.col("candidates"), 4)).otherwise(0.0).alias("coverage"))


def candidate_values(findings: DataFrame) -> DataFrame:
    """Distinct populations, interventions, outcomes, variables and seed documents."""
    def entry(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"))

    plain = F.array(
        entry("population", F.col("context.sample_or_system")), entry("intervention", F.col("relation.subject")),
        entry("outcome", F.col("relation.object")), entry("seed", F.col("title")))
    variables = F.transform("variables", lambda v: entry("variable", v["name"]))
    rows = findings.select(F.inline_outer(F.concat(plain, variables)))
    return rows.filter(F.coalesce("value", F.lit("")) != "").distinct()


def crosstab(rows: DataFrame, row: str, column: str) -> DataFrame:
    """Evidence counts over two dimensions."""
    return rows.groupBy(F.col(row).alias("row_value"), F.col(column).alias("column_value")).agg(F.count(F.lit(1)).alias("n"))


def crosstab_gap_counts(counts: DataFrame) -> DataFrame:
    """Filled and empty cells per row value (A31), without listing any."""
    columns = counts.agg(F.countDistinct("column_value")).scalar()
    return counts.groupBy("row_value").agg(F.count("column_value").alias("filled")).select("row_value", "filled", (columns - F.col("filled")).alias("empty"))


def crosstab_gaps(counts: DataFrame, rows: DataFrame | None = None, size: int = 1000) -> DataFrame:
    """Cells without evidence (A31): per row value, the column values it lacks.

    Runs jobs.  Ask for the row values in ``rows`` (row_value) where the crosstab is large: the
    answer for all of them has as many rows as there are empty cells.  Column values are numbered
    and kept in buckets of ``size``; a row value meets one bucket at a time, so no array
    outgrows a bucket and nothing reaches the driver.  A null column value is no cell.
    """
    if rows is not None:
        asked = rows.select("row_value").distinct()
        counts_of = counts.alias("n").join(asked.alias("h"), same_row("n", "h", ["row_value"]), "left_semi")
    else:
        counts_of = counts
    columns = number_rows(counts.select("column_value").filter("column_value is not null").distinct(), [], "column_value", "_n")
    columns = columns.select("column_value", F.floor((F.col("_n") - 1) / F.lit(size)).alias("_bucket"))
    whole = columns.groupBy("_bucket").agg(F.collect_list("column_value").alias("_all"))
    seen = counts_of.join(columns, "column_value").groupBy("row_value", "_bucket").agg(F.collect_list("column_value").alias("_seen"))
    last = columns.agg(F.max("_bucket")).scalar()
    grid = counts_of.select("row_value").distinct().withColumn("_bucket", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    met = grid.alias("n").join(seen.alias("h"), same_row("n", "h", ["row_value", "_bucket"]), "left").select("n.row_value", "n._bucket", "h._seen")
    lacked = F.when(F.col("_seen").isNull(), F.col("_all")).otherwise(F.array_except("_all", "_seen"))
    return met.join(whole, "_bucket").select("row_value", F.explode(lacked).alias("column_value"))


def best_views(views: DataFrame, keys: Sequence[str], position: str = "position") -> DataFrame:
    """Best table view per report: coverage, then a rationale, then longer dimensions (T4)."""
    order = F.struct(
        F.col("coverage").alias("a"), (F.col("coverage_rationale") != "").alias("b"),
        (F.length("row_dimension") + F.length("column_dimension")).alias("c"), (-F.col(position)).alias("d"))
    return latest_by(views, list(keys), order)


def notes(results: DataFrame, file: str = "file") -> DataFrame:
    """Fixed note columns, absent ones as '' (P53)."""
    given = set(results.columns)
    return results.select(file, *[(F.coalesce(F.col(n).cast("string"), F.lit("")) if n in given else F.lit("")).alias(n) for n in NOTE_FIELDS])


def support_counts(verdicts: DataFrame) -> DataFrame:
    """Verdicts per claim and support level."""
    return verdicts.groupBy("claim_id").agg(*[F.count_if(F.col("level") == name).alias(name) for name in SUPPORT_LEVELS])


def claims_with_verdicts(claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Every claim with its verdict rows, claims without any included."""
    return claims.join(verdicts, "claim_id", "left").withColumn("verified", F.col("level").isNotNull())


def relevant_documents(claims: DataFrame, documents: DataFrame, k: int = 3, rare: float = 0.1) -> DataFrame:
    """The ``k`` documents per claim whose shared terms weigh most, ties by least ``doc_id``.

    A term that ``df`` of all ``n`` documents have weighs the binary digits of ``n div df``: 1 if
    more than half have it, never 0.  ``shared`` counts the terms, ``score`` adds their weights.
    Claims without a shared term have no row.

    Postings of the claims' terms are written to the shared folder once (this runs jobs).
    Candidates come from terms of at most the share ``rare`` of documents.  If the k-th
    candidate's weight exceeds all that the claim's other terms weigh, no other document can get
    among the first k, and only candidates within reach are completed.  The claims left, those
    with common terms alone among them, add up all their postings.  ``rare`` changes cost only.
    """
    asked = claims.select("claim_id", F.explode(search_terms(F.lower("claim"))).alias("term"))
    offered = documents.select("doc_id", F.explode(search_terms(F.lower("text"))).alias("term"))
    postings = written(offered.join(asked.select("term").distinct(), "term", "left_semi"), "postings")
    total = F.lit(documents.count())
    weights = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weights = weights.select("term", F.length(F.bin(F.floor(total / F.col("df")))).cast("long").alias("weight"), (F.col("df") <= rare * total).alias("rare"))
    asked = written(asked.join(weights, "term"), "asked")

    def scores(rows: DataFrame, terms: DataFrame) -> DataFrame:
        return rows.join(terms, "term").groupBy("claim_id", "doc_id").agg(F.sum("weight").alias("score"), F.count(F.lit(1)).alias("shared"))

    order = [F.col("score").desc(), F.col("doc_id")]
    partial = written(scores(postings, asked.filter("rare").select("claim_id", "term", "weight")), "partial")
    rest = asked.groupBy("claim_id").agg(F.sum(F.when(F.col("rare"), 0).otherwise(F.col("weight"))).alias("rest"))
    bar = top_k(partial, ["claim_id"], order, k).groupBy("claim_id").agg(F.min("score").alias("bar"), F.count(F.lit(1)).alias("found"))
    settled = bar.join(rest, "claim_id").filter((F.col("found") == k) & (F.col("bar") > F.col("rest"))).select("claim_id", "bar", "rest")

    leaders = partial.join(settled, "claim_id").filter("score + rest >= bar").select("claim_id", "doc_id", "score", "shared")
    common = asked.filter("not rare").select("claim_id", "term", "weight")
    more = scores(postings.join(leaders.select("doc_id").distinct(), "doc_id", "left_semi"), common.join(settled.select("claim_id"), "claim_id", "left_semi"))
    more = more.select("claim_id", "doc_id", F.col("score").alias("more"), F.col("shared").alias("others"))
    complete = leaders.join(more, ["claim_id", "doc_id"], "left").select(
        "claim_id", "doc_id", (F.col("score") + F.coalesce("more", F.lit(0))).alias("score"), (F.col("shared") + F.coalesce("others", F.lit(0))).alias("shared"))
    unsettled = scores(postings, asked.join(settled.select("claim_id"), "claim_id", "left_anti").select("claim_id", "term", "weight"))
    return top_k(complete.unionByName(unsettled), ["claim_id"], order, k)
