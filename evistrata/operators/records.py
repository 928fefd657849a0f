"""Search-result consolidation."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evistrata.common import as_col, first_seen, written
from evistrata.functions import rules as R
from evistrata.functions.keys import record_key, stable_id, title_key
from evistrata.functions.text import strip
from evistrata.functions.values import truthy

SearchRunner = Callable[[str, int], DataFrame]

PROVENANCE_FIELDS = ("search_id", "source", "query", "run_id")


def stamp_provenance(df: DataFrame, search_id: str, source: str, query: str, run_id: str) -> DataFrame:
    """Add the search path a record came from; needs ``seq``, ``doi`` and ``title``."""
    key = record_key("doi", "title", F.lit(""))
    given = F.col("raw_record_id") if "raw_record_id" in df.columns else F.lit(None).cast("string")
    return df.withColumns({
        "search_id": F.lit(search_id), "source": F.lit(source), "query": F.lit(query), "run_id": F.lit(run_id),
        "raw_record_id": F.coalesce(given, stable_id("record", F.lit(search_id), key, "seq")),
    })


LOG_SCHEMA = (
    "run_id string, search_id string, source string, exact_query string, execution_time timestamp, tool_api_version string,"
    " raw_count bigint, accepted_count bigint, error string, duration_seconds double, protocol_hash string")


def _search(path: Mapping, runners: Mapping[str, SearchRunner], run_id: str, limit: int) -> DataFrame:
    """Records of one search path, read in full and written."""
    if not path.get("query"):
        raise ValueError("query must not be empty")
    if path.get("source") not in runners:
        raise ValueError(f"no search runner registered for source {path.get('source')!r}")
    records = runners[path["source"]](path["query"], limit)
    if not isinstance(records, DataFrame):
        raise TypeError("a search runner must return a DataFrame")
    return written(stamp_provenance(records, path["id"], path["source"], path["query"], run_id), "search")


def run_searches(
    spark: SparkSession,
    searches: Sequence[Mapping],
    runners: Mapping[str, SearchRunner],
    run_id: str | None = None,
    seeds: DataFrame | None = None,
    only: str | None = None,
    limit: int = 100,
    allow_empty: bool = False,
    protocol_hash: str = "",
    tool_version: str = "1.0",
) -> tuple[DataFrame | None, DataFrame]:
    """Union of seeds and all enabled search paths, and the log of the paths.

    Runs one job per path: its records are read in full and written to the shared folder.  A path
    that cannot be planned, fails while it is read or does not fit the others' columns becomes a log
    row with an error and no records, not even those it gave before it failed; the others go on.
    Without ``run_id`` each path gets an id from its name and start.  Seeds are not logged.
    """
    chosen = [s for s in searches if s.get("enabled", True) and only in (None, s.get("id"))]
    if only is not None and not chosen:
        raise ValueError(f"enabled search {only!r} was not found")
    if not chosen and seeds is None and not allow_empty:
        raise ValueError("the search plan has neither enabled searches nor seed records")
    raw = None if seeds is None else stamp_provenance(seeds, "seed", "seed", "", "seed")
    log = []
    for path in chosen:
        begun, clock = datetime.now(timezone.utc), time.monotonic()
        token = run_id or "searchrun_" + hashlib.sha256(f"{path.get('id')}|{begun.isoformat()}".encode()).hexdigest()[:16]
        error, count = None, 0
        try:
            records = _search(path, runners, token, limit)
            count = records.count()
            raw = records if raw is None else raw.unionByName(records, allowMissingColumns=True)
        except Exception as exc:  # one failed path must not lose the others
            error, count = f"{type(exc).__name__}: {exc}", 0
        log.append((token, path.get("id"), path.get("source"), path.get("query"), begun, path.get("api_version", tool_version),
                    count, count, error, round(time.monotonic() - clock, 6), protocol_hash))
    return raw, spark.createDataFrame(log, LOG_SCHEMA)


def with_record_key(raw: DataFrame) -> DataFrame:
    keyed = raw.withColumn("record_key", record_key("doi", "title", "raw_record_id"))
    return keyed.withColumn("record_id", stable_id("record", "record_key"))


def merge_duplicates(keyed: DataFrame, fields: Sequence[str], seq: str = "seq") -> DataFrame:
    """One row per key; every field is its first given value in input order (A2)."""
    types = {f.name: f.dataType for f in keyed.schema.fields}
    merged = [F.min_by(f, F.when(truthy(f, types[f]), F.col(seq))).alias(f) for f in fields]
    return keyed.groupBy("record_id", "record_key").agg(
        *merged, F.count(F.lit(1)).alias("members"), F.min(seq).alias("first_seq"))


def duplicate_members(keyed: DataFrame) -> DataFrame:
    """Rows of every key that occurs more than once (A3), as (record_id, raw_record_id, seq)."""
    repeated = keyed.groupBy("record_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("record_key")
    return keyed.join(repeated, "record_key", "left_semi").select("record_id", "raw_record_id", "seq")


def provenance(keyed: DataFrame) -> DataFrame:
    """Distinct (run, search) pairs per record in first-seen order (A4)."""
    carried = [c for c in ("source", "query") if c in keyed.columns]
    return keyed.groupBy("record_id", "run_id", "search_id").agg(
        F.min("seq").alias("first_seq"), *[F.min_by(c, "seq").alias(c) for c in carried])


def drop_known(records: DataFrame, known: DataFrame, key: str = "doi") -> DataFrame:
    """Records whose key is not known; keyless records stay."""
    return records.join(known.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def known_records(records: DataFrame, known: DataFrame, key: str = "doi") -> DataFrame:
    """Records whose key is known already, to attach to a collection."""
    return records.join(known.select(key).distinct(), key, "left_semi")


def filter_candidates(
    records: DataFrame, known: DataFrame, rules: Sequence[R.Category] | None = None,
    min_citations: int = 0, min_score: int = 4, base_tag: str = "",
) -> DataFrame:
    """Drop known and repeated DOIs, then screen by rules or by citation count.

    Needs doi, seq, blob, year, citations.  A rejected candidate still blocks a
    later one with the same DOI.
    """
    fresh = first_seen(drop_known(records, known), "doi", "seq")
    if rules is None:
        cited = F.coalesce(F.col("citations"), F.lit(0))
        return fresh.filter(cited >= min_citations).withColumn("tags", R.tag_parts(F.lit(base_tag)))
    scored = fresh.withColumn("screen", R.screen("blob", "year", "citations", rules, min_score))
    kept = scored.filter("screen.keep")
    return kept.withColumn("tags", R.tag_parts(R.screen_tag(base_tag, "screen.tier", "screen.score")))


def search_summary(log: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """Runs and failures per search, and with keyed records their raw and unique count.

    A search without records counts 0, records without a log row (seeds) have no runs.
    """
    runs = log.groupBy("search_id").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("error").isNotNull()).alias("failures"))
    if raw is None:
        return runs
    counts = raw.groupBy("search_id").agg(F.count(F.lit(1)).alias("raw_count"), F.countDistinct("record_key").alias("unique_count"))
    return runs.join(counts, "search_id", "full_outer").fillna(0, ["runs", "failures", "raw_count", "unique_count"])


def run_summary(log: DataFrame, keyed: DataFrame) -> DataFrame:
    """One row for the whole ledger (A16): raw and unique records, failures."""
    failures = log.agg(F.count_if(F.col("error").isNotNull())).scalar()
    unique = keyed.groupBy("record_key").agg(F.count(F.lit(1)).alias("_n"))
    return unique.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("raw_records"), F.count(F.lit(1)).alias("unique_records")).withColumn("failures", failures)


def file_name(path: str | Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(as_col(path), r"\\", "/"), "/"), -1)


def file_stem(path: str | Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def match_extractions(extractions: DataFrame, records: DataFrame) -> DataFrame:
    """Link extractions to records: explicit id, DOI, PMID, title, file name.

    DOI, PMID and title count only when exactly one record carries them.
    ``extractions``: extraction_id, source_record_id, doi, pmid, title, source_file;
    ``records``: record_id, doi, pmid, title, source_file, seq.
    """
    def single(key: Column, name: str) -> DataFrame:
        return (
            records.select(key.alias(name), "record_id").filter(F.col(name).isNotNull())
            .groupBy(name).agg(F.min("record_id").alias(f"{name}_record"), F.max("record_id").alias("_other"), F.count(F.lit(1)).alias("_n"))
            .filter("_n = 1").drop("_n", "_other")
        )

    def given(value: Column) -> Column:
        return F.nullif(strip(value), F.lit(""))

    by_file = (
        records.select(F.nullif(file_name("source_file"), F.lit("")).alias("k_file"), "record_id", "seq").filter("k_file is not null")
        .groupBy("k_file").agg(F.min_by("record_id", "seq").alias("k_file_record"))
    )
    wanted = extractions.withColumns({
        "k_doi": F.col("doi"),
        "k_pmid": given(F.col("pmid")),
        "k_title": F.coalesce(F.nullif(title_key("title"), F.lit("")), F.nullif(title_key(file_stem("source_file")), F.lit(""))),
        "k_file": F.nullif(file_name("source_file"), F.lit("")),
        "k_explicit": given(F.col("source_record_id")),
    })
    linked = (
        wanted.join(single(F.col("doi"), "k_doi"), "k_doi", "left")
        .join(single(given(F.col("pmid")), "k_pmid"), "k_pmid", "left")
        .join(single(F.nullif(title_key("title"), F.lit("")), "k_title"), "k_title", "left")
        .join(by_file, "k_file", "left")
    )
    method = (
        F.when(F.col("k_explicit").isNotNull(), "explicit_input")
        .when(F.col("k_doi_record").isNotNull(), "doi")
        .when(F.col("k_pmid_record").isNotNull(), "pmid")
        .when(F.col("k_title_record").isNotNull(), "title")
        .when(F.col("k_file_record").isNotNull(), "manual")
        .otherwise("unlinked")
    )
    confidence = F.when(method == "manual", "manual").when(method == "unlinked", "probable").otherwise("exact")
    return linked.select(
        *[F.col(c) for c in extractions.columns],
        F.coalesce("k_explicit", "k_doi_record", "k_pmid_record", "k_title_record", "k_file_record").alias("record_id"),
        method.alias("link_method"), confidence.alias("confidence"),
    )


def reconcile(targets: DataFrame, found: DataFrame, key: str = "doi") -> DataFrame:
    """Distinct target keys with a flag whether they were found."""
    want = targets.select(F.lower(key).alias(key)).filter(F.col(key) != "").distinct()
    have = found.select(F.lower(key).alias(key)).distinct().withColumn("found", F.lit(True))
    return want.join(have, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))
