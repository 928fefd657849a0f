"""Eligibility and full-text gates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evistrata.common import latest_by
from evistrata.operators.screening import ENFORCEMENT_LEVELS, check_level, completeness, incomplete_records

# What must be available for an included record.
FULLTEXT_REQUIREMENTS = ("required", "structured_extraction_allowed", "optional")


def latest_links(links: DataFrame) -> DataFrame:
    """Last active source-record link per study."""
    active = links.filter(F.coalesce("status", F.lit("active")) == "active").filter("study_id <> ''")
    return latest_by(active, ["study_id"], "seq")


@dataclass
class Eligibility:
    studies: DataFrame  # study_id, publication_id, record_id, study_state, eligible
    included_records: DataFrame  # record_id, linked
    incomplete_records: DataFrame  # record_id (only when screening is required)


def resolve_eligibility(
    studies: DataFrame, links: DataFrame, latest: DataFrame, universe: DataFrame, enforcement: str = "optional",
) -> Eligibility:
    """One gate for records, publications and studies.

    ``required`` also asks for inclusion on title; ``disabled``, and ``optional``
    without any full-text decision, let every study through.
    """
    check_level(enforcement, ENFORCEMENT_LEVELS, "enforcement")
    states = completeness(universe, latest)
    fulltext = latest.filter("stage = 'fulltext'")
    if enforcement == "required":
        included = states.filter("fulltext_included").select("record_id")
        missing = incomplete_records(states).select("record_id")
    else:
        included = states.filter("in_universe and fulltext = 'include'").select("record_id")
        missing = states.select("record_id").filter(F.lit(False))
    linked = latest_links(links).select("study_id", F.nullif("record_id", F.lit("")).alias("record_id"), F.lit(True).alias("_link"))
    rows = (
        studies.select("study_id", "publication_id").join(linked, "study_id", "left")
        .join(included.withColumn("_included", F.lit(True)), "record_id", "left")
    )
    state = F.when(F.col("record_id").isNull(), "unlinked").when(F.col("_included").isNotNull(), "included").otherwise("not_included")
    if enforcement == "disabled":
        gate_open = F.lit(True)
    elif enforcement == "optional":
        gate_open = fulltext.agg((F.count(F.lit(1)) == 0).alias("none")).scalar()
    else:
        gate_open = F.lit(False)
    judged = rows.select(
        "study_id", "publication_id", "record_id", state.alias("study_state"), ((state == "included") | gate_open).alias("eligible"))
    has_link = linked.select("record_id").filter("record_id is not null").distinct().withColumn("linked", F.lit(True))
    return Eligibility(judged, included.join(has_link, "record_id", "left").withColumn("linked", F.coalesce("linked", F.lit(False))), missing)


def declared_resources(resources: DataFrame) -> DataFrame:
    """Records with a usable full-text resource (S18): not withdrawn, and located or confirmed."""
    locators = [c for c in ("path", "file", "uri", "resource_id", "content", "text") if c in resources.columns]
    located = F.lit(False)
    for name in locators:
        located = located | (F.coalesce(F.col(name), F.lit("")) != "")
    usable = F.coalesce("available", F.lit(True)) & (located | F.coalesce("available", F.lit(False)))
    return resources.filter((F.col("record_id") != "") & usable).select("record_id").distinct()


def fulltext_status(
    included: DataFrame, resources: DataFrame, record_files: DataFrame, files: DataFrame,
    links: DataFrame, current_studies: DataFrame, requirement: str = "required",
) -> DataFrame:
    """Full text, structured extraction, and what blocks, per included record.

    ``record_files``: (record_id, path) rows named by records; ``files``: listing with ``path``.
    """
    check_level(requirement, FULLTEXT_REQUIREMENTS, "requirement")
    on_disk = record_files.join(files.select("path").distinct(), "path", "left_semi").select("record_id")
    with_text = declared_resources(resources).unionByName(on_disk).distinct().withColumn("_text", F.lit(True))
    extracted = (
        latest_links(links).join(current_studies.select("study_id"), "study_id", "left_semi")
        .select("record_id").distinct().withColumn("_study", F.lit(True))
    )
    rows = included.select("record_id").join(with_text, "record_id", "left").join(extracted, "record_id", "left")
    text, study = F.coalesce("_text", F.lit(False)), F.coalesce("_study", F.lit(False))
    blocking = {"required": ~text, "structured_extraction_allowed": ~study, "optional": F.lit(False)}[requirement]
    return rows.select(
        "record_id", text.alias("fulltext_available"), study.alias("structured_available"),
        (text & study).alias("both_available"), blocking.alias("blocking"))


def route_documents(documents: DataFrame, latest: DataFrame, enforcement: str = "optional") -> DataFrame:
    """Send each bound document to process, skip or error (J33). Needs ``record_id``."""
    check_level(enforcement, ENFORCEMENT_LEVELS, "enforcement")
    decisions = latest.filter("stage = 'fulltext'").select("record_id", F.col("decision").alias("fulltext_decision"))
    joined = documents.join(decisions, "record_id", "left")
    decided = F.col("fulltext_decision").isNotNull()
    unbound = F.lit(enforcement == "required") & (F.col("record_id").isNull() | ~decided)
    route = F.when(decided & (F.col("fulltext_decision") != "include"), "skip").when(unbound, "error").otherwise("process")
    return joined.withColumn("route", route)
