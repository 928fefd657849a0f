"""Versioned extraction."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evistrata.common import latest_by
from evistrata.functions.keys import evidence_id, stable_id
from evistrata.functions.values import location_status

# Statuses that take an entity out of the current view.
INACTIVE = ("superseded", "resolved", "inactive")


def focus_terms(spec: DataFrame) -> DataFrame:
    """Distinct search terms of field names, descriptions, instructions and aliases, first seen first.

    ``spec``: seq, name, description, instruction, aliases.
    """
    words = F.split(F.replace("name", F.lit("."), F.lit(" ")), r"\s+")
    texts = F.concat(words, F.array("description", "instruction"), F.coalesce("aliases", F.array().cast("array<string>")))
    rows = spec.select("seq", F.posexplode(texts).alias("pos", "term")).withColumn("term", F.trim("term"))
    return rows.filter("term <> ''").groupBy("term").agg(F.min(F.struct("seq", "pos")).alias("at")).select("term", "at.seq", "at.pos")


def migrate_direction(outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Outcomes with ``effect_direction`` filled from the older ``direction``, and the warnings.

    The support relation is never inferred from it.
    """
    older = F.col("effect_direction").isNull() & F.col("direction").isNotNull()
    direction = F.coalesce("effect_direction", "direction", F.lit("unclear"))
    warnings = outcomes.filter(older).select("study_id", "outcome_id", F.lit("legacy_direction_migrated").alias("warning"))
    return outcomes.withColumn("effect_direction", direction).drop("direction"), warnings


def evidence_rows(outcomes: DataFrame, current_only: bool = False) -> DataFrame:
    """One row per evidence location with its ordinal and identity.

    ``evidence``: array of quote, page, section, figure, table, validation_status,
    status, extraction_run_id.  ``current_only`` keeps active locations of the
    outcome's own run.
    """
    rows = outcomes.select("study_id", "outcome_id", F.col("extraction_run_id").alias("_run"), F.posexplode_outer("evidence").alias("ordinal", "e"))
    rows = rows.filter("e is not null")
    if current_only:
        run = F.coalesce("e.extraction_run_id", F.lit(""))
        same_run = (run == "") | (F.coalesce("_run", F.lit("")) == "") | (run == F.col("_run"))
        rows = rows.filter((F.coalesce("e.status", F.lit("active")) == "active") & same_run)
    blank = F.lit("")
    parts = [F.coalesce(F.col(f"e.{n}"), blank) for n in ("quote", "page", "section", "figure", "table")]
    return rows.select(
        evidence_id("study_id", "outcome_id", *parts, "ordinal").alias("evidence_id"), "study_id", "outcome_id", "ordinal",
        F.coalesce(F.nullif("e.extraction_run_id", blank), "_run").alias("extraction_run_id"),
        F.coalesce("e.status", F.lit("active")).alias("status"),
        F.coalesce("e.validation_status", F.lit("unverified")).alias("validation_status"), F.col("e.quote").alias("quote"))


def judge_locations(locations: DataFrame, passed: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Locations with their status, and an error row for each failed quote."""
    judged = locations.withColumn("validation_status", location_status("manual_verified", passed))
    confidence = F.when(F.col("validation_status") == "passed", 1.0).otherwise(0.0)
    judged = judged.withColumn("confidence", confidence)
    errors = judged.filter("validation_status = 'failed'").select("study_id", "outcome_id", "quote", F.lit("quote_verification_failed").alias("error"))
    return judged, errors


# --- versions -------------------------------------------------------------

@dataclass
class Reingest:
    opened: DataFrame  # new active rows
    closed: DataFrame  # previous rows, now superseded
    state: DataFrame  # outcome_id, extraction_run_id, extraction_version, status, supersedes


def match_previous(incoming: DataFrame, previous: DataFrame) -> DataFrame:
    """Previous row each incoming row continues, by its first matching alias.

    Both sides: study_id and ``aliases`` in falling certainty; ``incoming`` has
    ``row_id``, ``previous`` has ``seq``.  Of several previous rows under one
    alias the last counts.
    """
    known = previous.select("study_id", F.explode(F.array_distinct("aliases")).alias("alias"), "outcome_id", "extraction_run_id", "seq")
    known = latest_by(known, ["study_id", "alias"], "seq")
    asked = incoming.select("row_id", "study_id", F.posexplode(F.array_compact("aliases")).alias("certainty", "alias"))
    hits = asked.join(known, ["study_id", "alias"])
    return hits.groupBy("row_id").agg(F.min_by(F.struct("outcome_id", "extraction_run_id"), "certainty").alias("_p")).select(
        "row_id", F.col("_p.outcome_id").alias("previous_id"), F.col("_p.extraction_run_id").alias("previous_run"))


def _as_is(df: DataFrame) -> DataFrame:
    return df


def reingest(
    previous: DataFrame, incoming: DataFrame, run_id: str, reextracted: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] = _as_is,
) -> Reingest:
    """Supersede the outcomes of every re-extracted publication and open the new version.

    ``previous``: active rows with outcome_id, study_id, publication_id, aliases,
    extraction_run_id, extraction_version, seq.  ``incoming``: row_id, study_id,
    publication_id, identity_key, explicit_id, aliases.  An outcome keeps its id
    when an alias matches; outcomes that vanished are closed.  ``reextracted`` names all
    re-extracted publications with their ``extraction_version`` before, if they had one; a
    publication that lost every outcome is only known from there.  The state reads the opened
    rows twice; pass ``keep=cut_lineage`` to match them to the previous ones once.
    """
    touched = incoming.select("publication_id")
    if reextracted is not None:
        touched = touched.unionByName(reextracted.select("publication_id"))
    touched = touched.distinct()
    before = previous.select("publication_id", "extraction_version")
    if reextracted is not None and "extraction_version" in reextracted.columns:
        before = before.unionByName(reextracted.select("publication_id", "extraction_version"))
    versions = before.groupBy("publication_id").agg(F.max("extraction_version").alias("_version"))
    matched = incoming.join(match_previous(incoming, previous), "row_id", "left").join(versions, "publication_id", "left")
    fresh = stable_id("outcome", "study_id", "identity_key")
    chosen = F.coalesce(F.nullif("explicit_id", F.lit("")), F.col("previous_id"), fresh)
    opened = matched.withColumns({
        "outcome_id": chosen, "extraction_run_id": F.lit(run_id), "extraction_version": F.coalesce("_version", F.lit(0)) + 1,
        "status": F.lit("active"), "supersedes": F.coalesce("previous_run", F.lit("")),
    }).drop("_version", "previous_id", "previous_run")
    opened = keep(opened)
    closed = previous.join(touched, "publication_id", "left_semi").withColumns(
        {"status": F.lit("superseded"), "superseded_by": F.lit(run_id)})
    columns = ["outcome_id", "extraction_run_id", "extraction_version", "status", "supersedes"]
    gone = closed.join(opened.select("outcome_id"), "outcome_id", "left_anti").select(
        "outcome_id", "extraction_run_id", "extraction_version", "status", F.lit("").alias("supersedes"))
    untouched = previous.join(touched, "publication_id", "left_anti").select(
        "outcome_id", "extraction_run_id", "extraction_version", F.lit("active").alias("status"), F.lit("").alias("supersedes"))
    state = opened.select(columns).unionByName(gone).unionByName(untouched)
    return Reingest(opened, closed, state)


def current_rows(rows: DataFrame, state: DataFrame, entity: str, strict: bool = False) -> DataFrame:
    """Active rows of the run the state names, last one per entity.

    Without any state every active row counts.  ``strict`` (outcomes) also drops
    rows without a run; otherwise those stay readable.
    """
    active = rows.filter((F.coalesce(entity, F.lit("")) != "") & (F.coalesce("status", F.lit("active")) == "active"))
    marks = state.select(F.col(entity), F.col("extraction_run_id").alias("_run"), F.coalesce("status", F.lit("active")).alias("_status"))
    no_state = state.agg((F.count(F.lit(1)) == 0).alias("none")).scalar()
    joined = active.join(marks, entity, "left")
    expected, actual = F.coalesce("_run", F.lit("")), F.coalesce("extraction_run_id", F.lit(""))
    differs = (expected != "") & (actual != expected)
    if not strict:
        differs = differs & (actual != "")
    kept = joined.filter(no_state | ((F.col("_status") == "active") & ~differs)).drop("_run", "_status")
    return latest_by(kept, [entity], "seq")


def current_errors(errors: DataFrame, state: DataFrame) -> DataFrame:
    """Errors of the current version of their entity.

    ``state``: entity_type, entity_id, extraction_run_id, extraction_version.
    """
    open_errors = errors.filter(~F.coalesce("status", F.lit("active")).isin(*INACTIVE))
    marks = state.select("entity_type", "entity_id", F.col("extraction_run_id").alias("_run"), F.col("extraction_version").alias("_version"), F.lit(True).alias("_known"))
    joined = open_errors.join(marks, ["entity_type", "entity_id"], "left")
    run = F.coalesce("extraction_run_id", F.lit(""))
    outdated = F.when(run != "", run != F.coalesce("_run", F.lit(""))).otherwise(F.coalesce("_version", F.lit(1)) > 1)
    return joined.filter(F.col("_known").isNull() | ~outdated).drop("_run", "_version", "_known")


def extraction_links(matches: DataFrame, studies: DataFrame, protocol_hash: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Record-publication links, record-study links and errors of unmatched publications.

    ``matches``: publication_id, record_id, link_method, confidence, source_file.
    """
    common = matches.withColumns({"protocol_hash": F.lit(protocol_hash), "status": F.lit("active")})
    by_study = studies.select("study_id", "publication_id").join(common, "publication_id")
    errors = common.filter(F.col("record_id").isNull()).select("publication_id", "source_file", F.lit("record_link_unresolved").alias("error"))
    return common, by_study, errors
