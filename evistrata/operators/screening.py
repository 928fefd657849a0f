"""Screening ledger."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evistrata.common import blank_to_null, lag_along, latest_by
from evistrata.functions.values import SCREENING_DECISIONS, SCREENING_STAGES

# Decisions that finish a stage, and the enforcement levels.
FINAL_DECISIONS = ("include", "exclude", "duplicate")
ENFORCEMENT_LEVELS = ("required", "optional", "disabled")


def check_level(value: str, allowed: Sequence[str], what: str) -> str:
    if value not in allowed:
        raise ValueError(f"{what} must be one of {sorted(allowed)}")
    return value


def latest_decisions(ledger: DataFrame) -> DataFrame:
    """Last appended decision per record and stage; timestamps do not matter.

    All columns of ``ledger`` travel with the decision: select the needed ones first.
    """
    known = ledger.filter((F.coalesce("record_id", F.lit("")) != "") & F.col("stage").isin(*SCREENING_STAGES))
    return latest_by(known, ["record_id", "stage"], "seq")


def with_previous_decision(ledger: DataFrame) -> DataFrame:
    """Decision that held before each event (W2); runs a job, see :func:`lag_along`."""
    return lag_along(ledger, ["record_id", "stage"], "seq", "decision", "previous_decision")


def decision_fault(reason_codes: Sequence[str]) -> Column:
    """Why a decision row may not enter the ledger, NULL when it may."""
    reason = blank_to_null("reason_code")
    ai = blank_to_null("ai_recommendation")
    declared = reason.isin(*reason_codes) if reason_codes else F.lit(False)
    return (
        F.when(~F.coalesce(F.col("stage").isin(*SCREENING_STAGES), F.lit(False)), "unknown_stage")
        .when(~F.coalesce(F.col("decision").isin(*SCREENING_DECISIONS), F.lit(False)), "unknown_decision")
        .when(F.col("decision").isin("exclude", "duplicate") & reason.isNull(), "reason_required")
        .when(reason.isNotNull() & ~declared, "reason_not_declared")
        .when(ai.isNotNull() & ~ai.isin(*SCREENING_DECISIONS), "invalid_ai_recommendation")
    )


def split_decisions(events: DataFrame, reason_codes: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rejected rows with their fault."""
    judged = events.withColumn("fault", decision_fault(reason_codes))
    return judged.filter("fault is null").drop("fault"), judged.filter("fault is not null")


def prisma_counts(latest: DataFrame) -> DataFrame:
    """Records per stage and decision, in wide form (A5)."""
    per_decision = [F.count_if(F.col("decision") == d).alias(d) for d in SCREENING_DECISIONS]
    return latest.groupBy("stage").agg(F.count(F.lit(1)).alias("total"), *per_decision)


def identified_unique(latest: DataFrame) -> DataFrame:
    return latest.agg(F.countDistinct("record_id").alias("identified_unique"))


def completeness(universe: DataFrame, latest: DataFrame) -> DataFrame:
    """State of every record of the search universe or the ledger.

    ``title_state`` is complete, uncertain, missing or illegal; ``fulltext_state``
    the same for records included on title, else NULL; ``illegal`` marks unknown
    ids, unknown decisions and full-text decisions without a title inclusion.
    """
    def decision(stage: str) -> Column:
        return F.max(F.when(F.col("stage") == stage, F.coalesce("decision", F.lit("")))).alias(stage)

    per_record = latest.groupBy("record_id").agg(decision("title_abstract"), decision("fulltext"))
    known = universe.select("record_id").filter("record_id <> ''").distinct().withColumn("_known", F.lit(True))
    both = known.join(per_record, "record_id", "full_outer")
    in_universe = F.coalesce("_known", F.lit(False))

    def state(column: str) -> Column:
        return (
            F.when(F.col(column).isNull(), "missing").when(F.col(column).isin(*FINAL_DECISIONS), "complete")
            .when(F.col(column) == "uncertain", "uncertain").otherwise("illegal")
        )

    included = in_universe & F.coalesce(F.col("title_abstract") == "include", F.lit(False))
    bad_vocabulary = F.coalesce(~F.col("title_abstract").isin(*SCREENING_DECISIONS), F.lit(False)) | F.coalesce(
        ~F.col("fulltext").isin(*SCREENING_DECISIONS), F.lit(False))
    orphan_fulltext = in_universe & F.col("fulltext").isNotNull() & ~included
    return both.select(
        "record_id", in_universe.alias("in_universe"), "title_abstract", "fulltext",
        F.when(in_universe, state("title_abstract")).alias("title_state"),
        F.when(included, state("fulltext")).alias("fulltext_state"),
        included.alias("title_included"),
        (included & F.coalesce(F.col("fulltext") == "include", F.lit(False))).alias("fulltext_included"),
        (~in_universe | bad_vocabulary | orphan_fulltext).alias("illegal"),
    )


def incomplete_records(states: DataFrame) -> DataFrame:
    """Records with a missing, uncertain or illegal state."""
    open_states = ("missing", "uncertain")
    still_open = F.col("title_state").isin(*open_states) | F.col("fulltext_state").isin(*open_states) | F.col("illegal")
    return states.filter(F.coalesce(still_open, F.col("illegal")))
