"""Work-lists, run ledger and configuration drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending(work: DataFrame, processed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work not processed under the same key yet."""
    return work.join(processed.select(*keys).distinct(), list(keys), "left_anti")


def config_drift(before: DataFrame, after: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Top-level entries that changed, appeared or went (A27); both: keys, name, value."""
    on = [*keys, "name"]
    old = before.select(*on, F.col("value").alias("old_value"), F.lit(True).alias("_old"))
    new = after.select(*on, F.col("value").alias("new_value"), F.lit(True).alias("_new"))
    joined = old.join(new, on, "full_outer")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed")
    differs = ~F.col("old_value").eqNullSafe(F.col("new_value")) | F.col("_old").isNull() | F.col("_new").isNull()
    return joined.filter(differs).select(*on, "old_value", "new_value", change.alias("change"))


def run_status(ledger: DataFrame) -> DataFrame:
    """Last status and time span of every stage of every run.

    ``ledger``: run_id, stage, status, at, seq.
    """
    return ledger.groupBy("run_id", "stage").agg(
        F.max_by("status", "seq").alias("status"), F.min("at").alias("started_at"),
        F.max_by("at", "seq").alias("updated_at"), F.count(F.lit(1)).alias("entries"))


def output_states(stages: DataFrame, outputs: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Outputs of completed stages with their fingerprint now.

    ``outputs``: run_id, stage, path, fingerprint at completion.
    """
    now = fingerprints.select("path", F.col("fingerprint").alias("_now"))
    done = stages.filter("status = 'completed'").select("run_id", "stage")
    joined = outputs.join(done, ["run_id", "stage"], "left_semi").join(now, "path", "left")
    current = F.coalesce("_now", F.lit("missing"))
    return joined.withColumn("current_fingerprint", current).withColumn("unchanged", current == F.col("fingerprint")).drop("_now")
