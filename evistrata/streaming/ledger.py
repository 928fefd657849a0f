"""Structured Streaming forms of the ledger operators.

The append position decides, not event time, so a late event with an old timestamp
still wins when it was appended last; only R3 with a stated horizon uses event time.
The state of R1, and of R3 without a horizon, grows with the number of keys; on a
cluster use the RocksDB state store.  What the sinks of R1 keep does not grow with the
number of batches: changes are folded into a published snapshot.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evistrata.common import latest_by, remove_folder
from evistrata.functions.values import SCREENING_STAGES
from evistrata.operators.screening import prisma_counts
from evistrata.sources.ledgers import publish, read_published


def latest_decision_stream(events: DataFrame) -> DataFrame:
    """Streaming aggregation of the last appended decision per record and stage."""
    known = events.filter((F.coalesce("record_id", F.lit("")) != "") & F.col("stage").isin(*SCREENING_STAGES))
    return known.groupBy("record_id", "stage").agg(F.max("seq").alias("seq"), F.max_by("decision", "seq").alias("decision"))


def write_changes(
    stream: DataFrame, path: str, checkpoint: str, mode: str = "update", snapshots: str | None = None, every: int = 10,
) -> StreamingQuery:
    """Write every batch's changed rows to its own folder, so a replayed batch replaces itself.

    With ``snapshots`` every ``every``-th batch folds the changes so far into the snapshot there
    (:func:`compact_decisions`); the count goes on after a restart, as batch numbers do.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if snapshots is not None and (number + 1) % every == 0:
            compact_decisions(batch.sparkSession, path, snapshots, number)

    return stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


DECISION_STATE = "record_id string, stage string, seq bigint, decision string"


def _decision_rows(spark: SparkSession, changes: str, snapshots: str | None) -> DataFrame:
    """The published snapshot and the changes after it; one row per key and batch at most."""
    rows = spark.read.schema(f"{DECISION_STATE}, batch bigint").parquet(changes)
    if snapshots is None:
        return rows.drop("batch")
    try:
        kept = read_published(spark, snapshots)
    except FileNotFoundError:
        return rows.drop("batch")
    upto = kept.agg(F.max("upto")).scalar()
    later = rows.filter(F.col("batch") > F.coalesce(upto, F.lit(-1)))
    return later.drop("batch").unionByName(kept.drop("upto"))


def compact_decisions(spark: SparkSession, changes: str, snapshots: str, upto: int) -> None:
    """Publish the latest decisions as of batch ``upto`` (R1); runs a job and removes the change folders it covers.

    The pointer moves after the snapshot is complete and folders go after the pointer has
    moved, so a run that is lost at any point leaves a state that reads the same.  A replayed
    batch that is covered already is written again and not read.
    """
    latest = latest_by(_decision_rows(spark, changes, snapshots), ["record_id", "stage"], "seq")
    publish(latest.withColumn("upto", F.lit(upto).cast("bigint")), snapshots, f"{upto}-{uuid.uuid4().hex}")
    covered = spark.read.schema("batch bigint").option("basePath", changes).parquet(changes)
    for row in covered.filter(F.col("batch") <= upto).select("batch").distinct().collect():
        remove_folder(spark, f"{changes}/batch={row['batch']}")


def current_decisions(spark: SparkSession, changes: str, snapshots: str | None = None) -> DataFrame:
    """Latest decisions from the snapshot, if there is one, and the change folders after it."""
    return latest_by(_decision_rows(spark, changes, snapshots), ["record_id", "stage"], "seq")


def current_prisma(spark: SparkSession, changes: str, snapshots: str | None = None) -> DataFrame:
    """Counts recomputed from the latest state, because a new decision retracts an old one (R2)."""
    return prisma_counts(current_decisions(spark, changes, snapshots))


def distinct_records(
    records: DataFrame, key: str | Sequence[str] = "record_key", event_time: str | None = None, horizon: str | None = None,
) -> DataFrame:
    """First record per key (R3): exact over all time, or within a stated horizon of event time.

    With a horizon a key is forgotten once the latest event time is two horizons past its
    kept record, so state holds recent keys only.  A record within a horizon of a kept one of its
    key is never kept; one further away may be, as a new occurrence.  A record more than a
    horizon older than the latest event time of the batches before is late and dropped.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if event_time is None or horizon is None:
        return records.dropDuplicates(keys)
    return records.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark(keys)


def pending_stream(work: DataFrame, processed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New work whose key is not processed yet (R4); the checkpoint keeps it from being seen twice."""
    return work.join(processed.select(*keys).distinct(), list(keys), "left_anti")
