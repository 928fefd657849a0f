"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import gc
import sys
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from evistrata.common import shared_folder
from evistrata.session import configure

#: Rows that a Python operator handles at once, and the bound on an Arrow batch handed to it.
BATCH_ROWS, BATCH_BYTES = 256, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, under the session settings the operators are designed for."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, ``text`` (null as empty) and the named columns."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the folder that all executors share."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder (to ``path``, if named) and read it back.

    Cuts the lineage: what follows reads files that outlive any executor and are the same
    at every reading.  Spark drops the shuffle files of finished work when the driver collects
    its garbage, which may take long; it is asked to here, so that the shuffles of one stage
    do not stay on disk beside those of the next.
    """
    path = path or scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of this library's own intermediate files."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def worker_state(operator: str, part: str = "") -> dict:
    """A dictionary of ``operator`` that the Python worker process keeps across its tasks.

    Spark gives a worker to one stage after the other.  The first use by another operator drops what
    the ones before have kept, so that their caches do not add up in a worker.
    """
    home = sys.modules.setdefault("_evistrata_worker_state", types.ModuleType("_evistrata_worker_state")).__dict__
    if home.get("operator") != operator:
        home["operator"], home["parts"] = operator, {}
        pa.default_memory_pool().release_unused()
    return home["parts"].setdefault(part, {})


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str) -> DataFrame:
    """Apply ``make()``, called once per task, to every Arrow batch; it returns the columns of ``schema``."""
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                columns = work(batch.slice(start, BATCH_ROWS))
                yield pa.RecordBatch.from_arrays(
                    [_array(columns[field.name], field.type) for field in target], schema=target
                )

    return df.mapInArrow(run, schema)


def _array(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)


def filter_texts(docs: DataFrame, make: Callable[[], Callable[[list[str]], list[bool]]]) -> DataFrame:
    """The rows of ``docs`` whose text (null as empty) ``make()``, called once per task, keeps; all columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = make()
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(start, BATCH_ROWS)
                rows = [text or "" for text in part.column("text").to_pylist()]
                yield part.filter(pa.array(keep(rows), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def labelled_sample(rows: DataFrame, label: str, per_label: int) -> list[Row]:
    """At most ``per_label`` rows of each label, chosen by a hash of ``doc_id``, on the driver."""
    return counted_sample(rows, label, per_label)[0]


def counted_sample(rows: DataFrame, label: str, per_label: int) -> tuple[list[Row], dict]:
    """The rows of ``labelled_sample``, and how many rows each label has in all of ``rows``.

    The rows of every label are counted first (map-side), which gives the share of hash values
    to keep; so one task never sees more than about twice the rows asked for.  Rows of one id are
    told apart by a hash of all their values.
    """
    counts = {row[label]: row["count"] for row in rows.filter(F.col(label).isNotNull()).groupBy(label).count().collect()}
    if not counts:
        return [], counts
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    wanted = F.lit(False)
    for value, count in counts.items():
        wanted |= (F.col(label) == F.lit(value)) & (place < F.lit(min(1.0, 2.0 * per_label / count)))
    order = Window.partitionBy(label).orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64(*rows.columns))
    drawn = rows.filter(wanted).withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= per_label).drop("_rank")
    return drawn.collect(), counts
