"""Building blocks shared by the operators.

A single key (a record, a section, a duplicate group) may own a third of the
rows, so nothing here sorts or collects a whole group in one task:

* "latest" and "first seen" are ``max_by``/``min_by`` aggregates, which combine
  on the map side and ship one row per key and map task;
* numbering and lag deal the rows over ranges of (keys, order) whose bounds are
  sampled quantiles, and stitch the ranges together from one small row per key and range;
* top-k uses ``row_number() <= k``, which Spark turns into a per-task group
  limit ahead of the shuffle.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

def as_col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def blank_to_null(value: str | Column) -> Column:
    return F.nullif(as_col(value), F.lit(""))


def first_text(*values: str | Column) -> Column:
    """First value that is neither NULL nor empty."""
    return F.coalesce(*[blank_to_null(v) for v in values])


# --- one row per key ------------------------------------------------------

def latest_by(df: DataFrame, keys: Sequence[str], order: str | Column) -> DataFrame:
    """Row with the greatest ``order`` per key."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), as_col(order)).alias("_row"))
    return picked.select(*keys, "_row.*")


def first_seen(df: DataFrame, key: str | Column, order: str | Column) -> DataFrame:
    """First row per key in ``order``; rows without a key are all kept.

    A keyless row is its own group, identified by its position.
    """
    group = F.when(as_col(key).isNull(), F.struct(F.lit(True).alias("alone"), as_col(order).cast("string").alias("key")))
    group = group.otherwise(F.struct(F.lit(False).alias("alone"), as_col(key).cast("string").alias("key")))
    picked = df.groupBy(group.alias("_group")).agg(F.min_by(F.struct(*df.columns), as_col(order)).alias("_row"))
    return picked.select("_row.*")


# --- numbering along an order --------------------------------------------

def in_ranges(df: DataFrame, keys: Sequence[str], order: str | Column, extra_order: Sequence[Column] = ()) -> DataFrame:
    """``df`` in order of (keys, order), written, with ``_id`` ascending along that order and ``_range`` of the row.

    Spark samples the rows for the bounds of the ranges, so each gets about its share of the
    rows, however the values lie: outliers, hashed ids and a key with a third of the rows
    do not meet in one task.  Rows equal in keys and order stay together.
    """
    by = [*[F.col(k) for k in keys], as_col(order), *extra_order]
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id())
    return written(dealt, "ranges").withColumn("_range", F.shiftright("_id", 33))


def same_row(left: str, right: str, names: Sequence[str]) -> list[Column]:
    """Join condition on ``names`` of two aliases, nulls equal."""
    return [F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}")) for name in names]


def number_rows(df: DataFrame, keys: Sequence[str], order: str | Column, out: str, extra_order: Sequence[Column] = ()) -> DataFrame:
    """``row_number()`` per ``keys`` along ``order`` without one task per group.

    Runs a job: ``df`` is read once, dealt by sampled quantiles of (keys, order) and written to
    the shared folder.  A row's number is its place in its range, less the place of its key's
    first row there, plus the key's rows in the ranges before, known from one count per key and
    range.  Nulls come first.
    """
    dealt = in_ranges(df, keys, order, extra_order)
    heads = dealt.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    joined = dealt.alias("n").join(heads.alias("h"), same_row("n", "h", [*keys, "_range"]))
    return joined.select(*[F.col(f"n.{c}") for c in df.columns], (F.col("n._id") - F.col("h._first") + F.col("h._before") + 1).cast("bigint").alias(out))


def lag_along(df: DataFrame, keys: Sequence[str], seq: str, value: str, out: str) -> DataFrame:
    """``lag(value)`` per ``keys`` along ``seq``, dealt and written like :func:`number_rows`.

    Within a range the row before is the one with the number before; the first row of a key in a
    range takes the last value of the key in its range before.
    """
    dealt = in_ranges(df, keys, seq)
    heads = dealt.groupBy(*keys, "_range").agg(F.min("_id").alias("_first"), F.max_by(value, "_id").alias("_last"))
    heads = heads.withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_range")))
    stepped = dealt.withColumn("_lag", F.lag(value).over(Window.partitionBy("_range").orderBy("_id")))
    joined = stepped.alias("n").join(heads.alias("h"), same_row("n", "h", [*keys, "_range"]))
    previous = F.when(F.col("n._id") == F.col("h._first"), F.col("h._carry")).otherwise(F.col("n._lag"))
    return joined.select(*[F.col(f"n.{c}") for c in df.columns], previous.alias(out))


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key; Spark limits each map task's groups before shuffling."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def batch_number(rank: str | Column, size: int) -> Column:
    """1-based batch of a 1-based rank."""
    if size < 1:
        raise ValueError("batch size must be positive")
    return (F.floor((as_col(rank) - 1) / F.lit(size)) + 1).cast("bigint")


def ordered(df: DataFrame, order: Sequence[str | Column], limit: int | None = None) -> DataFrame:
    """Global order, optionally the first ``limit`` rows."""
    out = df.orderBy(*[as_col(c) for c in order])
    return out if limit is None else out.limit(limit)


def first_n(values: str | Column, n: int) -> Column:
    """First ``n`` array entries for display."""
    return F.slice(as_col(values), 1, n)


def distinct_first_terms(values: Column) -> Column:
    """Array of stripped, non-empty entries, each once, in first-seen order."""
    stripped = F.transform(values, lambda v: F.trim(v))
    return F.array_distinct(F.filter(stripped, lambda v: v.isNotNull() & (v != "")))


# --- lineage and shared scratch space -------------------------------------

def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` when the cluster names one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if spark.sparkContext.getCheckpointDir() is not None:
        return spark.sparkContext.getCheckpointDir()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return tempfile.mkdtemp(prefix="evistrata-")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back (runs a job); the files outlive any executor."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of files this library wrote and no longer reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder (runs a job).

    Kept as Parquet and not as a checkpoint: a checkpoint holds whole serialised rows, all of
    which every reader decodes; of the files a reader takes the columns it names, and Spark
    knows their size when it plans joins.
    """
    return written(df, "kept")
