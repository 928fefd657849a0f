"""Registry of the named queries and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evistrata.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the equivalent statement on the same tables."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


#: Session setting: tasks that read ``documents``.  Off by default; a scan of many row groups needs none.
DOCUMENT_TASKS = "evistrata.documents.tasks"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, under the session settings the operators are designed for.

    A file of one row group is read by one task.  Where ``DOCUMENT_TASKS`` names a number, the
    rows of ``documents`` are dealt over so many tasks first.
    """
    configure(spark)
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    tasks = spark.conf.get(DOCUMENT_TASKS, "") if name == "documents" else ""
    return rows.repartition(int(tasks)) if tasks else rows
