"""Ledgers, published artifacts and tabular files."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evistrata.common import latest_by
from evistrata.functions.text import strip


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a fixed schema; an absent path is an empty ledger.

    A malformed line fails the read, as a damaged ledger must not pass for a shorter one.
    """
    try:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def append(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Append rows to a ledger."""
    df.write.mode("append").format(fmt).save(path)


def publish(df: DataFrame, base: str, run_id: str, fmt: str = "parquet") -> None:
    """Write an artifact under its run and point to it (S3).

    Nothing that readers hold is overwritten: the pointer row is appended after
    the files of the run are complete.
    """
    df.write.mode("errorifexists").format(fmt).save(f"{base}/runs/run_id={run_id}")
    pointer = df.sparkSession.createDataFrame([(run_id, time.time_ns())], "run_id string, seq bigint")
    pointer.coalesce(1).write.mode("append").json(f"{base}/pointer")


def read_published(spark: SparkSession, base: str, fmt: str = "parquet") -> DataFrame:
    """The artifact the last pointer row names (S3)."""
    pointers = read_jsonl(spark, f"{base}/pointer", "run_id string, seq bigint")
    last = pointers.orderBy(F.col("seq").desc()).limit(1).first()
    if last is None:
        raise FileNotFoundError(f"nothing published under {base}")
    return spark.read.format(fmt).load(f"{base}/runs/run_id={last['run_id']}")


def import_csv(spark: SparkSession, path: str, mapping: Mapping[str, str], required: Sequence[str] = ()) -> DataFrame:
    """CSV columns renamed target=source and trimmed; unknown source columns are an error."""
    lacking = [name for name in required if name not in mapping]
    if lacking:
        raise ValueError(f"CSV mapping requires: {', '.join(sorted(lacking))}")
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if raw.columns and raw.columns[0].startswith("\ufeff"):
        raw = raw.withColumnRenamed(raw.columns[0], raw.columns[0].lstrip("\ufeff"))
    missing = [source for source in mapping.values() if source not in raw.columns]
    if missing:
        raise ValueError(f"CSV columns not found: {', '.join(missing)}")
    return raw.select([strip(F.coalesce(F.col(f"`{source}`"), F.lit(""))).alias(target) for target, source in mapping.items()])


def export_csv(df: DataFrame, columns: Sequence[str], path: str) -> None:
    """Chosen columns as CSV with a header."""
    writer = df.select(*columns).write.mode("errorifexists").option("header", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def markdown_head(columns: Sequence[str]) -> list[str]:
    return ["| " + " | ".join(columns) + " |", "|" + "|".join(["---"] * len(columns)) + "|"]


def markdown_row(columns: Sequence[str]) -> Column:
    """One Markdown table row; line breaks and bars inside cells are escaped."""
    cells = [F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\n"), F.lit("<br>")), F.lit("|"), F.lit("\\|")) for c in columns]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def read_tables(spark: SparkSession, paths: Mapping[str, str] | None = None, jdbc: Mapping[str, str] | None = None, names: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Catalog tables from landed Parquet files or a JDBC database."""
    if paths is not None:
        return {name: spark.read.parquet(path) for name, path in paths.items()}
    return {name: spark.read.format("jdbc").options(**(jdbc or {}), dbtable=name).load() for name in names}


def read_texts(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """Whole text files of a folder by name pattern, with their path."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_results(spark: SparkSession, folder: str, schema: str, whole_files: bool = True) -> DataFrame:
    """Per-document JSON results; unreadable ones are dropped."""
    reader = spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    rows = reader.option("multiLine", whole_files).json(folder)
    return rows.filter("_corrupt is null").drop("_corrupt")


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 per file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.sha2("content", 256).alias("fingerprint"))


def with_fingerprints(wanted: DataFrame, fingerprints: DataFrame, key: str = "path") -> DataFrame:
    """Wanted files with their fingerprint, ``missing`` when absent."""
    return wanted.join(fingerprints, key, "left").withColumn("fingerprint", F.coalesce("fingerprint", F.lit("missing")))


def write_memos(memos: DataFrame, path: str) -> None:
    """Evidence memos as JSON per section."""
    memos.write.mode("errorifexists").partitionBy("section_id").json(path)


def report_lines(issues: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Markdown lines of the audit report per category (S17); categories without issues say so."""
    context = F.to_json(F.struct("claim_id", "entity_id", "side"))
    lines = issues.select("category", F.concat(F.lit("- ["), "check", F.lit("] "), context).alias("line"))
    names = issues.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    silent = names.join(issues.select("category").distinct(), "category", "left_anti").withColumn("line", F.lit("No issues detected."))
    return lines.unionByName(silent)


def write_report(lines: DataFrame, path: str) -> None:
    lines.select("category", F.col("line").alias("value")).write.mode("errorifexists").partitionBy("category").text(path)


def latest_entries(ledger: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """Last entry per key of any ledger."""
    return latest_by(ledger, list(keys), seq)
