"""Extension points for user code.

X1 search runners are callables given to ``records.run_searches``; X5 vectors
enter through ``packing.add_vector_scores``; X6 rules through
``rules.categories_from``.  The other points are wrapped here.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evistrata.functions.quotes import folded_text, quote_check
from evistrata.functions.text import strip
from evistrata.operators.synthesis import INSUFFICIENT

QuoteValidator = Callable[[Column, Column], Column]


def default_validator(quote: Column, text: Column) -> Column:
    """Quote check on one row."""
    return quote_check(quote, text, folded_text(strip(quote)), folded_text(text))


def validate_with(rows: DataFrame, validator: QuoteValidator = default_validator, quote: str = "quote", text: str = "text") -> DataFrame:
    """Add ``check`` from a validator of (quote, text) columns."""
    return rows.withColumn("check", validator(F.col(quote), F.col(text)))


def _calls(fn: Callable[..., object], keys: Sequence[str], arguments: Sequence[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            payloads, errors = [], []
            for values in zip(*[batch[a] for a in arguments]):
                try:
                    result = fn(*values)
                    if not isinstance(result, dict):
                        raise TypeError("the function must return a mapping")
                    payloads.append(json.dumps(result, ensure_ascii=False))
                    errors.append(None)
                except Exception as exc:  # one failed document is a row, not a failed job
                    payloads.append(None)
                    errors.append(f"{type(exc).__name__}: {exc}")
            out = batch[list(keys)].copy()
            out["payload"], out["error"] = payloads, errors
            yield out

    return run


def call_per_row(rows: DataFrame, fn: Callable[..., dict], keys: Sequence[str], arguments: Sequence[str]) -> DataFrame:
    """Rows with the JSON payload of ``fn(*arguments)`` or its error."""
    types = dict(rows.dtypes)
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "payload string", "error string"])
    return rows.select(*dict.fromkeys([*keys, *arguments])).mapInPandas(_calls(fn, keys, arguments), schema)


def run_extractor(packs: DataFrame, extractor: Callable[[str, str], dict], key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Extraction payloads and error rows of evidence packs (X3); needs ``pack`` and ``path``."""
    called = call_per_row(packs, extractor, [key], ["pack", "path"])
    errors = called.filter("error is not null").select(key, F.lit("document_extraction_failed").alias("error"), F.col("error").alias("detail"))
    return called.filter("error is null").drop("error"), errors


def write_sections(memos: DataFrame, sections: DataFrame, writer: Callable[[str, str], dict]) -> DataFrame:
    """Section parts by a user writer ``(section_id, items JSON) -> {section_text, claims}``.

    The writer sees one bounded memo at a time and is never called for a section
    without evidence; such a section gets the fixed insufficiency text.
    """
    prepared = memos.select("section_id", "memo_id", F.to_json("items").alias("items"))
    called = call_per_row(prepared, writer, ["section_id", "memo_id"], ["section_id", "items"])
    written = called.select(
        "section_id", "memo_id", F.get_json_object("payload", "$.section_text").alias("section_text"),
        F.get_json_object("payload", "$.claims").alias("claims"), F.lit("available").alias("evidence_status"), F.lit(True).alias("writer_called"), "error")
    empty = sections.select("section_id").join(memos.select("section_id").distinct(), "section_id", "left_anti").select(
        "section_id", F.lit(None).cast("string").alias("memo_id"), F.lit(INSUFFICIENT).alias("section_text"), F.lit("[]").alias("claims"),
        F.lit("insufficient").alias("evidence_status"), F.lit(False).alias("writer_called"), F.lit(None).cast("string").alias("error"))
    return written.unionByName(empty)
