"""Named queries over the given tables, one module per subject."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evistrata.plans.registry import ORACLE, QUERIES

SUBJECTS = (
    "records", "catalog", "screening", "packing", "quotes", "findings", "extraction", "versions", "evidence", "synthesis", "audit", "sources",
)


def _load() -> None:
    for name in SUBJECTS:
        importlib.import_module(f"evistrata.plans.{name}")


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(QUERIES)


def reference_sql() -> dict[str, str]:
    _load()
    return dict(ORACLE)
