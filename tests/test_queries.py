"""Queries beside their reference SQL on the smallest tables.

A spread of queries runs by default; ``EVISTRATA_ALL=1`` runs every one
(``tests/compare.py`` does the same on any data folder).
"""

from __future__ import annotations

import os

import pytest

from evistrata.plans import all_queries, reference_sql
from tests.compare import connection, spark_rows, sql_rows

SF_DIR = "/root/testdata/sf0.001"
SPREAD = (
    "a2_merge_duplicates", "j8_match_extractions", "p10_screen", "a1_collection_coverage", "j11_u4_completeness", "w12_evidence_pack",
    "j21_p27_validated_quotes", "j24_reference_issues", "j23_match_leaves", "w5_reingest_state", "w5_entity_state", "a9_a10_contradiction_groups",
    "j14_section_selection", "j17_contradiction_omissions", "a18_audit_roll_up", "s14_s15_upsert_batches", "r1_streaming_decisions",
)
QUERIES, ORACLE = all_queries(), reference_sql()
NAMES = sorted(ORACLE) if os.environ.get("EVISTRATA_ALL") else SPREAD


@pytest.fixture(scope="module")
def duck():
    return connection(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_reference_sql(spark, duck, name):
    assert spark_rows(QUERIES[name](spark, SF_DIR)) == sql_rows(duck, ORACLE[name])


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
