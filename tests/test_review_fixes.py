"""Faults found in review, one test each."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from evistrata.common import in_ranges, number_rows
from evistrata.functions import keys, text
from evistrata.operators import evidence, extraction, quotes, synthesis
from evistrata.sources import ledgers


@pytest.mark.parametrize("outlier", [None, "RCT-1", "zzz"])
def test_ranges_hold_their_share_whatever_the_order(spark, outlier):
    """Hashed and sparse ids, one key with half of the rows, and one value far from all others."""
    ids = spark.range(4000).select(keys.stable_id("study", F.col("id")).alias("key"), (F.col("id") * 1_000_003 * 1_000_003).alias("seq"), (F.col("id") % 2).alias("section"))
    if outlier:
        ids = ids.unionByName(spark.createDataFrame([(outlier, 9 * 10**18, 1)], ids.schema))
    rows = ids.collect()
    for order in ("key", "seq"):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # keep small ranges apart
        try:
            sizes = [r["count"] for r in in_ranges(ids, ["section"], order).groupBy("_range").count().collect()]
        finally:
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        assert len(sizes) >= 4 and max(sizes) <= 2 * len(rows) / len(sizes)
        got = {(r.section, r[order]): r.n for r in number_rows(ids, ["section"], order, "n").collect()}
        want = {}
        for section in (0, 1):
            of = sorted(r[order] for r in rows if r.section == section)
            want |= {(section, value): i + 1 for i, value in enumerate(of)}
        assert got == want
    assert sorted(r.n for r in number_rows(ids, [], "key", "n").collect()) == list(range(1, len(rows) + 1))


def test_numbering_of_few_equal_and_null_orders(spark):
    rows = spark.createDataFrame([("a",), ("a",), (None,), ("ab",), ("",)], "k string")
    assert sorted(r.n for r in number_rows(rows, [], "k", "n").collect()) == [1, 2, 3, 4, 5]
    assert number_rows(rows.filter("false"), [], "k", "n").count() == 0


def test_doi_behind_a_pmid_slot(spark):
    row = spark.createDataFrame([("PMID:12", "https://doi.org/10.1/X"), ("pmid: 3", None)], "a string, b string").select(keys.norm_doi("a", "b").alias("doi")).collect()
    assert [r.doi for r in row] == ["10.1/x", None]


def test_case_folding(spark):
    rows = spark.createDataFrame([("Straße",), ("STRASSE",), ("ΟΔΟΣ",), ("οδος",)], "t string").select(text.coverage_text("t").alias("t")).collect()
    assert rows[0] == rows[1] and rows[2] == rows[3]


def test_deeply_nested_json_is_no_json(spark):
    rows = spark.createDataFrame([("[" * 100_000,), ('x {"a": 1} y',)], "t string").select(text.lenient_json("t").alias("j")).collect()
    assert rows[0].j is None and rows[1].j == '{"a": 1}'


def test_damaged_ledger_fails(spark, tmp_path):
    path = str(tmp_path / "ledger.json")
    with open(path, "w") as file:
        file.write('{"id": 1}\n{"id": \n')
    try:
        ledgers.read_jsonl(spark, path, "id int").collect()
    except Exception as error:
        assert "MALFORMED" in str(error)
    else:
        raise AssertionError("a damaged ledger was read")


def test_known_ids_of_any_shape_are_cited(spark):
    ids = ["RCT-2020-smith-03", "trial-1x", "cohort_1", "-lead", "a.b.c.d.e.f", "end-", "x"]
    known = spark.createDataFrame([(i,) for i in ids], "study_id string")
    texts = spark.createDataFrame([
        (1, "RCT-2020-smith-03, trial-1x; cohort_1 and cohort_99 or pre-cohort_7."), (2, "see (-lead) a.b.c.d.e.f, end- RCT-2020-smith-031"),
        (3, "a-lead yend-z écohort_5 mystudy_1 x"), (4, None), (5, ""),
    ], "section_id int, text string")
    got = sorted(tuple(r) for r in quotes.study_citations(texts, known).collect())
    assert got == sorted([
        (1, "RCT-2020-smith-03", True), (1, "trial-1x", True), (1, "cohort_1", True), (1, "cohort_99", False), (1, "cohort_7", False),
        (2, "-lead", True), (2, "a.b.c.d.e.f", True), (2, "end-", True), (3, "x", True),
    ])


def test_group_ids_do_not_collide_and_ineligible_studies_are_out(spark):
    rows = spark.createDataFrame([("s1", "a|b", "c", "supports", "up"), ("s2", "a", "b|c", "contradicts", "up"), ("s3", "a", "b|c", "supports", "up")],
                                 "study_id string, domain string, timepoint string, support_relation string, effect_direction string")
    groups = evidence.contradiction_groups(rows, ["domain", "timepoint"]).collect()
    assert len({r.group_id for r in groups}) == 2 and sum(r.has_directional_inconsistency for r in groups) == 1
    gated = evidence.contradiction_groups(rows, ["domain", "timepoint"], rows.filter("study_id <> 's2'")).collect()
    assert not any(r.has_directional_inconsistency for r in gated)
    assert evidence.group_members(rows, ["domain"], rows.filter("study_id = 's1'")).count() == 1


def test_stated_claim_flags_stand(spark):
    claims = spark.createDataFrame([("c1", "x", ["s1"], None, ["high"], "causal", [], [], True, None, ["mine"])],
                                   "claim_id string, sentence string, supporting_studies array<string>, scope_status string, claimed_levels array<string>, causal_strength string, "
                                   "asserted_fields array<string>, required_qualifiers array<string>, causal_inflation boolean, animal_to_human boolean, population_levels array<string>")
    studies = spark.createDataFrame([("s1", {"population.level": "low"})], "study_id string, fields map<string,string>")
    out = synthesis.claim_flags(claims, studies)
    assert len(set(out.columns)) == len(out.columns)
    row = out.first()
    assert row.causal_inflation is True and row.animal_to_human is False and row.population_levels == ["mine"]


def test_publication_that_lost_all_outcomes_is_closed(spark):
    previous = spark.createDataFrame([("o1", "s1", "p1", ["k1"], "r1", 1, 0), ("o2", "s2", "p2", ["k2"], "r1", 3, 1)],
                                     "outcome_id string, study_id string, publication_id string, aliases array<string>, extraction_run_id string, extraction_version int, seq bigint")
    incoming = spark.createDataFrame([], "row_id string, study_id string, publication_id string, identity_key string, explicit_id string, aliases array<string>")
    redone = spark.createDataFrame([("p1", 1)], "publication_id string, extraction_version int")
    result = extraction.reingest(previous.withColumn("status", F.lit("active")), incoming, "r2", redone)
    assert {r.outcome_id: r.status for r in result.state.collect()} == {"o1": "superseded", "o2": "active"}


def test_citations_in_a_long_text_and_under_many_shapes(spark, monkeypatch):
    """Candidates of a text were compared with each other, some 25 000 times 25 000 here."""
    words = " ".join(f"w{i}-{i % 7}" for i in range(12_000))
    texts = spark.createDataFrame([(1, f"{words} see a b, t-1.x and t-1-x")], "section_id int, text string")
    known = spark.createDataFrame([("a b",), ("t-1.x",), ("w5-5",), ("w5-6",)], "study_id string")
    started = time.monotonic()
    got = sorted(tuple(r) for r in quotes.study_citations(texts, known).collect())
    assert got == [(1, "a b", True), (1, "t-1.x", True), (1, "w5-5", True)]
    assert time.monotonic() - started < 60
    monkeypatch.setattr(quotes, "GAP_SHAPES", 1)
    assert sorted(tuple(r) for r in quotes.study_citations(texts, known).collect()) == got
