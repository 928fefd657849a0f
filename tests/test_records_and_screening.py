import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from evistrata.common import first_seen, lag_along, number_rows
from evistrata.functions import rules as R
from evistrata.operators import eligibility as gate
from evistrata.operators import records as ops
from evistrata.operators import screening
from evistrata.sources.searches import search_runner
from evistrata.streaming import ledger as stream

RULES = {"categories": {
    "topic": {"terms": ["retrieval", "gpt"], "weight": 3, "required_for_tier_a": True},
    "method": {"terms": ["vector search"], "weight": 2, "required_for_tier_a": True},
    "domain": {"terms": ["cooking"], "weight": -5},
}}


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def search_rows(spark, data):
    return spark.createDataFrame(data, "seq bigint, title string, doi string, extra string, search_id string, run_id string, raw_record_id string")


def test_duplicates_merge_with_provenance(spark):
    raw = search_rows(spark, [
        (0, "Same record", "10.1/example", "", "one", "r", "a"), (1, "Same record again", "10.1/example", "filled", "two", "r", "b"), (2, "Unique", None, None, "two", "r", "c"),
        (3, "unique!", None, "x", "two", "r", "d")])
    keyed = ops.with_record_key(raw)
    merged = ops.merge_duplicates(keyed, ["title", "doi", "extra"])
    assert rows(merged.select("title", "extra", "members"), "title") == [("Same record", "filled", 2), ("Unique", "x", 2)]
    assert rows(ops.provenance(keyed).groupBy("record_id").count().select("count"), "count") == [(1,), (2,)]
    assert sorted(r.raw_record_id for r in ops.duplicate_members(keyed).collect()) == ["a", "b", "c", "d"]
    again = ops.merge_duplicates(ops.with_record_key(merged.select(F.col("first_seq").alias("seq"), "title", "doi", "extra", F.lit("z").alias("raw_record_id"))), ["title", "doi", "extra"])
    assert rows(again.select("record_id"), "record_id") == rows(merged.select("record_id"), "record_id")


def test_failed_searches_do_not_lose_the_others(spark):
    found = spark.createDataFrame([(0, "A", None), (1, "B", "10.1/b")], "seq bigint, title string, doi string")
    plan = [{"id": "one", "source": "ok", "query": "q"}, {"id": "two", "source": "gone", "query": "q"}, {"id": "three", "source": "ok", "query": ""}, {"id": "off", "source": "ok", "query": "q", "enabled": False}]
    raw, log = ops.run_searches(spark, plan, {"ok": lambda q, n: found}, "run")
    assert raw.count() == 2
    assert rows(log.select("search_id", F.col("error").isNotNull()), "search_id") == [("one", False), ("three", True), ("two", True)]
    with pytest.raises(ValueError):
        ops.run_searches(spark, [], {}, "run")
    seeded, _ = ops.run_searches(spark, [], {}, "run", seeds=found.limit(1))
    assert seeded.count() == 1


def test_a_search_that_breaks_off_costs_only_itself(spark):
    def fetch(query, limit, page):
        for i in range(limit):
            if query == "broken" and page == "p2" and i == 2:
                raise OSError("connection lost")
            yield {"title": f"{query} {page} {i}", "doi": None if i else f"10.1/{page}", "more": "x"}

    service = search_runner(spark, fetch, "title string, doi string, year int", ["p1", "p2"])
    other = spark.createDataFrame([(0, "A", 2020)], "seq bigint, title string, year int").withColumn("doi", F.lit("10.1/p1"))
    clash = other.withColumn("year", F.array("year"))
    plan = [{"id": i, "source": s, "query": q} for i, s, q in (
        ("one", "service", "good"), ("two", "service", "broken"), ("three", "list", "q"), ("four", "clash", "q"), ("five", "table", "q"))]
    runners = {"service": service, "list": lambda q, n: [{"title": "A"}], "clash": lambda q, n: clash, "table": lambda q, n: other}
    raw, log = ops.run_searches(spark, plan, runners, limit=4, protocol_hash="h")
    done = {r.search_id: r for r in log.collect()}
    assert {k: (r.raw_count, r.error is None) for k, r in done.items()} == {
        "one": (8, True), "two": (0, False), "three": (0, False), "four": (0, False), "five": (1, True)}
    assert "connection lost" in done["two"].error and done["three"].error.startswith("TypeError")
    assert len({r.run_id for r in done.values()}) == 5 and all(r.duration_seconds >= 0 and r.protocol_hash == "h" for r in done.values())
    assert rows(raw.filter("search_id = 'one'").select("title", "year"), "seq")[:2] == [("good p1 0", None), ("good p1 1", None)]
    keyed = ops.with_record_key(raw)
    assert [tuple(r) for r in ops.run_summary(log, keyed).collect()] == [(9, 8, 3)]
    summary = {r.search_id: (r.runs, r.failures, r.raw_count, r.unique_count) for r in ops.search_summary(log, keyed).collect()}
    assert summary["one"] == (1, 0, 8, 8) and summary["two"] == (1, 1, 0, 0)


def test_screening_tiers(spark):
    data = [(1, "retrieval with vector search", 2025, 0), (2, "retrieval", 2012, 1), (3, "retrieval cooking vector search", 2018, 20), (4, "acceptance of gptlike systems", 2025, 9), (5, "the gpt model", 2025, 9)]
    df = spark.createDataFrame(data, "id int, blob string, year int, citations int")
    s = df.select("id", R.screen("blob", "year", "citations", R.categories_from(RULES)).alias("s")).orderBy("id").select("s.*").collect()
    assert [(r.keep, r.tier, r.score) for r in s] == [(True, "A", 5), (False, "C", 1), (False, "A", 0), (False, "C", 0), (False, "C", 3)]
    assert s[2].reasons[-1] == "exclude:cooking"
    plain = df.select(R.screen("blob", "year", "citations", []).alias("s")).select("s.keep", "s.score", "s.tier").distinct().collect()
    assert [tuple(r) for r in plain] == [(True, 0, "B")]


def ledger(spark, data):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "seq bigint, record_id string, stage string, decision string, reason_code string, ai_recommendation string")


def test_ledger_order_decides(spark):
    events = ledger(spark, [("R1", "title_abstract", "uncertain", None, None), ("R1", "title_abstract", "include", None, "exclude"), ("R1", "fulltext", "include", None, None)])
    assert rows(screening.latest_decisions(events).select("stage", "decision"), "stage") == [("fulltext", "include"), ("title_abstract", "include")]
    assert rows(screening.with_previous_decision(events).select("seq", "previous_decision"), "seq") == [(0, None), (1, "uncertain"), (2, None)]


def test_invalid_decisions_are_rejected(spark):
    events = ledger(spark, [("R1", "title_abstract", "include", None, None), ("R2", "title_abstract", "exclude", "wrong", None), ("R3", "fulltext", "exclude", None, None), ("R4", "later", "include", None, None),
                            ("R5", "fulltext", "perhaps", None, None), ("R6", "fulltext", "exclude", "undeclared", None), ("R7", "fulltext", "include", None, "hm")])
    good, bad = screening.split_decisions(events, ["wrong"])
    assert [r.record_id for r in good.orderBy("seq").collect()] == ["R1", "R2"]
    assert [r.fault for r in bad.orderBy("seq").collect()] == ["reason_required", "unknown_stage", "unknown_decision", "reason_not_declared", "invalid_ai_recommendation"]


def test_completeness_partitions_the_universe(spark):
    universe = spark.createDataFrame([(f"R{i}",) for i in range(1, 7)], "record_id string")
    events = ledger(spark, [("R1", "title_abstract", "include", None, None), ("R1", "fulltext", "include", None, None), ("R2", "title_abstract", "uncertain", None, None), ("R3", "title_abstract", "exclude", "w", None),
                            ("R3", "fulltext", "include", None, None), ("R4", "title_abstract", "include", None, None), ("X", "title_abstract", "include", None, None), ("R5", "title_abstract", "odd", None, None)])
    s = {r.record_id: r for r in screening.completeness(universe, screening.latest_decisions(events)).collect()}
    assert {k: (v.title_state, v.fulltext_state, v.illegal) for k, v in s.items()} == {
        "R1": ("complete", "complete", False), "R2": ("uncertain", None, False), "R3": ("complete", None, True), "R4": ("complete", "missing", False),
        "R5": ("illegal", None, True), "R6": ("missing", None, False), "X": (None, None, True)}


def test_gate_modes(spark):
    studies = spark.createDataFrame([("s1", "p1"), ("s2", "p2"), ("s3", "p3")], "study_id string, publication_id string")
    links = spark.createDataFrame([(0, "s1", "R1", "active"), (1, "s2", "R1", "active"), (2, "s2", "R2", "active"), (3, "s2", "R1", "superseded")], "seq bigint, study_id string, record_id string, status string")
    universe = spark.createDataFrame([("R1",), ("R2",), ("R9",)], "record_id string")
    none = screening.latest_decisions(ledger(spark, []))
    some = screening.latest_decisions(ledger(spark, [("R1", "fulltext", "include", None, None), ("R9", "fulltext", "include", None, None), ("R9", "title_abstract", "include", None, None)]))

    def eligible(latest, mode):
        return sorted(r.study_id for r in gate.resolve_eligibility(studies, links, latest, universe, mode).studies.filter("eligible").collect())

    assert eligible(none, "optional") == ["s1", "s2", "s3"] and eligible(some, "disabled") == ["s1", "s2", "s3"]
    assert eligible(some, "optional") == ["s1"] and eligible(some, "required") == [] and eligible(none, "required") == []
    records = gate.resolve_eligibility(studies, links, some, universe, "required").included_records
    assert rows(records, "record_id") == [("R9", False)]
    with pytest.raises(ValueError):
        gate.resolve_eligibility(studies, links, some, universe, "maybe")


def test_link_cascade_takes_single_matches_only(spark):
    schema = "record_id string, doi string, pmid string, title string, source_file string, seq bigint"
    records = spark.createDataFrame([("r1", "10.1/a", "", "Twice", "x/a.pdf", 0), ("r2", None, "7", "Twice", "b.pdf", 1), ("r3", None, "", "Only", "b.pdf", 2)], schema)
    ext = spark.createDataFrame([
        ("e0", "given", None, "", "", ""), ("e1", "", "10.1/a", "", "", ""), ("e2", "", None, "7", "", ""), ("e3", "", None, "", "only!", ""), ("e4", "", None, "", "Twice", "dir/b.pdf"),
        ("e5", "", None, "", "", "only.pdf"), ("e6", "", None, "", "none", "none.pdf")], "extraction_id string, source_record_id string, doi string, pmid string, title string, source_file string")
    got = rows(ops.match_extractions(ext, records).select("extraction_id", "record_id", "link_method"), "extraction_id")
    assert got == [("e0", "given", "explicit_input"), ("e1", "r1", "doi"), ("e2", "r2", "pmid"), ("e3", "r3", "title"), ("e4", "r2", "manual"), ("e5", "r3", "title"), ("e6", None, "unlinked")]


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_dealt_windows_equal_plain_ones_on_a_hot_key(spark, parts):
    rng = random.Random(parts)
    data = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(20)}", seq, rng.choice("abc")) for seq in rng.sample(range(5000), 1500)]
    df = spark.createDataFrame(data, "key string, seq bigint, value string").repartition(parts)
    last, expected = {}, []
    for key, seq, value in sorted(data, key=lambda r: r[1]):
        number, previous = last.get(key, (0, None))
        expected.append((key, seq, value, number + 1, previous))
        last[key] = (number + 1, value)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # keep small ranges apart
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        lagged = lag_along(df, ["key"], "seq", "value", "previous")
        numbered = number_rows(lagged, ["key"], "seq", "n")
        overall = number_rows(df, [], "seq", "n")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert rows(numbered.select("key", "seq", "value", "n", "previous"), "seq") == sorted(expected, key=lambda r: r[1])
    assert [r.n for r in overall.orderBy("seq").collect()] == list(range(1, 1501))


def test_first_seen_keeps_rows_without_key(spark):
    df = spark.createDataFrame([(0, None), (1, "a"), (2, None), (3, "a"), (4, "1")], "seq bigint, key string")
    assert [r.seq for r in first_seen(df, "key", "seq").orderBy("seq").collect()] == [0, 1, 2, 4]


def test_stream_equals_batch_with_late_timestamps(spark, tmp_path):
    source = str(tmp_path / "in")
    first = ledger(spark, [("R1", "fulltext", "exclude", "w", None), ("R2", "fulltext", "include", None, None)])
    later = ledger(spark, [("R1", "fulltext", "include", None, None)]).withColumn("seq", F.col("seq") + 10)
    states = []
    for part in (first, later):
        part.coalesce(1).write.mode("append").parquet(source)
        events = spark.readStream.schema(part.schema).parquet(source)
        stream.write_changes(stream.latest_decision_stream(events), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        states.append(rows(stream.current_decisions(spark, str(tmp_path / "out")).select("record_id", "decision"), "record_id"))
    assert states == [[("R1", "exclude"), ("R2", "include")], [("R1", "include"), ("R2", "include")]]
    batch = screening.prisma_counts(screening.latest_decisions(spark.read.parquet(source)))
    assert rows(stream.current_prisma(spark, str(tmp_path / "out")), "stage") == rows(batch, "stage")


def test_snapshots_bound_the_change_folders_over_restarts(spark, tmp_path):
    source, out, state, cp = (str(tmp_path / n) for n in ("in", "out", "state", "cp"))
    rng = random.Random(3)
    for batch in range(7):
        # Rows of earlier positions arrive late and must not win.
        events = [(f"R{rng.randrange(5)}", "fulltext", rng.choice(["include", "exclude"]), rng.randrange(10_000) * 7 + batch) for _ in range(20)]
        spark.createDataFrame(events, "record_id string, stage string, decision string, seq bigint").coalesce(1).write.mode("append").parquet(source)
        stream_in = spark.readStream.schema("record_id string, stage string, decision string, seq bigint").parquet(source)
        stream.write_changes(stream.latest_decision_stream(stream_in), out, cp, snapshots=state, every=3).awaitTermination()
        whole = spark.read.parquet(source).groupBy("record_id", "stage").agg(F.max_by("decision", "seq").alias("decision"))
        got = rows(stream.current_decisions(spark, out, state).select("record_id", "decision"), "record_id")
        assert got == rows(whole.select("record_id", "decision"), "record_id")
        assert len(list((tmp_path / "out").glob("batch=*"))) <= 3
    # A batch that is replayed after its snapshot was published is not read again.
    spark.createDataFrame([("R0", "fulltext", 10**9, "odd")], stream.DECISION_STATE).write.parquet(f"{out}/batch=2")
    assert rows(stream.current_decisions(spark, out, state).select("record_id", "decision"), "record_id") == got


def test_a_horizon_forgets_old_keys_and_drops_late_rows(spark, tmp_path):
    source, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = "record_key string, ts timestamp, n int"
    day = [datetime(2024, 1, i + 1) for i in range(31)]
    batches = [
        [("a", day[0], 1), ("b", day[1], 2)],
        [("a", day[2], 3), ("c", day[3], 4)],                      # a: within the horizon of its kept row
        [("d", day[20], 5)],                                      # moves the watermark past a, b, c
        [("a", day[25], 6), ("b", day[10], 7), ("d", day[21], 8)],  # a anew; b is late; d repeats
    ]
    held = []
    for part in batches:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        kept = stream.distinct_records(spark.readStream.schema(schema).parquet(source), "record_key", "ts", "3 days")
        run = stream.write_changes(kept, out, cp, "append")
        run.awaitTermination()
        held.append(run.lastProgress.stateOperators[0].numRowsTotal)
    assert rows(spark.read.parquet(out).select("n"), "n") == [(1,), (2,), (4,), (5,), (6,)]
    assert held[1] == 3 and held[-1] < 3
