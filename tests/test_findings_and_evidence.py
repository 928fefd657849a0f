import json

from pyspark.sql import functions as F

from evistrata.common import cut_lineage
from evistrata.functions import findings as N
from evistrata.functions import values as V
from evistrata.operators import evidence as E
from evistrata.operators import extraction as X
from evistrata.operators import findings as ops
from evistrata.plans import all_queries


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def results(spark, *payloads):
    return spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(payloads)], "doc_id bigint, payload string")


def test_relevance(spark):
    df = results(spark, {"relevant": False, "findings": [{"relevance_level": "background"}]}, {"relevant": False, "findings": [{"relevance_level": "irrelevant"}]},
                 {"relevant": True, "findings": [{"relevance_level": "odd"}, "text", None]}, {"findings": None})
    assert rows(ops.document_relevance(df), "doc_id") == [(0, True), (1, False), (2, True), (3, False)]
    got = rows(ops.normalize_findings(df).select("doc_id", "relevance_level", "include_in_main_report"), "doc_id")
    assert got == [(0, "background", False), (2, "direct", True)]


def test_finding_schema(spark):
    raw = {"relevance_level": "direct", "include_in_main_report": False, "relation": {"subject": " A ", "direction": "Sideways"}, "context": ["bad"], "variables": ["plain", {"name": "v", "role": "OUTCOME"}, {"name": "w", "role": "?"}, {"role": "outcome"}],
           "constraints": ["k", "", None], "tags": {"old": "1"}, "topic_tags": {"new": "2", " ": "3", "empty": ""}}
    f = ops.normalize_findings(results(spark, {"relevant": True, "findings": [raw]})).first()
    assert (f.relation.subject, f.relation.direction, f.context.method, f.include_in_main_report) == ("A", "not_applicable", "", False)
    assert [tuple(v) for v in f.variables] == [("plain", "unknown"), ("v", "outcome"), ("w", "unknown")]
    assert f.constraints == ["k"] and f.topic_tags == {"new": "2"}
    text = ops.normalize_findings(results(spark, {"relevant": True, "findings": [raw]})).select(N.metadata_text(F.col("relation"), F.col("context"), F.col("variables"), F.col("topic_tags"))).first()[0]
    assert text == "relation: subject=A | variables: plain(unknown), v(outcome), w(unknown) | topic_tags: new=2"


def test_missing_values_and_rules(spark):
    spec = {"population.summary": {"type": "string", "required": True}, "n": {"type": "integer", "required": True, "validation_rule": {"min": 1}}, "kind": {"type": "enum", "values": ["a", "b"]}, "d": {"type": "string", "default": "x"}}
    df = spark.createDataFrame([({"n": "0", "kind": "c"},)], "fields map<string,string>")
    filled = df.select(V.with_missing_values("fields", spec).alias("f")).first().f
    assert filled == {"n": "0", "kind": "c", "population.summary": "not_reported", "d": "x"}
    errors = df.select(F.inline(V.validation_errors("fields", spec))).collect()
    assert sorted(tuple(e) for e in errors) == [("kind", "expected_enum"), ("n", "below_minimum"), ("population.summary", "required")]


OUTCOME = "outcome_id string, study_id string, domain string, effect_direction string, support_relation string, design string, evidence array<struct<validation_status:string>>"


def test_matrix_and_contradictions(spark):
    o = spark.createDataFrame([("o1", "a", "m", "increase", "supports", "parallel", [("passed",)]), ("o2", "b", "m", "no_change", "contradicts", "crossover", []), ("o3", "b", None, "mixed", "neutral", "crossover", None)], OUTCOME)
    s = spark.createDataFrame([("a", "p", [("a1", "intervention"), ("a2", "control")]), ("b", "p", [("b1", "control")])], "study_id string, publication_id string, arms array<struct<arm_id:string, role:string>>")
    p = spark.createDataFrame([("p", "Paper")], "publication_id string, title string")
    m = E.evidence_matrix(s, p, o, s, per_comparison=True).select("study_id", "comparison_id", "outcome_domains", "quote_statuses")
    assert rows(m, "study_id") == [("a", "a1__vs__a2", ["m"], ["passed"]), ("b", "not_applicable", ["m", "not_reported"], ["not_reported"])]
    groups = E.contradiction_groups(o, ["domain"])
    assert rows(groups.select("group_id", "studies", "has_directional_inconsistency"), "group_id") == [("m", 2, True), ("not_reported", 1, False)]
    candidates = E.moderator_candidates(o, ["domain"], ["design"])
    assert rows(candidates, "value") == [("m", "design", "crossover"), ("m", "design", "parallel")]
    assert rows(E.interpreted(groups, candidates).select("group_id", "interpretation"), "group_id") == [("m", "candidate_explanation_only"), ("not_reported", "observation_only")]


PREVIOUS = "outcome_id string, study_id string, publication_id string, identity_key string, aliases array<string>, extraction_run_id string, extraction_version int, seq bigint, status string"
INCOMING = "row_id string, study_id string, publication_id string, identity_key string, explicit_id string, aliases array<string>"


def test_reingest_keeps_ids_through_reordering_and_closes_lost_outcomes(spark):
    def incoming(*keys, publication="p"):
        return spark.createDataFrame([(f"{publication}{k}", "s", publication, k, "", [k]) for k in keys], INCOMING)

    def as_previous(opened):
        return opened.select("outcome_id", "study_id", "publication_id", "identity_key", "aliases", "extraction_run_id", "extraction_version", F.monotonically_increasing_id().alias("seq"), "status")

    nothing = spark.createDataFrame([], PREVIOUS)
    first = X.reingest(nothing, incoming("metric-a", "metric-b", "metric-c"), "run1").opened
    ids = {r.identity_key: r.outcome_id for r in first.collect()}
    second = X.reingest(as_previous(first), incoming("metric-c", "metric-a"), "run2")
    assert {r.identity_key: r.outcome_id for r in second.opened.collect()} == {k: ids[k] for k in ("metric-a", "metric-c")}
    assert {(r.extraction_version, r.supersedes) for r in second.opened.collect()} == {(2, "run1")}
    state = {r.outcome_id: (r.extraction_run_id, r.status) for r in second.state.collect()}
    assert state[ids["metric-b"]] == ("run1", "superseded") and state[ids["metric-a"]] == ("run2", "active")
    same = X.reingest(as_previous(second.opened), incoming("metric-a", "metric-c"), "run3")
    assert sorted(r.outcome_id for r in same.opened.collect()) == sorted(ids[k] for k in ("metric-a", "metric-c"))
    assert {r.extraction_version for r in same.opened.collect()} == {3}
    other = X.reingest(as_previous(second.opened), incoming("metric-z", publication="q"), "run4")
    assert other.closed.count() == 0 and other.state.filter("status = 'active'").count() == 3


def test_current_rows_follow_the_state(spark):
    ledger = spark.createDataFrame([("o1", "run1", "active", 0), ("o1", "run2", "active", 1), ("o2", "run1", "active", 2), ("o3", "", "active", 3), ("o4", "run2", "superseded", 4)], "outcome_id string, extraction_run_id string, status string, seq bigint")
    state = spark.createDataFrame([("o1", "run2", "active"), ("o2", "run1", "superseded"), ("o3", "run2", "active"), ("o4", "run2", "active")], "outcome_id string, extraction_run_id string, status string")
    assert rows(X.current_rows(ledger, state, "outcome_id", strict=True).select("outcome_id"), "outcome_id") == [("o1",)]
    assert rows(X.current_rows(ledger, state, "outcome_id").select("outcome_id", "seq"), "outcome_id") == [("o1", 1), ("o3", 3)]
    assert X.current_rows(ledger, state.limit(0), "outcome_id").count() == 3


def test_manual_and_failed_locations(spark):
    df = spark.createDataFrame([("s", "o1", "q", True, False), ("s", "o2", "q", False, False), ("s", "o3", "q", False, True)], "study_id string, outcome_id string, quote string, manual_verified boolean, ok boolean")
    judged, errors = X.judge_locations(df, F.col("ok"))
    assert rows(judged.select("outcome_id", "validation_status", "confidence"), "outcome_id") == [("o1", "passed", 1.0), ("o2", "failed", 0.0), ("o3", "passed", 1.0)]
    assert rows(errors.select("outcome_id"), "outcome_id") == [("o2",)]
    assert rows(X.judge_locations(df)[0].select("outcome_id", "validation_status"), "outcome_id") == [("o1", "passed"), ("o2", "unverified"), ("o3", "unverified")]


def test_crosstab_gaps_in_buckets(spark):
    filled = [(r, c) for r in (None, "a", "b", "c") for c in range(25) if r != "c" and (c * 7 + len(r or "")) % 3]
    counts = spark.createDataFrame([(r, f"v{c:02d}", 1) for r, c in filled] + [("c", None, 4)], "row_value string, column_value string, n bigint")
    columns = {f"v{c:02d}" for _, c in filled}
    want = {(r, c) for r in (None, "a", "b", "c") for c in columns} - {(r, f"v{c:02d}") for r, c in filled}
    for size in (1, 4, 1000):
        got = [tuple(r) for r in ops.crosstab_gaps(counts, size=size).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    asked = spark.createDataFrame([(None,), ("c",), ("gone",), ("c",)], "row_value string")
    assert {tuple(r) for r in ops.crosstab_gaps(counts, asked, 4).collect()} == {w for w in want if w[0] in (None, "c")}
    empty = {r.row_value: (r.filled, r.empty) for r in ops.crosstab_gap_counts(counts).collect()}
    assert empty["c"] == (0, len(columns)) and empty["a"] == (sum(r == "a" for r, _ in filled), sum(w[0] == "a" for w in want))
    assert ops.crosstab_gaps(counts.limit(0)).count() == 0 and ops.crosstab_gap_counts(counts.limit(0)).count() == 0


def test_the_state_of_a_reingest_matches_kept_rows_once(spark):
    previous = spark.createDataFrame([(f"id-{k}", "s", "p", k, [k], "run1", 1, i, "active") for i, k in enumerate("abc")], PREVIOUS)
    incoming = spark.createDataFrame([(k, "s", "p", k, "", [k]) for k in "abx"], INCOMING)
    kept = []

    def keep(df):
        kept.append(cut_lineage(df))
        return kept[-1]

    plain, once = X.reingest(previous, incoming, "run2"), X.reingest(previous, incoming, "run2", keep=keep)
    assert len(kept) == 1
    assert sorted(map(tuple, once.state.collect())) == sorted(map(tuple, plain.state.collect()))
    plan = once.state._jdf.queryExecution().optimizedPlan().toString()
    assert "certainty" not in plan and "certainty" in plain.state._jdf.queryExecution().optimizedPlan().toString()


def test_outcome_errors_read_line_items_once_and_build_the_fields_once(spark):
    plan = all_queries()["p57_outcome_spec_errors"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Join" not in plan and plan.count("map_from_entries") == 1
