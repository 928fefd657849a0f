from pyspark.sql import functions as F

from evistrata.operators import audit as A
from evistrata.operators import extend
from evistrata.operators import quotes as Q
from evistrata.operators import synthesis as S


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def ten_studies(spark):
    s = spark.createDataFrame([(f"study_{i}", f"p{i}", {"design": "cohort"}) for i in range(10)], "study_id string, publication_id string, fields map<string,string>")
    o = spark.createDataFrame([(f"o{i}", f"study_{i}", "target", "increase" if i % 2 else "decrease", "supports" if i % 2 else "contradicts", i) for i in range(10)],
                              "outcome_id string, study_id string, domain string, effect_direction string, support_relation string, seq bigint")
    return s, o


def test_section_rules(spark):
    s, o = ten_studies(spark)
    sections = [{"section_id": "all", "rule": {"include_all_studies": True}}, {"section_id": "some", "rule": {"outcome_domains": ["target"], "support_relations": ["supports"], "study_field_equals": {"design": "cohort"}}},
                {"section_id": "none", "rule": {"no_evidence": True}}, {"section_id": "bare", "rule": {}}, {"section_id": "odd", "rule": {"colour": "red"}}, {"section_id": "ids", "rule": {"study_ids": ["study_3"]}}]
    selection = S.select_sections(s, o, sections)
    counts = dict(rows(selection.filter("selected").groupBy("section_id").count(), "section_id"))
    assert counts == {"all": 10, "some": 5, "ids": 1}
    reasons = {r.section_id: r.reasons for r in selection.filter("study_id = 'study_0'").collect()}
    assert reasons["some"] == ["outcome_domain_not_matched", "support_relation_not_matched"]
    assert (reasons["none"], reasons["bare"], reasons["odd"]) == (["no_evidence_requested"], ["no_selection_rule"], ["no_supported_filter"])
    memos = S.evidence_memos(S.section_members(selection), o, size=4)
    assert rows(memos.filter("section_id = 'all'").select("memo_id", F.size("items")), "memo_id") == [("all_batch_001", 4), ("all_batch_002", 4), ("all_batch_003", 2)]
    assert A.dropped_evidence(s, S.memo_studies(memos)).count() == 0
    calls = extend.write_sections(memos, selection.select("section_id").distinct(), lambda section, items: {"section_text": section, "claims": []})
    assert rows(calls.filter("not writer_called").select("section_id", "evidence_status"), "section_id") == [(n, "insufficient") for n in ("bare", "none", "odd")]


SECTION = "section_id string, section_text string, claims array<struct<sentence:string, study_ids:array<string>, citations:array<string>>>"


def test_section_coverage(spark):
    sentence = "The value rose in [study_1]."
    data = [("ok", sentence, [(sentence, ["study_1"], None)]), ("open", sentence + " And more happened.", [(sentence, ["study_1"], None)]), ("token", sentence + " See study_outside.", [(sentence + " See study_outside.", ["study_1"], None)]),
            ("zero", "Nothing [study_1].", []), ("empty", S.INSUFFICIENT, [])]
    sections = spark.createDataFrame(data, SECTION)
    members = spark.createDataFrame([(n, "study_1") for n in ("ok", "open", "token", "zero")], "section_id string, study_id string")
    errors = S.section_coverage_errors(sections, members, members.select("study_id"))
    got = {}
    for r in errors.collect():
        got.setdefault(r.section_id, set()).add(r.error)
    assert got == {"open": {"substantive_sentence_not_mapped"}, "token": {"section_citation_not_in_claim_map", "unknown_study_citation_in_text"},
                   "zero": {"nonempty_section_zero_claims", "substantive_sentence_not_mapped", "section_citation_not_in_claim_map"}}
    assert rows(S.section_coverage(sections, errors).select("section_id", "coverage_status"), "section_id") == [("empty", "passed"), ("ok", "passed"), ("open", "failed"), ("token", "failed"), ("zero", "failed")]


def test_claim_flags(spark):
    fields = {"protocol.scope_status": "adjacent", "population.level": "configured-lower", "study.causal_strength": "associational"}
    studies = spark.createDataFrame([("s1", fields)], "study_id string, fields map<string,string>")
    claims = spark.createDataFrame([("c1", "It Was Late.", ["s1"], "unclear", ["configured-higher"], "causal", ["dose"], ["was", "never"])],
                                   "claim_id string, sentence string, supporting_studies array<string>, scope_status string, claimed_levels array<string>, causal_strength string, asserted_fields array<string>, required_qualifiers array<string>")
    f = S.claim_flags(claims, studies, ["configured-lower", "configured-higher"], [("configured-lower", "configured-higher")]).first()
    assert (f.protocol_scope_status, f.population_overgeneralization, f.animal_to_human, f.causal_inflation, f.unreported_field_claims, f.missing_required_qualifiers) == ("adjacent", True, True, True, ["dose"], ["never"])


CLAIM = ("claim_id string, section_id string, supporting_studies array<string>, contradicting_studies array<string>, supporting_outcomes array<string>, contradicting_outcomes array<string>, "
         "supporting_evidence_refs array<string>, contradicting_evidence_refs array<string>, relation_explanation string, support_level string, protocol_scope_status string, population_overgeneralization boolean, "
         "animal_to_human boolean, causal_inflation boolean, unreported_field_claims array<string>, missing_required_qualifiers array<string>")


def audit(spark, claims, filters=None):
    """All claim checks over two studies with one outcome and evidence location each."""
    c = spark.createDataFrame([(*x, "supported", "inside", False, False, False, [], []) for x in claims], CLAIM)
    o = spark.createDataFrame([("o1", "s1", "target", "increase", "supports"), ("o2", "s2", "other", "decrease", "contradicts")], "outcome_id string, study_id string, domain string, effect_direction string, support_relation string")
    e = spark.createDataFrame([("e1", "s1", "o1", "passed"), ("e2", "s2", "o2", "failed")], "evidence_id string, study_id string, outcome_id string, validation_status string")
    studies = spark.createDataFrame([("s1", True, True), ("s2", False, False)], "study_id string, eligible boolean, linked boolean")
    members = spark.createDataFrame([("S1", "s1")], "section_id string, study_id string")
    former_o = spark.createDataFrame([("old", "superseded", "run1"), ("lost", "active", "run1")], "outcome_id string, status string, extraction_run_id string")
    former_e = spark.createDataFrame([("olde", "o1", "superseded", "run1"), ("loste", "o1", "active", "run1")], "evidence_id string, outcome_id string, status string, extraction_run_id string")
    state = o.select("outcome_id", F.lit("run2").alias("extraction_run_id"))
    history = A.History(former_o, former_e, state, "run2")
    oi, ro = A.outcome_issues(c, o, history, filters or {})
    ei, re = A.evidence_issues(c, e, history)
    issues = A.union_issues([A.claim_issues(c), A.study_issues(c, studies, members), oi, ei, A.linkage_issues(c, ro, re)])
    return {r.check for r in issues.collect()}, issues


def claim(studies=("s1",), outcomes=("o1",), refs=("e1",), against=((), (), ()), section="S1", note=""):
    return ("c", section, list(studies), list(against[0]), list(outcomes), list(against[1]), list(refs), list(against[2]), note)


def test_clean_claim_has_no_issue(spark):
    found, issues = audit(spark, [claim()])
    assert found == set()
    assert tuple(A.audit_status(issues).first()) == (0, "passed", 0)


def test_single_faults(spark):
    cases = {
        "unsupported_claim": claim((), (), ()), "duplicate_study_counting": claim(("s1", "s1")), "citation_key_resolution_failure": claim(("s1", "nobody")),
        "citation_to_excluded_study": claim(("s1", "s2"), ("o1", "o2"), ("e1", "e2")), "supporting_study_outside_section": claim(section="S9"), "supporting_outcome_unresolved": claim(outcomes=("zzz",)),
        "superseded_outcome_reference": claim(outcomes=("o1", "old")), "stale_extraction_reference": claim(outcomes=("o1", "lost")), "superseded_evidence_reference": claim(refs=("e1", "olde")),
        "supporting_evidence_unresolved": claim(refs=("ghost",)), "supporting_evidence_wrong_study": claim(refs=("e1", "e2")), "supporting_evidence_wrong_outcome": claim(refs=("e1", "e2")),
        "supporting_outcome_wrong_study": claim(outcomes=("o1", "o2")), "support_relation_mismatch": claim(against=(("s1",), ("o1",), ("e1",))), "supporting_outcome_without_evidence": claim(("s1", "s2"), ("o1", "o2"), ("e1",)),
        "outcome_evidence_coverage_incomplete": claim(("s1", "s2"), ("o1", "o2"), ("e1",)), "supporting_study_without_outcome": claim(("s1", "s2"), ("o1",), ("e1",)), "invalid_quote": claim(("s1", "s2"), ("o1", "o2"), ("e1", "e2")),
        "citation_to_unlinked_study": claim(("s1", "s2"), ("o1", "o2"), ("e1", "e2")),
    }
    for check, fault in cases.items():
        assert check in audit(spark, [fault])[0], check
    found, _ = audit(spark, [claim()], {"S1": {"outcome_domains": ["else"]}})
    assert found == {"supporting_outcome_outside_section_filter", "outcome_domain_outside_section"}


def test_roll_up_routes_categories(spark):
    _, issues = audit(spark, [claim((), (), ())])
    assert rows(A.roll_up(issues), "check") == [("missing_citation", 1, "unsupported_claims"), ("unsupported_claim", 1, "unsupported_claims")]


def test_contradictions_are_counted_not_listed(spark):
    claims = spark.createDataFrame([("c1", ["s1"], []), ("c2", ["s1"], ["s2", "s3"]), ("c3", ["s9"], [])], "claim_id string, supporting_studies array<string>, contradicting_studies array<string>")
    members = spark.createDataFrame([("g", f"s{i}") for i in (1, 2, 3)], "group_id string, study_id string")
    out = S.contradiction_omissions(claims, members, members.select("study_id"))
    assert rows(out, "claim_id") == [("c1", "g", True, 1, 2)]


def test_reports_and_references(spark):
    report = "Seen [1, 2] and [4-5].\n\n## References\n\n[1] A. *One*. 2001.\n[2] B. *Two*. 2002.\n[3] C. *Three*. 2003.\n[4] D. *Four*. 2004.\n[5] E. *Five*. 2005."
    reports = spark.createDataFrame([(1, report)], "report_id int, report string")
    names = ["One", "Two", "Three", "Four", "Five"]
    known = spark.createDataFrame([(1, i + 1, "ABCDE"[i], names[i], str(2001 + i)) for i in range(5)], "report_id int, num int, authors string, title string, year string")
    assert rows(Q.reference_issues(reports, known).select("num", "issue"), "num") == [(3, "orphan_reference")]
    cleaned = Q.clean_reports(reports, known)
    assert "[3]" not in cleaned.first().report and "[5] E. *Five*. 2005." in cleaned.first().report
    assert Q.reference_issues(cleaned.select("report_id", "report"), known).count() == 0


def test_study_citation_tokens(spark):
    texts = spark.createDataFrame([("x", "See study_a1, [cohort_9], R-17 and mystudy_z but xR-177.")], "section_id string, text string")
    known = spark.createDataFrame([("study_a1",), ("R-17",)], "study_id string")
    got = rows(Q.study_citations(texts, known, prefixes=["cohort"]).select("token", "known"), "token")
    assert got == [("R-17", True), ("cohort_9", False), ("study_a1", True)]


def test_failing_extractor_gives_error_rows(spark):
    packs = spark.createDataFrame([(1, "ok", "a"), (2, "bad", "b")], "doc_id int, pack string, path string")

    def extractor(pack, path):
        if pack == "bad":
            raise RuntimeError("boom")
        return {"n": len(pack)}

    done, failed = extend.run_extractor(packs, extractor)
    assert rows(done, "doc_id") == [(1, '{"n": 2}')] and rows(failed.select("doc_id", "detail"), "doc_id") == [(2, "RuntimeError: boom")]


def test_runs_report_what_they_recorded(spark):
    runs = spark.createDataFrame([("a", "invalid", "passed", False), ("b", "valid", None, True), ("c", None, "failed", None)],
                                 "run_id string, claim_map_status string, section_validation string, placeholder boolean")
    searches = spark.createDataFrame([("a", False), ("b", None), ("x", True)], "run_id string, enabled boolean")
    seeds = spark.createDataFrame([("c",), ("c",)], "run_id string")
    found = A.run_record_issues(runs, searches, seeds)
    assert sorted((r.entity_id, r.check) for r in found.collect()) == [
        ("a", "claim_map_invalid"), ("a", "empty_search_plan"), ("b", "placeholder_synthesis_used"), ("b", "section_coverage_missing"), ("c", "section_coverage_incomplete")]
    assert A.run_record_issues(runs.limit(0), searches, seeds).count() == 0


def test_coverage_of_sections_without_text(spark):
    """A NULL text took the errors of the section itself with it."""
    schema = "section_id string, section_text string, claims array<struct<sentence:string,study_ids:array<string>,citations:array<string>>>"
    sections = spark.createDataFrame([("a", None, []), ("b", None, [("x", ["study_1"], None)]), ("c", None, None)], schema)
    members = spark.createDataFrame([("a", "study_1"), ("c", "study_1")], "section_id string, study_id string")
    errors = S.section_coverage_errors(sections, members, members.select("study_id"))
    found = sorted((r.section_id, r.error) for r in errors.collect())
    silent = "evidence_section_has_no_study_citation"
    assert [e for e in found if e[0] != "b"] == [("a", silent), ("a", "nonempty_section_zero_claims"), ("c", silent), ("c", "nonempty_section_zero_claims")]
    assert ("b", "empty_evidence_section_has_claims") in found and ("b", "claim_sentence_absent_from_section") in found


def test_claims_of_the_written_sections_come_from_the_section_text(spark, tmp_path):
    """A blank turn cites in its first sentence, which is the claim."""
    rows = [(1, 2, "user", ""), (1, 4, "user", "  "), (1, 0, "user", None), (2, 2, "user", "A b. C d.")]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    from evistrata.plans.synthesis import written_sections
    claims = {(r.section_id): r.claims[0].sentence for r in written_sections(spark, str(tmp_path)).collect()}
    assert claims["1-2"] == claims["1-4"] == "Seen in [study_1] and pub_z." and claims["2-2"] == "A b."
    assert claims["1-0"] == "\nSeen in [study_1] and pub_z."


def test_kept_rows_are_read_by_column(spark):
    from evistrata.common import cut_lineage

    rows = spark.range(50).selectExpr("id", "array('a', null) as listed", "map('k', string(id)) as fields", "if(id % 2 = 0, struct(id as x), null) as pair")
    kept = cut_lineage(rows)
    assert kept.schema.simpleString() == rows.schema.simpleString() and sorted(map(repr, kept.collect())) == sorted(map(repr, rows.collect()))
    plan = kept.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet [id" in plan and "listed" not in plan
