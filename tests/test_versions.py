"""Versions of publications, studies, arms, outcomes and locations through re-extraction."""

from __future__ import annotations

from evistrata.operators import versions as V

STUDIES = "study_ref string, publication_id string, study_id string, identity_key string, label string, ordinal int"
ARMS = "arm_ref string, study_ref string, arm_id string, role string, label string, ordinal int"
OUTCOMES = "outcome_ref string, study_ref string, outcome_id string, identity_key string, domain string, ordinal int, metric string"
LOCATIONS = ("study_ref string, owner_kind string, owner_ref string, ordinal int, quote string, page string, section string, "
             "figure string, table string")


def extraction(spark, publications, studies=(), arms=(), outcomes=(), locations=()):
    located = [(*row, None, None, None, None) for row in locations]
    return V.Extraction(*[spark.createDataFrame(list(rows), schema) for rows, schema in (
        ([(p,) for p in publications], "publication_id string"), (studies, STUDIES), (arms, ARMS), (outcomes, OUTCOMES), (located, LOCATIONS))])


def nothing(spark):
    return spark.createDataFrame([], V.LEDGER)


def ids(frame, kind):
    return sorted(r.entity_id for r in frame.filter(f"kind = '{kind}'").collect())


def full(spark, metrics, labels=("one",)):
    """A publication with a study per label; the first has an arm, outcomes and a location for each and for a field."""
    return extraction(
        spark, ["p"], [(f"s{i}", "p", None, "", label, i) for i, label in enumerate(labels)], [("a", "s0", None, "treated", "dose", 0)],
        [(f"o{i}", "s0", "", None, "d", i, m) for i, m in enumerate(metrics)],
        [("s0", "arm", "a", 0, "ten were treated"), ("s0", "field", "design", 0, "a trial"), *[("s0", "outcome", f"o{i}", 0, f"found {m}") for i, m in enumerate(metrics)]])


def test_all_kinds_close_and_open_together(spark):
    first = V.reingest_entities(nothing(spark), full(spark, ["m1", "m2"]), "t1", ["metric"]).opened
    assert {k: len(ids(first, k)) for k in ("publication", "study", "arm", "outcome", "location")} == {"publication": 1, "study": 1, "arm": 1, "outcome": 2, "location": 4}
    second = V.reingest_entities(first, full(spark, ["m2", "m1"]), "t2", ["metric"])
    for kind in ("publication", "study", "arm", "outcome", "location"):
        assert ids(second.opened, kind) == ids(first, kind) == ids(second.closed, kind)
    run = first.select("extraction_run_id").distinct().collect()[0][0]
    assert {(r.extraction_version, r.supersedes, r.status) for r in second.state.collect()} == {(2, run, "active")}
    new_run = second.opened.collect()[0].extraction_run_id
    assert new_run != run and {(r.status, r.superseded_by) for r in second.closed.collect()} == {("superseded", new_run)}


def test_lost_entities_end_as_superseded_and_other_publications_stay(spark):
    first = V.reingest_entities(nothing(spark), full(spark, ["m1", "m2"], ["one", "two"]), "t1", ["metric"]).opened
    other = V.reingest_entities(nothing(spark), extraction(spark, ["q"], [("x", "q", "X", None, "x", 0)]), "t1").opened
    second = V.reingest_entities(first.unionByName(other), full(spark, ["m2"]), "t2", ["metric"])
    state = {(r.kind, r.entity_id): (r.status, r.extraction_version) for r in second.state.collect()}
    lost = [key for key, value in state.items() if value == ("superseded", 1)]
    assert sorted(kind for kind, _ in lost) == ["location", "outcome", "study"]
    assert state["study", "X"] == state["publication", "q"] == ("active", 1)
    empty = V.reingest_entities(first, extraction(spark, ["p"]), "t3")
    assert {r.kind for r in empty.opened.collect()} == {"publication"} and empty.closed.count() == first.count()
    assert {r.status for r in empty.state.filter("kind <> 'publication'").collect()} == {"superseded"}
    again = V.reingest_entities(empty.opened, full(spark, ["m2"]), "t4", ["metric"]).opened
    assert {r.extraction_version for r in again.collect()} == {3}


def test_ids_survive_chains_of_aliases(spark):
    def version(outcome_id, key, metric):
        return extraction(spark, ["p"], [("s", "p", None, "same", "any", 0)], [], [("o", "s", outcome_id, key, "d", 0, metric)])
    ledger = V.reingest_entities(nothing(spark), version("given", None, "m"), "t1", ["metric"]).opened
    for step, (key, metric) in enumerate([(None, "m"), ("key", "m"), ("key", "other"), (None, "other")]):
        ledger = V.reingest_entities(ledger, version(None, key, metric), f"t{step + 2}", ["metric"]).opened
        assert ids(ledger, "outcome") == ["given"]
    assert V.reingest_entities(ledger, version("renamed", None, "other"), "t9", ["metric"]).state.filter("kind = 'outcome' and status = 'superseded'").first().entity_id == "given"


def test_labels_that_move_keep_their_study_and_equal_labels_stay_apart(spark):
    def labelled(*labels):
        return extraction(spark, ["p"], [(f"s{i}", "p", None, None, label, i) for i, label in enumerate(labels)])
    first = V.reingest_entities(nothing(spark), labelled("a", "b", "twin", "twin", None), "t1").opened
    known = {r.aliases[1]: r.entity_id for r in first.filter("kind = 'study'").collect()}
    assert len(ids(first, "study")) == 5
    same = V.reingest_entities(first, labelled("a", "b", "twin", "twin", None), "t2").opened
    assert ids(same, "study") == ids(first, "study")
    moved = V.reingest_entities(first, labelled("b", "a"), "t2").opened
    assert {r.aliases[1]: r.entity_id for r in moved.filter("kind = 'study'").collect()}.items() <= known.items()


def test_one_outcome_is_continued_by_one_row(spark):
    first = V.reingest_entities(nothing(spark), full(spark, ["m1"]), "t1", ["metric"]).opened
    second = V.reingest_entities(first, full(spark, ["new", "m1"]), "t2", ["metric"]).opened
    assert len(ids(second, "outcome")) == 2 and set(ids(first, "outcome")) < set(ids(second, "outcome"))
    heir = second.filter("kind = 'outcome' and supersedes <> ''").collect()
    assert [r.entity_id for r in heir] == ids(first, "outcome") and heir[0].ordinal == 1


def test_rows_without_owner_are_reported(spark):
    new = extraction(spark, ["p"], [("s", "p", None, None, None, 0), ("lost", None, None, None, None, 1)], [("a", "none", None, None, None, 0)],
                     [("o", None, None, None, None, 0, None)], [("s", "outcome", "o", 0, None), ("none", "field", "f", 0, "q"), ("s", "field", "f", 0, None)])
    result = V.reingest_entities(nothing(spark), new, "t1", ["metric"])
    assert sorted((r.kind, r.ref, r.error) for r in result.orphans.collect()) == [
        ("arm", "a", "study_missing"), ("location", "f", "study_missing"), ("location", "o", "owner_missing"),
        ("outcome", "o", "study_missing"), ("study", "lost", "publication_missing")]
    assert sorted(r.kind for r in result.opened.collect()) == ["location", "publication", "study"]


def test_empty_tables_give_empty_tables(spark):
    result = V.reingest_entities(nothing(spark), extraction(spark, []), "t1", ["metric"])
    assert [f.count() for f in (result.opened, result.closed, result.state, result.orphans)] == [0, 0, 0, 0]


def test_the_stack_of_all_kinds_is_shuffled_once(spark):
    """Rows met their publication's run and the rows before in a shuffle each, aliases and all; the version now goes down with the study."""
    first = V.reingest_entities(nothing(spark), full(spark, ["m1", "m2"]), "t1", ["metric"])
    seen = []
    plain = V.written

    def spy(df, name):
        if name == "opened":
            seen.append(df._jdf.queryExecution().optimizedPlan().toString())
        return plain(df, name)

    V.written = spy
    try:
        second = V.reingest_entities(first.opened, full(spark, ["m1", "m3"]), "t2", ["metric"])
    finally:
        V.written = plain
    # One join per owner of arms and locations (three) and one with the rows before; publications join theirs.
    assert seen[0].count("Join ") <= 6 and "Join Inner, (publication_id" not in seen[0]
    assert {r.extraction_version for r in second.opened.collect()} == {2} and {r.extraction_version for r in first.opened.collect()} == {1}
    assert len({r.extraction_run_id for r in second.opened.collect()}) == 1


def rows(frame, *without):
    return sorted(frame.drop(*without).collect(), key=str)


def two_versions(spark):
    """Ledger and its new extraction: a shared study, an owner in another study, doubles, lost owners and a study that is gone."""
    def children(study, metrics, publication, study_id=None):
        return ([(study, publication, study_id, None, study, 0)], [(f"a{study}", study, None, "treated", "dose", 0)],
                [(f"{study}o{i}", study, f" X{m} " if i == 2 else "", None, "d", i, m) for i, m in enumerate(metrics)],
                [(study, "arm", f"a{study}", 0, "ten"), (study, "field", "design", 0, "trial"), *[(study, "outcome", f"{study}o{i}", 0, m) for i, m in enumerate(metrics)]])

    def merged(publications, *parts, locations=()):
        tables = [[row for part in parts for row in part[i]] for i in range(4)]
        return extraction(spark, publications, *tables[:3], tables[3] + list(locations))

    first = merged(["p", "q", "r", "t", "u"], children("s1", ["m1", "m2", "m3"], "p"), children("s2", ["m1"], "q", "NCT1"), children("s3", ["m1"], "r", "nct1 "),
                   children("s4", ["m1", "m1"], "t"), children("s5", ["m5"], "u"), children("s6", ["m6"], "t"))
    second = merged(["p", "q", "t"], children("s1", ["m2", "m4", "m1"], "p"), children("s1", ["m2"], "p"), children("s2", ["m1", "m2"], "q", "NCT1"), children("s4", ["m1", "m3"], "t"),
                    children("s8", ["m8"], "u"), locations=[("s4", "outcome", "s1o0", 0, "far"), ("s4", "outcome", "none", 0, "lost"), ("s1", "outcome", None, 0, "unnamed")])
    return first, second


def test_rows_dealt_by_publication_equal_those_dealt_by_identity(spark, monkeypatch):
    """What lies near is settled as what does not: all publications count as large, then only those that must be dealt apart."""
    results = []
    for large in (0, V.LARGE):
        monkeypatch.setattr(V, "LARGE", large)
        first, second = two_versions(spark)
        ledger = V.reingest_entities(nothing(spark), first, "t1", ["metric"])
        results.append([ledger.opened, ledger.orphans, *vars(V.reingest_entities(ledger.opened, second, "t2", ["metric"], keep=bool(large))).values()])
    far, near = ([rows(frame) for frame in frames] for frames in results)
    assert far == near and len(near[2]) > 20 and "owner_missing" in {r.error for r in near[5]}


def test_a_made_id_travels_as_bytes_and_comes_back(spark):
    ids = ["outcome_0123456789abcdef", "0123456789abcdef", "outcome_0123456789ABCDEF", "abcd", "", "é_00000000000000ff", "evidence_0123456789abcdeg", None]
    frame = spark.createDataFrame([(i,) for i in ids], "entity_id string").select("entity_id", V._packed("entity_id").alias("packed"))
    found = frame.select("entity_id", V._unpacked("packed").alias("back"), "packed").collect()
    assert [r.back for r in found] == ids and [len(r.packed) for r in found[:2]] == [17, 9]


def test_new_rows_meet_those_before_in_one_shuffle_of_each(spark):
    """Aliases, owners, earlier locations and the rows that are gone took a shuffle each, of both sides."""
    first = V.reingest_entities(nothing(spark), full(spark, ["m1", "m2"]), "t1", ["metric"]).opened
    plan = V.reingest_entities(first, full(spark, ["m1", "m3"]), "t2", ["metric"], keep=False).state._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange ") == plan.count("Exchange hashpartitioning(publication_id") == 7
