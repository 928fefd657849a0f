import random

import pytest
from pyspark.sql import functions as F

from evistrata.functions import packing as P
from evistrata.operators import packing as ops

IMRAD = "Title\nAbstract\nShort.\n1. Introduction\nWhy.\nMETHODS\nHow.\nResults:\nWhat table 1.\nDiscussion\nSo.\nConclusions\nEnd.\nReferences\n[1] x"


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")


def chunks(spark, text, **kw):
    return ops.chunk_rows(ops.split_sections(docs(spark, text), **kw)).orderBy("char_start").collect()


def test_sections(spark):
    got = chunks(spark, IMRAD)
    assert [c.section for c in got] == ["abstract", "introduction", "methods", "results", "discussion", "conclusion", "references"]
    assert [c.chunk_id for c in got] == [f"s{i:03d}" for i in range(7)]
    assert all(a.char_end == b.char_start for a, b in zip(got, got[1:])) and got[-1].char_end == len(IMRAD)


def test_windows(spark):
    got = chunks(spark, "x" * 15_000)
    assert [(c.char_start, c.char_end) for c in got] == [(0, 6000), (5200, 11200), (10400, 15000)]
    assert {c.source for c in chunks(spark, "word " * 2000)} == {"fallback_window"}
    assert chunks(spark, "") == []


def test_boundaries(spark):
    def spans(n):
        df = docs(spark, "A" * n)
        return [(c.char_start, c.char_end) for c in ops.explode_chunks(df, P.boundary_chunks("text")).orderBy("char_start").collect()]

    assert spans(18_000) == [(0, 6000), (12000, 18000)] and spans(6000) == [(0, 6000)] and spans(7000) == [(0, 6000), (6000, 7000)]


def brute_merge(ranges, gap):
    out = []
    for a, b in sorted((max(0, a), max(0, b)) for a, b in ranges if b > a):
        if out and a <= out[-1][1] + gap:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def merged(spark, ranges, gap):
    df = spark.createDataFrame([("d", a, b) for a, b in ranges], "doc_id string, start bigint, end bigint")
    table = [(r.start, r.end) for r in ops.merge_range_rows(df, gap=gap).orderBy("start").collect()]
    inline = df.agg(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))).alias("r"))
    array = [(r.start, r.end) for r in inline.select(F.inline(P.merge_ranges(F.col("r"), gap))).orderBy("start").collect()]
    assert table == array
    return table


def test_merge_fixture(spark):
    ranges = [(0, 50), (100, 150), (300, 400), (700, 800)]
    assert merged(spark, ranges, 300) == [(0, 800)] and merged(spark, ranges, 299) == [(0, 400), (700, 800)]
    assert merged(spark, [(-50, 100), (10, 10)], 0) == [(0, 100)]


@pytest.mark.parametrize("longest", [40, 3000])
def test_merge_equals_brute_force(spark, longest):
    rng = random.Random(7)
    ranges = [(a, a + rng.randrange(-3, longest if a % 40 == 0 else 40)) for a in (rng.randrange(-10, 6000) for _ in range(300))]
    assert merged(spark, ranges, 5) == brute_merge(ranges, 5)


def test_merge_of_hot_sparse_and_null_keys_over_ranges(spark):
    rng = random.Random(11)
    data = [(k, a, a + rng.randrange(1, 30)) for k, n in (("hot", 900), (None, 300), ("b", 5)) for a in (rng.randrange(0, 20_000) for _ in range(n))]
    # One island of the hot key spans several ranges, and one range opens nothing.
    data += [("hot", 2_000, 15_000), ("z", 10**15, 10**15 + 1)]
    df = spark.createDataFrame(data, "doc_id string, start bigint, end bigint").repartition(6)
    got = sorted((r.doc_id or "", r.start, r.end) for r in ops.merge_range_rows(df, gap=5).collect())
    want = [(k or "", a, b) for k in {k for k, _, _ in data} for a, b in brute_merge([(a, b) for key, a, b in data if key == k], 5)]
    assert got == sorted(want)
    assert ops.merge_range_rows(df.limit(0), gap=5).count() == 0


def brute_windows(text, terms, radius, gap):
    hits = []
    for term in terms:
        at = text.lower().find(term.lower())
        while at >= 0:
            hits.append((max(0, at - radius), min(len(text), at + len(term) + radius)))
            at = text.lower().find(term.lower(), at + len(term))
    return brute_merge(hits, gap)


def test_keyword_windows_equal_brute_force(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aab .XyZ") for _ in range(rng.randrange(1, 900))) for _ in range(40)]
    terms = ["aa", "x", "b.", "zz"]
    got = ops.explode_chunks(docs(spark, *texts), P.keyword_windows("text", terms, 9, 4)).select("doc_id", "char_start", "char_end").collect()
    have = {(r.doc_id, r.char_start, r.char_end) for r in got}
    want = {(i, a, b) for i, t in enumerate(texts) for a, b in brute_windows(t, terms, 9, 4) if t[a:b].strip()}
    assert have == want


def test_scores(spark):
    df = docs(spark, IMRAD + "\n" + "what " * 9)
    got = {c.section: (c.score, list(c.hits)) for c in ops.chunk_rows(ops.score_chunks(ops.split_sections(df), ["what", "How"])).collect()}
    assert got["results"] == (4 + 1 + 1, ["what"]) and got["methods"] == (3.0, ["How"]) and got["references"][0] == 5.0


def brute_pack(chunks, budget):
    """The add-then-check selection written as a loop, for comparison."""
    usable = [c for c in chunks if c["section"] != "references"]
    pool = usable or chunks
    picked = set()
    for source in ("front_matter", "tail"):
        picked.update([c["chunk_id"] for c in pool if c["source"] == source][:1])
    for section in ("abstract", "results", "discussion", "conclusion"):
        same = [c for c in usable if c["section"] == section]
        if same:
            picked.add(max(same, key=lambda c: c["score"])["chunk_id"])

    def size():
        return sum(len(c["text"]) for c in chunks if c["chunk_id"] in picked)

    for order, skip in (([c for c in usable if c["source"] == "keyword_window" and c["hits"]], False), (pool, True)):
        for c in sorted(order, key=lambda c: -c["score"]):
            if skip and c["score"] <= 0 and picked:
                continue
            picked.add(c["chunk_id"])
            if size() >= budget:
                break
    left, out = budget, []
    for c in sorted((c for c in chunks if c["chunk_id"] in picked), key=lambda c: c["char_start"]):
        if left <= 0:
            break
        out.append((c["chunk_id"], min(len(c["text"]), left)))
        left -= out[-1][1]
    return out


def test_pack_equals_loop(spark):
    rng = random.Random(11)
    words = ["alpha", "beta", "gamma", "delta", "table"]
    heads = ["Abstract", "Results", "Methods", "References", "Discussion"]
    texts = []
    for _ in range(30):
        lines = []
        for _ in range(rng.randrange(1, 30)):
            lines.append(rng.choice(heads) if rng.random() < 0.25 else " ".join(rng.choice(words) for _ in range(rng.randrange(1, 25))))
        texts.append("\n".join(lines))
    sizes = {"window": 300, "overlap": 50, "radius": 30, "gap": 10, "front": 80, "tail": 60}
    for budget in (150, 600, 100_000):
        packed = ops.build_evidence_pack(docs(spark, *texts), ["alpha", "gamma"], budget=budget, **sizes)
        scored = ops.score_chunks(ops.all_chunks(docs(spark, *texts), ["alpha", "gamma"], **sizes), ["alpha", "gamma"])
        arrays = {r.doc_id: [c.asDict() for c in r.chunks] for r in scored.select("doc_id", "chunks").collect()}
        for r in packed.collect():
            assert [(c.chunk_id, c.chars_sent) for c in r.included] == brute_pack(arrays[r.doc_id], budget)
            assert r.sent_chars == sum(c.chars_sent for c in r.included) <= budget
            assert r.coverage_ratio == round(r.sent_chars / r.full_text_chars, 4)
            assert r.pack.count("[chunk ") == r.selected_chunks


def test_packing_never_shuffles_text(spark):
    plan = ops.build_evidence_pack(docs(spark, IMRAD), ["alpha"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_keyword_windows_lower_the_text_once_and_keep_hits_behind_letters_that_grow(spark):
    df = docs(spark, "x and the", "İ" * 5 + "the", "none", "", "the" + "x" * 161 + "the", "the" + "x" * 160 + "the")
    out = df.select("doc_id", P.keyword_windows("text", ["the", "and"], 60, 40).alias("chunks"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1
    got = [(c.doc_id, c.char_start, c.char_end) for c in ops.chunk_rows(out).orderBy("doc_id", "char_start").collect()]
    assert got == [(0, 0, 9), (1, 0, 8), (4, 0, 63), (4, 104, 167), (5, 0, 166)]


def test_few_lines_are_read_as_headings_and_none_is_missed(spark):
    from evistrata.functions import text as X

    names = [n for names in X.SECTION_HEADINGS.values() for n in names]
    lines = [f"{a}{n}{b}" for n in names for a in ("", "  ", "2.1) ", "IV: ") for b in ("", " :. ", "　", ".   ." + " " * 60)]
    lines += [n.upper() for n in names] + ["bacKground", "the end", "", " . : ", "method a"]
    rows = spark.createDataFrame([(x,) for x in lines], "line string").select(X.canonical_section("line").alias("s"), X.may_name_section("line").alias("m"), "line").collect()
    assert all(r.m for r in rows if r.s is not None) and not any(r.m for r in rows[-4:])


def test_snippets_are_made_of_shown_candidates_only(spark):
    scored = ops.score_chunks(ops.all_chunks(docs(spark, IMRAD), ["how"]), ["how"]).select("chunks")
    given = spark.createDataFrame(scored.collect(), scored.schema).select(P.ranked_candidates(F.col("chunks"), 2).alias("r"))
    plan = given._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace") == 1 and plan.index("regexp_replace") > plan.index(", 1, 2)")
    assert len(given.first().r) == 2
