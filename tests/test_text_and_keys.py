import hashlib
import json

from pyspark.sql import functions as F

from evistrata.functions import keys as K
from evistrata.functions import quotes as Q
from evistrata.functions import text as X
from evistrata.functions import values as V


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def longs(*values):
    return F.array(*[F.lit(v).cast("bigint") for v in values])


def test_identifiers_match_the_canonical_json_digest(spark):
    def expected(prefix, *parts):
        body = json.dumps([str(p).strip().lower() for p in parts], ensure_ascii=False, separators=(",", ":"))
        return f"{prefix}_{hashlib.sha256(body.encode()).hexdigest()[:16]}"

    got = one(spark, K.stable_id("pub", F.lit(" 10.1/Äß ")), K.stable_id("study", F.lit("p"), F.lit('a "q"'), F.lit(2)), K.study_identity_key(F.lit("P"), F.lit("L")))
    assert got == (expected("pub", "10.1/Äß"), expected("study", "p", 'a "q"', 2), expected("study-key", "p", "l"))


def test_record_keys(spark):
    doi = K.norm_doi(F.lit(""), F.lit(" https://DX.doi.org/10.1/EXAMPLE "))
    assert one(spark, doi, K.norm_doi(F.lit("PMID:12")), K.pmid_from_doi_slot(F.lit("PMID:12")), K.title_key(F.lit("  A–B: c!! "))) == ("10.1/example", None, "12", "a b c")
    none = F.lit(None).cast("string")
    assert one(spark, K.record_key(none, F.lit("!!"), F.lit("r1")), K.record_key(none, F.lit("T"), F.lit("r1")), K.record_key(F.lit("10.1/x"), F.lit("T"), F.lit("r1"))) == ("raw:r1", "title:t", "doi:10.1/x")


def test_outcome_identity_cascade(spark):
    blank = F.lit("")
    def source(**kw):
        args = {"outcome_id": blank, "identity_key": blank, "domain": F.lit("d"), "ordinal": F.lit(0)} | kw
        return K.outcome_identity(F.lit("s"), **args)["identity_source"]

    fields = [("timepoint", F.lit("unknown")), ("domain", F.lit("d"))]
    got = one(spark, source(outcome_id=F.lit("o1")), source(identity_key=F.lit("k")), source(fields=fields), source(fallback="domain"), source(fields=[("t", F.lit("N/A"))]))
    assert got == ("explicit_outcome_id", "explicit_identity_key", "configured_fields", "domain_fallback", "ordinal_fallback")
    key = "outcome-configured-key_" + hashlib.sha256(b'["s","domain=d"]').hexdigest()[:16]
    assert one(spark, K.configured_outcome_key(F.lit("s"), fields)) == (key,)


def test_headings(spark):
    lines = ["1. Introduction:", "IV Results", "ABSTRACT", "Materials & Methods.", "Plain words here", "2.1 Details", "ALL CAPS TITLE", "ABC", "x" * 101]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, t string")
    rows = df.orderBy("i").select(X.canonical_section("t"), X.looks_like_heading("t")).collect()
    assert [r[0] for r in rows] == ["introduction", "results", "abstract", "methods", None, None, None, None, None]
    assert [r[1] for r in rows] == [True, True, True, True, False, True, True, False, False]


def test_citations(spark):
    text = "a [1, 3-5] b [2-] [x] [12] [9-7] [1-200] c [7,1-2]"
    assert one(spark, X.numeric_citations(F.lit(text))) == ([1, 3, 4, 5, 12, 7, 1, 2],)
    assert one(spark, X.sanitize_citations(F.lit("s [1, 9] t [8] u [1-12, 4]"), longs(12, 4, 1))) == ("s [1] t  u [1, 4, 12]",)


def test_report_parts(spark):
    report = "x\n## A\n\nfoo\nbar\n## B"
    assert one(spark, X.report_section(F.lit(report), F.lit("A")), X.report_section(F.lit(report), F.lit("B")), X.report_section(F.lit(report), F.lit("C")), X.report_headings(F.lit(report))) == ("foo\nbar", "", "", ["A", "B"])
    parts = X.split_references(F.lit("body\n## 参考文献\n[1] One\nno\n[2]  Two"))
    assert one(spark, parts["body"], F.transform(X.reference_lines(parts["references"]), lambda r: r["line"])) == ("body", ["One", "Two"])


def test_prose(spark):
    got = one(spark, X.sentences(F.lit("- One a. Two b? ok\n\n# Head")), X.coverage_text(F.lit(" *A*  `b`_C ")), X.paragraph_chunks(F.lit("aaaa\n\nbbbb\n\ncc"), 10), X.paragraph_chunks(F.lit("short"), 10))
    assert got == (["One a.", "Two b?", "ok", "Head"], "a bc", ["aaaa", "bbbb\n\ncc"], ["short"])


def test_loose_json(spark):
    texts = ['```json\n{"a": 1}\n```', 'note {x [ {"b": [1, 2]} tail', "[1]", "nothing { here"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] and json.loads(r[0]) for r in df.orderBy("i").select(X.lenient_json("t")).collect()]
    assert got == [{"a": 1}, {"b": [1, 2]}, [1], None]


def test_names_and_years(spark):
    got = one(spark, X.author_name(F.lit("Doe,  John")), X.author_name(F.lit("John  B Doe")), X.author_name(F.lit("Plato")), X.year_of(F.lit("2020-01-02")), X.year_of(F.lit("Jan 2020")))
    assert [tuple(x) for x in got[:3]] == [("Doe", "John", None), ("Doe", "John B", None), (None, None, "Plato")]
    assert got[3:] == (2020, None)


def test_cosine(spark):
    def vec(*xs):
        return F.array(*[F.lit(float(x)) for x in xs])
    same, orthogonal, opposite, zero = one(spark, V.cosine(vec(1, 2), vec(1, 2)), V.cosine(vec(1, 0), vec(0, 1)), V.cosine(vec(1, 0), vec(-1, 0)), V.cosine(vec(0, 0), vec(1, 1)))
    assert abs(same - 1) < 1e-9 and orthogonal == 0 and abs(opposite + 1) < 1e-9 and zero == 0


def test_quotes(spark):
    rows = [
        ("The intervention changed the value.", "The inter-\nvention changed the value.", ("passed", "normalized", 0.9)),
        ("The intervention changed the value.", "intervention changed", ("passed", "exact", 1.0)),
        ("Der Straße naïve Eﬀekt war groß.", "der strasse naïve effekt", ("passed", "normalized", 0.9)),
        ("Some text of a paper.", "too short", ("failed", "none", 0.0)),
        ("Some text of a paper.", "something entirely different", ("failed", "normalized", 0.0)),
    ]
    df = spark.createDataFrame([(i, t, q) for i, (t, q, _) in enumerate(rows)], "i int, t string, q string")
    check = Q.quote_check("q", "t", Q.folded_text(X.strip("q")), Q.folded_text("t"))
    got = df.select("i", check.alias("c")).orderBy("i").select("c.validation_status", "c.validation_method", "c.confidence").collect()
    assert [tuple(r) for r in got] == [e for _, _, e in rows]


def test_prefix_quotes(spark):
    text = F.lit("Alpha beta — gamma ﬁne delta")
    got = one(spark, *[Q.prefix_found(F.lit(q), Q.letters_only(text)) for q in ("", "BETA gamma", "fine-delta", "zeta", "!!")])
    assert got == (True, True, True, False, False)


def test_support_relation_needs_a_beneficial_direction(spark):
    got = one(spark, *[V.support_relation(F.lit("d"), F.lit(x), {"d": "decrease"}) for x in ("decrease", "increase", "no_change", "mixed", "odd")], V.support_relation(F.lit("e"), F.lit("increase"), {}))
    assert got == ("supports", "contradicts", "neutral", "mixed", "unclear", "unclear")
