"""Quote and citation integrity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evistrata.functions import quotes as Q
from evistrata.functions import text as X


#: Quotes that share one copy of their document's text.
BLOCK = 256


def quote_blocks(quotes: DataFrame, texts: DataFrame, key: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """The columns of ``texts`` and ``_quotes``, one row per document and about ``block`` of its distinct quotes.

    A document with a third of all quotes is dealt over many rows by the hash of the quote, and its
    text is shipped once per block, not once per quote.  A NULL quote counts as empty.
    """
    asked = quotes.select(key, F.coalesce("quote", F.lit("")).alias("_q")).distinct()
    blocks = asked.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / block).cast("bigint").alias("_blocks"))
    dealt = asked.join(blocks, key).groupBy(key, F.pmod(F.xxhash64("_q"), F.col("_blocks")).alias("_block"))
    packed = dealt.agg(F.collect_list("_q").alias("_quotes")).drop("_block")
    return packed.join(texts, key)


def _answered(quotes: DataFrame, answers: DataFrame, key: str, name: str) -> DataFrame:
    """``quotes`` with the answer to their text; quotes without a document are not judged."""
    return quotes.withColumn("_q", F.coalesce("quote", F.lit(""))).join(answers.select(key, "_q", name), [key, "_q"]).select(*quotes.columns, name)


def verify_prefixes(quotes: DataFrame, documents: DataFrame, key: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """Quotes with ``found`` by prefix containment.

    A text that quotes name is reduced to its letters once; equal quotes of one document are
    looked for once.  A NULL text counts as empty.
    """
    named = documents.join(quotes.select(key).distinct(), key, "left_semi")
    letters = named.select(key, Q.letters_only(F.coalesce("text", F.lit(""))).alias("_letters"))
    rows = quote_blocks(quotes, letters, key, block).select(key, "_letters", F.explode("_quotes").alias("_q"))
    return _answered(quotes, rows.withColumn("found", Q.prefix_found("_q", "_letters")), key, "found")


def validate_quotes(quotes: DataFrame, documents: DataFrame, key: str = "doc_id", min_length: int = 12, block: int = BLOCK) -> DataFrame:
    """Quotes with their ``check`` struct against the named document.

    Quotes that occur as they are settle first.  A text is folded once per block, and only if a
    quote of the block is still open, so no other text crosses to Python.  A NULL text counts as empty.
    """
    blocks = quote_blocks(quotes, documents.select(key, F.coalesce("text", F.lit("")).alias("_text")), key, block)
    given = F.transform("_quotes", lambda q: F.struct(q.alias("_q"), X.strip(q).alias("_s")))
    tried = blocks.withColumn("_quotes", F.transform(given, lambda q: q.withField(
        "_open", (F.length(q["_s"]) >= min_length) & ~F.col("_text").contains(q["_s"]))))
    opened = F.exists("_quotes", lambda q: q["_open"])
    folded = tried.withColumn("_folded", Q.folded_text(F.when(opened, F.col("_text"))))
    rows = folded.select(key, "_folded", F.inline("_quotes")).withColumn("_fq", Q.folded_text(F.when(F.col("_open"), F.col("_s"))))
    return _answered(quotes, rows.withColumn("check", Q.settled_check("_s", "_open", "_fq", "_folded", min_length)), key, "check")


def pass_rates(verified: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Quotes, failures and pass percentage."""
    counted = verified.groupBy(*by).agg(F.count(F.lit(1)).alias("quotes"), F.count_if(~F.col("found")).alias("failed"))
    rate = F.when(F.col("quotes") > 0, (F.col("quotes") - F.col("failed")) / F.col("quotes") * 100).otherwise(100.0)
    return counted.withColumn("pass_rate", rate)


def reference_issues(reports: DataFrame, known: DataFrame, key: str = "report_id") -> DataFrame:
    """Disagreements of body citations, reference list and known references.

    One row per (report, number, issue, severity); number is NULL for a missing list.
    Body, list and known numbers are stacked and counted per number, which combines
    on the map side and needs no join.
    """
    split = reports.select(key, X.split_references("report").alias("_s")).select(
        key, X.numeric_citations("_s.body").alias("_cites"), X.reference_lines("_s.references").alias("_lines"),
        (F.col("_s.references") == "").alias("_no_list"))
    nothing = F.lit(None).cast("string")
    flag = F.struct(
        F.lit(0).alias("body"), F.lit(0).alias("listed"), F.lit(0).alias("known"),
        nothing.alias("line"), nothing.alias("title"), nothing.alias("year"))
    body = split.select(key, F.explode_outer(F.array_distinct("_cites")).alias("num"), flag.withField("body", F.lit(1)).alias("f"))
    listed = split.select(key, F.explode_outer("_lines").alias("_l")).select(
        key, F.col("_l.num").alias("num"), flag.withField("listed", F.lit(1)).withField("line", F.col("_l.line")).alias("f"))
    wanted = known.select(key, F.col("num").cast("bigint").alias("num"), flag.withField("known", F.lit(1))
                          .withField("title", F.col("title")).withField("year", F.col("year").cast("string")).alias("f"))
    stacked = body.unionByName(listed).unionByName(wanted).filter("num is not null")
    per_number = stacked.groupBy(key, "num").agg(
        F.max("f.body").alias("body"), F.sum("f.listed").alias("listed"), F.max("f.known").alias("known"),
        F.min("f.line").alias("line"), F.max("f.title").alias("title"), F.max("f.year").alias("year"))
    both = (F.col("listed") > 0) & (F.col("known") > 0)

    def issue(when: Column, name: str, severity: str) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("issue"), F.lit(severity).alias("severity")))

    checks = F.array_compact(F.array(
        issue((F.col("body") > 0) & (F.col("listed") == 0), "missing_reference", "error"),
        issue((F.col("listed") > 0) & (F.col("body") == 0), "orphan_reference", "warning"),
        issue((F.col("body") > 0) & (F.col("known") == 0), "unknown_citation", "error"),
        issue((F.col("listed") > 0) & (F.col("known") == 0), "unknown_reference", "error"),
        issue(F.col("listed") > 1, "duplicate_reference", "error"),
        issue(both & (F.trim("year") != "") & ~F.col("line").contains(F.trim("year")), "year_missing", "warning"),
        issue(both & (F.trim("title") != "") & ~F.col("line").contains(F.substring(F.trim("title"), 1, 30)), "title_mismatch", "warning"),
    ))
    rows = per_number.select(key, "num", F.explode(checks).alias("_i")).select(key, "num", "_i.issue", "_i.severity")
    no_list = split.filter((F.size("_cites") > 0) & F.col("_no_list")).select(
        key, F.lit(None).cast("bigint").alias("num"), F.lit("reference_list_missing").alias("issue"), F.lit("error").alias("severity"))
    return rows.unionByName(no_list)


def cited_references(reports: DataFrame, known: DataFrame, key: str = "report_id") -> DataFrame:
    """Known references the body cites."""
    cited = reports.select(key, F.explode(F.array_distinct(X.numeric_citations(X.split_references("report")["body"]))).alias("num"))
    return known.withColumn("num", F.col("num").cast("bigint")).join(cited, [key, "num"], "left_semi")


def clean_reports(reports: DataFrame, known: DataFrame, heading: str = "References", key: str = "report_id") -> DataFrame:
    """Reports whose reference list holds exactly the cited known references, by number."""
    kept = cited_references(reports, known, key).withColumn("line", F.concat(
        F.lit("["), F.col("num").cast("string"), F.lit("] "), "authors", F.lit(". *"), "title", F.lit("*. "), F.col("year").cast("string"), F.lit(".")))
    lists = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("num", "line"))).alias("_refs"))
    lines = F.array_join(F.transform("_refs", lambda r: r["line"]), "\n")
    split = reports.withColumn("_s", X.split_references("report")).join(lists, key, "left")
    body = F.regexp_replace("_s.body", r"\s+$", "")
    rebuilt = F.concat(body, F.lit(f"\n## {heading}\n"), F.coalesce(F.concat(F.lit("\n"), lines), F.lit("")))
    report = F.when(F.col("_s.references") == "", F.col("report")).otherwise(rebuilt)
    return split.withColumn("report", report).drop("_s", "_refs")


# Prefixes that mark a study citation whatever the known ids are.
STUDY_PREFIXES = ("study", "pub", "record")
ALNUM = "[A-Za-z0-9]"
# Ways of joining the segments of known ids that are listed to choose candidates; more choose none.
GAP_SHAPES = 64


def study_citations(
    texts: DataFrame, known: DataFrame, key: str = "section_id", text: str = "text", id_column: str = "study_id",
    prefixes: Sequence[str] = (), patterns: Sequence[str] = (),
) -> DataFrame:
    """Study-like tokens of each text, with ``known``.

    A token is study-like by its prefix before the first underscore (the fixed ones, the
    caller's, and those of the known ids), by one of ``patterns``, or because it is a known id
    that no letter or digit touches.

    Known ids are found by an equi-join: every run of as many alphanumeric segments as some
    known id has is a candidate, so the cost does not grow with texts times ids.  The segment
    counts come from the ids themselves, and so does what stands between their segments: while that
    comes in at most ``GAP_SHAPES`` ways (``study_12`` and ``arm_7`` share one), only runs with one of
    them are joined; beyond, all are.  Leading and trailing separators of an id are compared
    with those around the run; an id without letter or digit is never found.
    """
    ids = known.select(F.col(id_column).alias("id")).filter("id <> ''").distinct()
    prefix = F.regexp_extract("id", r"^([A-Za-z][A-Za-z0-9-]*)_", 1)
    fixed = F.lit([*STUDY_PREFIXES, *prefixes])
    derived = ids.select(prefix.alias("prefix")).filter("prefix <> ''").distinct()

    # words with underscores, from every place where a word may begin
    words = F.regexp_extract_all(F.col(text), F.lit(r"(?U)(?<!\w)[A-Za-z0-9_-]+\b"), 0)

    def tails(word: Column) -> Column:
        parts = F.split(word, "-", -1)
        return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "-"))

    underscored = F.filter(words, lambda w: w.contains("_"))
    shaped = F.filter(F.array_distinct(F.flatten(F.transform(underscored, tails))), lambda w: w.rlike("^[A-Za-z][A-Za-z0-9-]*_[A-Za-z0-9_-]+$"))
    by_prefix = texts.select(key, F.explode(shaped).alias("token")).withColumn("prefix", F.substring_index("token", "_", 1))
    by_prefix = by_prefix.join(derived.withColumn("_derived", F.lit(True)), "prefix", "left")
    tokens = by_prefix.filter(F.array_contains(fixed, F.col("prefix")) | F.col("_derived")).select(key, "token")
    for pattern in patterns:
        tokens = tokens.unionByName(texts.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), 0)).alias("token")))

    core = F.regexp_replace("id", "^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "")
    cored = ids.select(
        "id", core.alias("core"), F.regexp_extract("id", "^([^A-Za-z0-9]*)", 1).alias("lead"), F.regexp_extract("id", "([^A-Za-z0-9]*)$", 1).alias("trail"),
    ).filter("core <> ''")
    counts = cored.agg(F.array_sort(F.collect_set(F.size(F.regexp_extract_all("core", F.lit(f"{ALNUM}+"), 0))))).scalar()
    between = F.split("core", f"{ALNUM}+", -1)
    shapes = cored.select(F.slice(between, 2, F.size(between) - 2).alias("g")).distinct().limit(GAP_SHAPES + 1).agg(F.collect_list("g")).scalar()
    prepared = texts.select(
        key, F.regexp_extract_all(F.col(text), F.lit(f"{ALNUM}+"), 0).alias("_words"), F.split(F.col(text), f"{ALNUM}+", -1).alias("_gaps"),
        F.coalesce(counts, F.array().cast("array<int>")).alias("_counts"), shapes.alias("_shapes"),
    ).withColumn("_heads", F.array_distinct(F.transform("_shapes", lambda g: F.get(g, F.lit(0))))).filter(F.size("_words") > 0)

    def runs(n: Column) -> Column:
        def may_begin(i: Column) -> Column:
            # The first gap alone turns most places away, without a slice for each.
            headed = (n == 1) | F.array_contains("_heads", F.get("_gaps", i))
            shaped = headed & F.array_contains("_shapes", F.slice("_gaps", i + 1, n - 1))
            return (i + n - 1 <= F.size("_words")) & ((F.size("_shapes") > GAP_SHAPES) | shaped)

        starts = F.filter(F.sequence(F.lit(1), F.size("_words")), may_begin)
        return F.transform(starts, lambda i: F.struct(
            F.concat(
                F.element_at("_words", i),
                F.array_join(F.zip_with(F.slice("_gaps", i + 1, n - 1), F.slice("_words", i + 1, n - 1), lambda g, w: F.concat(g, w)), ""),
            ).alias("core"),
            F.element_at("_gaps", i).alias("before"), F.element_at("_gaps", i + n).alias("after"),
            (i == 1).alias("first"), (i + n - 1 == F.size("_words")).alias("last"),
        ))

    asked = prepared.select(key, F.inline_outer(F.flatten(F.transform("_counts", runs)))).filter("core is not null")
    fits = (
        F.col("before").endswith(F.col("lead")) & (F.col("first") | (F.length("lead") == 0) | (F.length("before") > F.length("lead")))
        & F.col("after").startswith(F.col("trail")) & (F.col("last") | (F.length("trail") == 0) | (F.length("after") > F.length("trail")))
    )
    found = asked.join(cored, "core").filter(fits).select(key, F.col("id").alias("token"))
    marked = ids.select(F.col("id").alias("token"), F.lit(True).alias("known"))
    joined = tokens.unionByName(found).distinct().join(marked, "token", "left")
    return joined.select(key, "token", F.coalesce("known", F.lit(False)).alias("known"))
