"""Quotes against documents, in blocks that share a text."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from evistrata.functions import quotes as Q
from evistrata.functions import text as X
from evistrata.operators import quotes as ops

TEXTS = {1: "Straße und ﬁne words follow each other in this text, hyphen-\nated too.", 2: "plain words only, again and again: plain words only", 3: "", 4: None}
QUOTES = ["plain words only", "PLAIN   words, only", "strasse und fine", "hyphenated too", "nowhere to be found", "short", "", None, "  plain words only  "]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([1, 2, 2, 2, 3, 4, 9, None]), rng.choice(QUOTES)) for i in range(600)]
    docs = spark.createDataFrame(list(TEXTS.items()), "doc_id bigint, text string")
    return spark.createDataFrame(rows, "id bigint, doc_id bigint, quote string"), docs


def test_blocks_do_not_change_the_answers(spark, tables):
    quotes, docs = tables
    paired = quotes.join(docs, "doc_id").withColumns({"quote_": F.coalesce("quote", F.lit("")), "text_": F.coalesce("text", F.lit(""))})
    plain = paired.select("id", Q.quote_check("quote_", "text_", Q.folded_text(X.strip("quote_")), Q.folded_text("text_")).alias("check"), Q.prefix_found("quote_", Q.letters_only("text_")).alias("found"))
    expected = {r.id: (tuple(r.check), r.found) for r in plain.collect()}
    assert 0 < len(expected) < 600
    for block in (1, 2, 256):
        checks = {r.id: tuple(r.check) for r in ops.validate_quotes(quotes, docs, block=block).collect()}
        found = {r.id: r.found for r in ops.verify_prefixes(quotes, docs, block=block).collect()}
        assert {i: (checks[i], found[i]) for i in checks} == expected and checks.keys() == found.keys()


def test_a_named_document_is_shipped_once_per_block(spark):
    docs = spark.createDataFrame([(1, "x" * 100 + " middle of it " + "y" * 100)], "doc_id bigint, text string")
    quotes = spark.range(10_000).select("id", F.lit(1).cast("bigint").alias("doc_id"), F.concat(F.lit("quote number "), F.col("id").cast("string")).alias("quote"))
    sizes = [len(r._quotes) for r in ops.quote_blocks(quotes, docs).select("_quotes").collect()]
    assert sum(sizes) == 10_000 and len(sizes) <= 40 and max(sizes) < 400
    same = quotes.withColumn("quote", F.lit("middle of it"))
    assert ops.quote_blocks(same, docs).count() == 1
    assert ops.validate_quotes(same, docs).filter("check.validation_method = 'exact'").count() == 10_000


def test_only_texts_with_open_quotes_are_folded(spark):
    docs = spark.createDataFrame([(1, "é plain words only")], "doc_id bigint, text string")
    quotes = spark.createDataFrame([(1, "plain words only", "extra")], "doc_id bigint, quote string, text string")
    out = ops.validate_quotes(quotes, docs)
    assert out.columns == ["doc_id", "quote", "text", "check"] and out.first().check.validation_method == "exact"
    empty = ops.validate_quotes(quotes.limit(0), docs)
    assert empty.count() == 0 and ops.verify_prefixes(quotes, docs.limit(0)).count() == 0
