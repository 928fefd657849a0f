"""The registered queries beside their SQL or a brute-force version, and the pipeline."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from evistrata.llm import lines, ngrams
from evistrata.llm.queries import ORACLE, QUERIES
from tests.compare import connection, spark_rows, sql_rows
from tests.llm.test_operators import brute_components

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, SF_DIR)) == sql_rows(connection(SF_DIR), ORACLE[name])


def test_all_thirteen_are_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


def test_native_queries_run_no_python(spark):
    for name in ("op1_chat_format", "op4_exact_dedup"):
        plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))


def test_join_query(spark, docs):
    got = sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in QUERIES["op3_ngram_join"](spark, SF_DIR).collect())
    assert got == brute_components([(r.doc_id, r.text) for r in docs.collect()], ngrams.Settings(3, 9, 10))


def test_packing_query(spark, docs):
    from tokenizers import Tokenizer

    library, got = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), QUERIES["op5_best_fit_packing"](spark, SF_DIR).collect()
    want = Counter()
    for r in docs.collect():
        ids = np.array(library.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        for i in range(0, len(ids), 4096):
            want[r.doc_id, i // 4096, i, len(ids[i : i + 4096]), zlib.crc32(ids[i : i + 4096].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert len({r.sequence_id for r in got}) == -(-sum(r.length for r in got) // 4096)


def test_rules_query(spark, docs):
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op6_quality_rules"](spark, SF_DIR).collect()}
    assert got == {r.doc_id: lines.judge(r.text or "")[:-1] for r in docs.collect()}


def test_html_query_returns_the_articles(spark):
    import html
    import re

    got = {r.page_id: r.text for r in QUERIES["op7_html_text"](spark, SF_DIR).collect()}
    for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect():
        article = r.html.split("<article>", 1)[1].split("</article>")[0].replace("<br>", " ")
        parts = (re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>", "", part))).strip() for part in re.split(r"</?(?:p|h1)>", article))
        assert got[r.page_id] == "\n\n".join(part for part in parts if part)


def test_byte_bpe_query(spark, docs):
    import hashlib

    import tiktoken

    from evistrata.llm import bpe

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op8_byte_bpe"](spark, SF_DIR).collect()}
    for r in docs.collect():
        ids = library.encode_ordinary(r.text or "")
        sha = lambda b: hashlib.sha256(b).hexdigest()
        assert got[r.doc_id] == (len(ids), sha(",".join(map(str, ids)).encode()), sha((r.text or "").encode()))


def test_token_file_query(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, want = 0, []
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = np.array(library.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in QUERIES["op9_token_files"](spark, SF_DIR).collect()) == want


# --- the pipeline -----------------------------------------------------------------------

def test_pipeline_stages(spark, docs, awkward, no_docs):
    import corpus_pipeline

    frame, seen = docs, {}
    for name, function in corpus_pipeline.STAGES[:-1]:
        frame = function(spark, frame, SF_DIR)
        assert frame.columns == docs.columns
        seen[name] = {r.doc_id for r in frame.select("doc_id").collect()}
    order = list(seen.values())
    assert all(later <= earlier for earlier, later in zip(order, order[1:]))
    pieces = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {r.doc_id for r in pieces} == seen["ngram_join"]
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in pieces)
    good = {r.doc_id for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").filter("quality = 1").collect()}
    assert len(good & seen["quality_classifier"]) >= 0.97 * len(good)
    for case in (awkward, no_docs):
        for _, function in corpus_pipeline.STAGES:
            function(spark, case, SF_DIR).collect()
