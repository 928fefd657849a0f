"""Documents ranked for claims: every pruning beside the plain sum over all shared terms."""

from __future__ import annotations

import random
import re

import pytest

from evistrata.operators.findings import relevant_documents


def plain(claims, documents, k):
    terms = lambda text: set(re.findall(r"[\w\-]{3,}", (text or "").lower()))
    offered = [(doc_id, terms(text)) for doc_id, text in documents]
    df = {}
    for _, own in offered:
        for term in own:
            df[term] = df.get(term, 0) + 1
    weight = {term: len(bin(len(documents) // n)) - 2 for term, n in df.items()}
    found = []
    for claim_id, text in claims:
        asked = terms(text)
        scored = [(sum(weight[t] for t in own & asked), len(own & asked), doc_id) for doc_id, own in offered if own & asked]
        for rank, (score, shared, doc_id) in enumerate(sorted(scored, key=lambda s: (-s[0], s[2]))[:k], 1):
            found.append((claim_id, doc_id, score, shared, rank))
    return sorted(found)


@pytest.mark.parametrize("rare, k", [(0.1, 3), (0.0, 2), (1.0, 3), (0.4, 1), (0.25, 50)])
def test_ranking_equals_the_plain_sum(spark, rare, k):
    draw = random.Random(11)
    words = [f"word{i}" for i in range(40)]
    often = words[:4]
    documents = [(i, " ".join(draw.sample(words, draw.randint(0, 9)) + draw.sample(often, draw.randint(0, 4)))) for i in range(70)] + [(70, None), (71, "")]
    claims = [(i, " ".join(draw.sample(words, draw.randint(1, 8)))) for i in range(25)] + [(25, " ".join(often)), (26, "unheard"), (27, None), (28, "")]
    got = relevant_documents(spark.createDataFrame(claims, "claim_id long, claim string"), spark.createDataFrame(documents, "doc_id long, text string").repartition(5), k, rare)
    assert sorted((r.claim_id, r.doc_id, r.score, r.shared, r.rank) for r in got.collect()) == plain(claims, documents, k)


def test_few_documents_and_a_copied_passage_are_ranked(spark):
    passage = "the copied passage of all texts"
    documents = [(i, passage + (" telling" if i == 5 else "")) for i in range(6)]
    claims = [(1, "copied passage"), (2, "telling passage")]
    got = relevant_documents(spark.createDataFrame(claims, "claim_id long, claim string"), spark.createDataFrame(documents, "doc_id long, text string"), 2)
    assert sorted((r.claim_id, r.doc_id, r.score, r.shared, r.rank) for r in got.collect()) == [(1, 0, 2, 2, 1), (1, 1, 2, 2, 2), (2, 0, 1, 1, 2), (2, 5, 4, 2, 1)]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert relevant_documents(spark.createDataFrame(claims, "claim_id long, claim string"), none).count() == 0
