from __future__ import annotations

import pytest
from pyspark.sql import functions as F

SF_DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, hash string, key string, n long, rest string, count long"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, and extra columns with clashing names."""
    sentence = "The cat and the dog are in the house of the old man. "
    rows = [
        (1, None, None, None, None), (2, "", "en", "s", 0), (3, "   \n\t ", "en", "s", 5), (4, sentence * 4000, "en", "s", 1), (5, sentence, "en", "s", 1),
        (5, sentence, "en", "s", 1), (6, sentence, None, None, None), (7, "12345 %%% !!!", None, "s", 1), (None, sentence, "en", None, 1), (None, None, None, None, None),
        (8, "un \U0001f600 ​ é\x00\x1c fin <|endoftext|> <|im_end|>", "fr", "s", 1), (9, "a", "fr", "s", 1), (10, "x" * 100_000, "en", "s", 1),
    ]
    return spark.createDataFrame([(*row, "h", None, 7, "r", 1) for row in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(awkward):
    return awkward.filter(F.lit(False))
