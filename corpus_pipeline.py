"""From raw documents to packed training sequences.

Each stage takes the rows that its predecessor kept and, but for the last, returns the columns
of ``documents``; stages are written as Parquet in the shared folder and read again.  A stage's
files are removed once the next one is written, but for those the result is read from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evistrata.llm import dedup, language, ngrams, quality
from evistrata.llm.base import remove, scratch_path, stage, table
from evistrata.llm.queries import language_training_rows, pack_documents, quality_training_labels


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear."""
    return language.keep_identified(docs, language.learn(language_training_rows(docs)))


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least the threshold."""
    return quality.keep_good(docs, quality.learn(docs, quality_training_labels(spark, sf_dir)))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle sets with Jaccard similarity of 0.8 or more."""
    return ngrams.keep_one(docs, ngrams.Settings(width=5, numerator=4, denominator=5))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their ids and their place in sequences of 4096 tokens."""
    return pack_documents(docs, with_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("quality_classifier", classify_quality),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("packing", pack_sequences),
]

#: Compression, a trained model and a library tokenizer have no SQL equivalent.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, function in STAGES[:-1]:
        path = scratch_path(spark, name)
        docs = stage(function(spark, docs, sf_dir), name, path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
