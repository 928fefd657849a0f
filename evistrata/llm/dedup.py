"""Exact de-duplication by content hash with a comparison of the bytes.

Rows are grouped by a 128-bit hash *and* the text itself.  Grouping compares the bytes of all
texts that share a hash, combines on the map side (one row per text and task, so a text that
a third of all rows repeat moves once per task), and needs no list of members.  Rows then
find their group by (128-bit hash, SHA-256), which moves ids and digests only.  Two different
texts that agree in both digests cannot be told apart by that join; the grouping sees them,
and the job fails rather than merge them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evistrata.llm.base import texts


def content_hash(text: Column) -> Column:
    """128-bit content hash."""
    return F.unhex(F.md5(text.cast("binary")))


def exact_groups(
    docs: DataFrame,
    normalise: Callable[[Column], Column] | None = None,
    keep: str = "min",
    digest: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per input row with its group of equal texts.

    Returns ``doc_id``, ``keep_id`` (smallest id of the group, or largest with ``keep="max"``),
    ``group_size``, ``kept`` (the row carries ``keep_id``) and ``text_sha256``.  ``normalise``
    maps the text before comparison; without it texts are compared as they are.  ``digest`` is
    the grouping hash.

    Null texts equal empty ones.  A null id never becomes ``keep_id`` unless the whole group
    has none.  Rows that repeat both id and text count as members and share ``kept``.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep must be 'min' or 'max'")
    pick = F.min if keep == "min" else F.max
    text = F.col("text") if normalise is None else F.coalesce(normalise(F.col("text")), F.lit(""))
    base = texts(docs).select("doc_id", text.alias("text"))
    hashed = digest(F.col("text")).alias("hash"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha")

    compared = (
        base.select("doc_id", "text", hashed[0])
        .groupBy("hash", "text").agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("hash", hashed[1], "keep_id", "group_size")
    )
    alone = F.assert_true(F.count(F.lit(1)) == 1, F.lit("two different texts share both digests")).isNull()
    groups = (
        compared.groupBy("hash", "sha")
        .agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), alone.alias("alone"))
        .filter("alone")
    )
    rows = base.select("doc_id", *hashed)
    return rows.join(groups, ["hash", "sha"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, keep: str = "min", digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row of each group of equal texts, with all its columns: the one with the least (or largest) id.

    The same grouping, with the row carried along, so texts move once.  Rows that repeat id and
    text become one; null texts equal empty ones; a row without id stays only if its whole
    group has none.
    """
    rest = [c for c in docs.columns if c != "text"]
    held = F.struct(F.struct(*rest).alias("rest"), F.col("text").isNull().alias("was_null"))
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"))
    pick = F.min_by
    if keep == "max":
        rank, pick = F.struct(F.col("doc_id").isNotNull().alias("has_id"), F.col("doc_id").alias("id")), F.max_by
    base = docs.select(F.coalesce("text", F.lit("")).alias("text"), held.alias("held"), rank.alias("rank"))
    one = base.groupBy(digest(F.col("text")).alias("hash"), "text").agg(pick("held", "rank").alias("held"))
    back = {c: F.col("held.rest")[c] for c in rest} | {"text": F.when(~F.col("held.was_null"), F.col("text"))}
    return one.select(*[back[c].alias(c) for c in docs.columns])
