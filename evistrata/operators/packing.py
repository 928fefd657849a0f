"""Evidence packing over a documents table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evistrata.common import in_ranges, same_row
from evistrata.functions import packing as P
from evistrata.functions.values import cosine


def split_sections(documents: DataFrame, text: str = "text", window: int = 6000, overlap: int = 800) -> DataFrame:
    """Add ``chunks``: detected sections, else sliding windows."""
    headed = documents.withColumn("_heads", P.section_headings(text))
    cut = headed.withColumn("_sections", P.sections_from(text, F.col("_heads")))
    chunks = F.when(F.size("_sections") > 0, F.col("_sections")).otherwise(P.sliding_windows(text, window, overlap))
    return cut.withColumn("chunks", chunks).drop("_heads", "_sections")


def all_chunks(
    documents: DataFrame, terms: Sequence[str], text: str = "text", window: int = 6000, overlap: int = 800,
    radius: int = 2000, gap: int = 300, front: int = 6000, tail: int = 6000,
) -> DataFrame:
    """Boundary, structural and keyword chunks of each document in one array."""
    cut = split_sections(documents, text, window, overlap)
    union = F.concat(P.boundary_chunks(text, front, tail), F.col("chunks"), P.keyword_windows(text, terms, radius, gap))
    return cut.withColumn("chunks", union)


def score_chunks(chunked: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Add score, hits and input position to every chunk."""
    return chunked.withColumn("chunks", P.score_chunks(F.col("chunks"), terms))


def explode_chunks(df: DataFrame, chunks: str | Column, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per chunk.

    The outer form plus a filter on its output, because a plain ``inline`` makes
    the optimizer derive a filter on the array and compute the array twice.
    """
    return df.select(*keys, F.inline_outer(chunks)).filter("chunk_id is not null")


def chunk_rows(chunked: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    return explode_chunks(chunked, "chunks", keys)


def select_pack(scored: DataFrame, text: str = "text", budget: int = 80_000) -> DataFrame:
    """Add the packed chunks and their coverage (W12, A12); needs scored ``chunks``."""
    start = F.struct(F.col("_base").alias("ids"), P.total_length(F.col("chunks"), F.col("_base")).alias("total"))
    staged = (
        scored.withColumn("_base", P.base_ids(F.col("chunks")))
        .withColumn("_state", start)
        .withColumn("_state", P.keyword_phase(F.col("chunks"), F.col("_state"), budget))
        .withColumn("_state", P.remaining_phase(F.col("chunks"), F.col("_state"), budget))
        .withColumn("included", P.included_chunks(F.col("chunks"), F.col("_state.ids"), budget))
    )
    sent = F.aggregate("included", F.lit(0), lambda s, c: s + c["chars_sent"])
    size = F.length(text)
    sources = F.transform("chunks", lambda c: c["source"])
    counted = F.map_from_entries(F.transform(
        F.array_sort(F.array_distinct(sources)),
        lambda name: F.struct(name.alias("source"), F.size(F.filter(sources, lambda s: s == name)).alias("n"))))
    return staged.withColumns({
        "sent_chars": sent,
        "full_text_chars": size,
        "total_chunks": F.size("chunks"),
        "selected_chunks": F.size("included"),
        "section_detection": F.when(F.array_contains(sources, "detected_section"), "detected").otherwise("fallback_window"),
        "source_methods": F.array_sort(F.array_distinct(F.transform("included", lambda c: c["source"]))),
        "candidate_source_counts": counted,
        "rerank_trigger": P.rerank_trigger(F.col("chunks")),
    }).withColumn("coverage_ratio", F.when(size > 0, F.round(F.col("sent_chars") / size, 4)).otherwise(0.0)).drop("_base", "_state")


def build_evidence_pack(documents: DataFrame, terms: Sequence[str], text: str = "text", budget: int = 80_000, **sizes: int) -> DataFrame:
    """Documents with ``pack``, ``included`` and coverage columns."""
    scored = score_chunks(all_chunks(documents, terms, text, **sizes), terms)
    packed = select_pack(scored, text, budget)
    return packed.withColumn("pack", P.pack_text(F.col("included"))).drop("chunks")


def add_vector_scores(rows: DataFrame, vectors: DataFrame, query: Sequence[float], selected: DataFrame | None = None) -> DataFrame:
    """Hybrid score of chunk rows from an embeddings table keyed by the full SHA-256 of the chunk text.

    ``vectors``: chunk_hash, vector; ``selected``: (doc_id, chunk_id) chosen outside.
    """
    wanted = F.array(*[F.lit(float(x)) for x in query])
    hashed = rows.withColumn("chunk_hash", F.sha2("text", 256))
    joined = hashed.join(vectors.select("chunk_hash", "vector"), "chunk_hash", "left")
    similarity = F.when(F.col("vector").isNotNull(), cosine("vector", wanted)).otherwise(0.0)
    flag = None
    if selected is not None:
        joined = joined.join(selected.select("doc_id", "chunk_id").distinct().withColumn("_chosen", F.lit(True)), ["doc_id", "chunk_id"], "left")
        flag = F.col("_chosen")
    out = joined.withColumn("vector_similarity", similarity).withColumn("score", P.hybrid_score(F.col("score"), F.col("vector_similarity"), flag))
    return out.select(*rows.columns, "vector_similarity")


def missing_vectors(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """Distinct chunk texts without an embedding yet."""
    hashed = rows.select(F.sha2("text", 256).alias("chunk_hash"), "text")
    todo = hashed.join(vectors.select("chunk_hash").distinct(), "chunk_hash", "left_anti")
    return todo.groupBy("chunk_hash").agg(F.min("text").alias("text"))


def merge_range_rows(ranges: DataFrame, keys: Sequence[str] = ("doc_id",), gap: int = 300) -> DataFrame:
    """Gaps-and-islands over a table of (keys, start, end) rows.

    Runs a job: the rows are dealt over ranges of (keys, start, end) by sampled quantiles, so a key
    with a third of the rows is spread over tasks like any other.  Each range forms islands from
    its own rows and the furthest end its key reached in the ranges before; an island that goes on
    takes the name of the one it continues.  Ranges are contiguous, so a range has at most one key
    from the ranges before; only those keys are looked up, at most one row per range.
    """
    usable = ranges.filter(F.col("end") > F.col("start")).select(
        *keys, F.greatest("start", F.lit(0)).alias("start"), F.greatest("end", F.lit(0)).alias("end"))
    dealt = in_ranges(usable, keys, "start", [F.col("end")])
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy("_range", *keys).orderBy("_id")

    reach = dealt.groupBy(*keys, "_range").agg(F.max("end").alias("_reach"))
    carried = reach.withColumn("_carried", F.max("_reach").over(before)).filter("_carried is not null")
    known = dealt.alias("n").join(carried.alias("h"), same_row("n", "h", [*keys, "_range"]), "left")
    known = known.select(*[F.col(f"n.{c}") for c in dealt.columns], "h._carried")
    reached = F.greatest("_carried", F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1)))
    opens = F.when(reached.isNull() | (F.col("start") > reached + gap), 1).otherwise(0)
    numbered = known.withColumn("_opens", opens).withColumn("_place", F.sum("_opens").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    parts = numbered.groupBy(*keys, "_range", "_place").agg(F.min("start").alias("start"), F.max("end").alias("end"))

    # Place 0 of a range continues the island its key opened last in a range before.
    opened = parts.groupBy(*keys, "_range").agg(F.max("_place").alias("_last"))
    last = F.when(F.col("_last") > 0, F.struct("_range", F.col("_last").alias("_place")))
    opened = opened.withColumn("_open", F.max(last).over(before)).filter("_open is not null")
    named = parts.alias("n").join(opened.alias("h"), same_row("n", "h", [*keys, "_range"]), "left")
    island = F.when(F.col("n._place") == 0, F.col("h._open")).otherwise(F.struct("n._range", "n._place"))
    named = named.select(*[F.col(f"n.{c}") for c in [*keys, "start", "end"]], island.alias("_island"))
    return named.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def best_per_section(rows: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Best chunk per document and section; earlier input wins ties."""
    usable = rows.filter("section <> 'references'")
    return usable.groupBy(*keys, "section").agg(F.max_by("chunk_id", F.struct("score", (-F.col("pos")).alias("early"))).alias("chunk_id"))


def corpus_coverage(packed: DataFrame) -> DataFrame:
    """Coverage totals over documents."""
    return packed.groupBy("section_detection").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("full_text_chars").alias("full_text_chars"),
        F.sum("sent_chars").alias("sent_chars"), F.sum("selected_chunks").alias("selected_chunks"))
