"""Chunking, scoring and budgeted selection inside one document row.

All of it works on arrays in the document's own row: the text is read once and
never shuffled, whatever the number of documents.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from evistrata.common import as_col
from evistrata.functions.text import canonical_section, may_name_section, snippet, strip

# Score of a chunk by the section it belongs to.
SECTION_PRIORITY = {
    "abstract": 5, "results": 4, "discussion": 4, "conclusion": 3, "methods": 2, "introduction": 2,
}
# Sections whose best chunk is always packed.
KEY_SECTIONS = ("abstract", "results", "discussion", "conclusion")
EXTERNAL_BONUS = 10
VECTOR_WEIGHT = 10

CHUNK_FIELDS = ("chunk_id", "source", "section", "heading", "char_start", "char_end", "text")
RANGE = "array<struct<start:int,end:int>>"


def _int(value) -> Column:
    return (F.lit(value) if isinstance(value, int) else value).cast("int")


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once; a lambda computes what it names each time."""
    return F.get(F.transform(F.array(value), use), 0)


def _piece(text: Column, start: Column, end: Column) -> Column:
    return strip(F.substring(text, start + 1, end - start))


def _chunk(chunk_id: Column, source: str, section: Column, heading: Column, start: Column, end: Column, text: Column) -> Column:
    return F.struct(
        chunk_id.alias("chunk_id"), F.lit(source).alias("source"), section.alias("section"), heading.alias("heading"),
        _int(start).alias("char_start"), _int(end).alias("char_end"), text.alias("text"),
    )


# --- sections and windows (W7) --------------------------------------------

def section_headings(text: str | Column) -> Column:
    """Known section headings with the offset of their line.

    Few lines end like a heading; only those are read closely.
    """
    start = F.struct(
        F.lit(0).alias("offset"), F.array().cast("array<struct<offset:int,line:string,section:string>>").alias("found"))

    def step(state: Column, line: Column) -> Column:
        found = F.array(F.struct(
            state["offset"].alias("offset"), F.substring(strip(line), 1, 100).alias("line"), canonical_section(line).alias("section")))
        return F.struct(
            (state["offset"] + F.length(line) + 1).alias("offset"),
            F.when(may_name_section(line), F.concat(state["found"], found)).otherwise(state["found"]).alias("found"),
        )

    return F.aggregate(F.split(as_col(text), "\n", -1), start, step, lambda s: F.filter(s["found"], lambda h: h["section"].isNotNull()))


def sections_from(text: str | Column, headings: Column) -> Column:
    """Chunks from each heading to the next; empty below two headings."""
    text = as_col(text)

    def span(head: Column, i: Column) -> Column:
        end = F.coalesce(F.get(headings, i + 1)["offset"], F.length(text))
        return _chunk(F.lit(""), "detected_section", head["section"], head["line"], head["offset"], end, _piece(text, head["offset"], end))

    spans = F.when(F.size(headings) >= 2, F.filter(F.transform(headings, span), lambda c: c["text"] != ""))
    numbered = F.transform(spans, lambda c, i: c.withField("chunk_id", F.format_string("s%03d", i)))
    return F.filter(F.coalesce(numbered, F.array()), lambda c: c.isNotNull())


def sliding_windows(text: str | Column, window: int = 6000, overlap: int = 800) -> Column:
    """Overlapping windows up to the first one that reaches the end."""
    text = as_col(text)
    step = max(1, window - overlap)

    def cuts(size: Column) -> Column:
        starts = F.when(size > 0, F.filter(
            F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(step)),
            lambda s: (s == 0) | (s - step + window < size)))

        def cut(start: Column) -> Column:
            end = F.least(size, start + window)
            return _chunk(F.lit(""), "fallback_window", F.lit("unknown"), F.lit(""), start, end, _piece(text, start, end))

        return F.transform(F.coalesce(starts, F.array().cast("array<int>")), cut)

    windows = F.filter(_bound(F.length(text), cuts), lambda c: c["text"] != "")
    return F.transform(windows, lambda c, i: c.withField("chunk_id", F.format_string("w%03d", i)))


# --- ranges (W6) and keyword windows (J26) --------------------------------

def merge_ranges(ranges: Column, gap: int = 300) -> Column:
    """Ranges joined when they overlap or lie at most ``gap`` apart; start clamped to 0."""
    usable = F.transform(
        F.filter(ranges, lambda r: r["end"] > r["start"]),
        lambda r: F.struct(F.greatest(r["start"], F.lit(0)).alias("start"), F.greatest(r["end"], F.lit(0)).alias("end")),
    )

    none = F.lit(None).cast("int")
    empty = F.struct(none.alias("start"), none.alias("end"), F.array().cast(RANGE).alias("done"))

    def fold(state: Column, r: Column) -> Column:
        apart = state["start"].isNull() | (r["start"] > state["end"] + gap)
        return F.when(apart, F.struct(r["start"].alias("start"), r["end"].alias("end"), _closed(state).alias("done"))).otherwise(
            F.struct(state["start"].alias("start"), F.greatest(state["end"], r["end"]).alias("end"), state["done"].alias("done")))

    return F.aggregate(F.array_sort(usable), empty, fold, _closed)


def _closed(state: Column) -> Column:
    """Ranges that are done, and the open one if there is one."""
    last = F.array(F.struct(state["start"].cast("int").alias("start"), state["end"].cast("int").alias("end")))
    return F.when(state["start"].isNull(), state["done"]).otherwise(F.concat(state["done"], last))


def term_ranges(text: str | Column, term: str, radius: int = 2000, gap: int = 300, lowered: Column | None = None) -> Column:
    """Merged windows around the non-overlapping hits of one term.

    Hits come in text order, so each joins or follows the open window; only the
    merged windows are kept, never the hits.  ``lowered`` is the text in lower case, if known.
    """
    needle = term.lower()
    lowered = F.lower(as_col(text)) if lowered is None else lowered
    none = F.lit(None).cast("int")

    def windows(x: Column) -> Column:
        # ``after`` is the place behind the last hit; the open window ends ``radius`` beyond it.
        empty = F.struct(F.lit(0).alias("after"), none.alias("start"), F.array().cast(RANGE).alias("done"))

        def end(state: Column) -> Column:
            return F.least(x["size"], state["after"] + (len(term) - len(needle) + radius))

        def opened(state: Column) -> Column:
            return F.array(F.struct(state["start"].alias("start"), end(state).alias("end")))

        def step(state: Column, skipped: Column) -> Column:
            left = F.greatest(state["after"] + skipped - radius, F.lit(0))
            after = (state["after"] + skipped + len(needle)).alias("after")
            joins = left <= end(state) + gap
            return (
                F.when(state["start"].isNull(), F.struct(after, left.alias("start"), state["done"].alias("done")))
                .when(joins, F.struct(after, state["start"].alias("start"), state["done"].alias("done")))
                .otherwise(F.struct(after, left.alias("start"), F.concat(state["done"], opened(state)).alias("done"))))

        # No hit follows the last piece.
        hits = F.slice(x["pieces"], F.lit(1), F.size(x["pieces"]) - 1)
        return F.aggregate(F.transform(hits, F.length), empty, step, lambda s: F.when(s["start"].isNull(), s["done"]).otherwise(F.concat(s["done"], opened(s))))

    pieces = F.split(lowered, re.escape(needle), -1)
    return _bound(F.struct(pieces.alias("pieces"), F.length(as_col(text)).alias("size")), windows)


def keyword_windows(text: str | Column, terms: Sequence[str], radius: int = 2000, gap: int = 300) -> Column:
    """Windows around all hits of the question terms."""
    text = as_col(text)
    given = [t for t in terms if t]
    if not given:
        return F.filter(F.array(_chunk(F.lit(""), "", F.lit(""), F.lit(""), F.lit(0), F.lit(0), F.lit(""))), lambda c: F.lit(False))
    merged = merge_ranges(_bound(F.lower(text), lambda low: F.concat(*[term_ranges(text, t, radius, gap, low) for t in given])), gap)

    def cut(r: Column, i: Column) -> Column:
        return _chunk(F.format_string("k%03d", i), "keyword_window", F.lit("keyword_context"), F.lit(""), r["start"], r["end"], _piece(text, r["start"], r["end"]))

    return F.filter(F.transform(merged, cut), lambda c: c["text"] != "")


# --- front and tail (W8) --------------------------------------------------

def boundary_chunks(text: str | Column, front: int = 6000, tail: int = 6000) -> Column:
    """First ``front`` characters and the last ``tail`` beyond them."""
    text = as_col(text)

    def pieces(size: Column) -> Column:
        front_end = F.least(size, F.lit(front))
        tail_start = F.greatest(front_end, size - tail)
        return F.array(
            _chunk(F.lit("front000"), "front_matter", F.lit("front_matter"), F.lit(""), F.lit(0), front_end, _piece(text, F.lit(0), front_end)),
            _chunk(F.lit("tail000"), "tail", F.lit("tail"), F.lit(""), tail_start, size, _piece(text, tail_start, size)),
        )

    return F.filter(_bound(F.length(text), pieces), lambda c: c["text"] != "")


# --- scores (P19, P23) ----------------------------------------------------

def term_count(lowered: Column, term: str) -> Column:
    """Non-overlapping hits, told from bytes, whose number a string knows without reading it."""
    needle = term.lower()
    removed = F.octet_length(lowered) - F.octet_length(F.replace(lowered, F.lit(needle)))
    return (removed / F.lit(len(needle.encode()))).cast("int")


def score_chunks(chunks: Column, terms: Sequence[str]) -> Column:
    """Chunks with score, hit terms and input position.

    Three passes over the array, so that each text is lower-cased and each term
    counted once.
    """
    priority = F.create_map(*[F.lit(x) for pair in SECTION_PRIORITY.items() for x in pair])
    given = [t for t in terms if t]
    lowered = F.transform(chunks, lambda c: F.struct(c.alias("c"), F.lower(c["text"]).alias("low")))

    def count(x: Column) -> Column:
        low = x["low"]
        # Plain substring tests come first: the pattern only runs on chunks that can match.
        possible = low.contains("table") | low.contains("fig") | low.contains("表") | low.contains("图")
        exhibit = possible & low.rlike(r"(?U)\b(table|figure|fig\.|表|图)\b")
        counts = F.array(*[term_count(low, t) for t in given]) if given else F.array().cast("array<int>")
        return F.struct(x["c"].alias("c"), counts.alias("n"), exhibit.cast("int").alias("exhibit"))

    def finish(x: Column, i: Column) -> Column:
        score = F.coalesce(F.try_element_at(priority, x["c"]["section"]), F.lit(0)) + x["exhibit"]
        for k in range(len(given)):
            score = score + F.least(F.get(x["n"], k), F.lit(5))
        hits = [F.when(F.get(x["n"], k) > 0, F.lit(t)) for k, t in enumerate(given)]
        found = F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")
        fields = [x["c"][f].alias(f) for f in CHUNK_FIELDS]
        return F.struct(*fields, score.cast("double").alias("score"), found.alias("hits"), i.alias("pos"))

    return F.transform(F.transform(lowered, count), finish)


def hybrid_score(score: Column, similarity: Column, selected: Column | None = None) -> Column:
    """Keyword score plus weighted similarity plus the bonus of an external selection."""
    total = score + F.coalesce(similarity, F.lit(0.0)) * VECTOR_WEIGHT
    return total if selected is None else total + F.when(F.coalesce(selected, F.lit(False)), EXTERNAL_BONUS).otherwise(0)


def rerank_trigger(chunks: Column) -> Column:
    """Why an external ranking would help, or ``programmatic_confident``."""
    usable = F.filter(chunks, lambda c: c["section"] != "references")
    keyword = F.filter(usable, lambda c: c["source"] == "keyword_window")
    positive = F.filter(usable, lambda c: c["score"] > 0)
    best = F.coalesce(F.array_max(F.transform(usable, lambda c: c["score"])), F.lit(0.0))
    return (
        F.when(F.size(usable) > 30, "many_candidates").when(F.size(keyword) > 12, "many_keyword_windows")
        .when((F.size(usable) > 0) & (best <= 2), "low_confidence_scores")
        .when(F.size(positive) > 20, "diffuse_term_hits").otherwise("programmatic_confident")
    )


def ranked_candidates(chunks: Column, limit: int = 80) -> Column:
    """Chunks for display: keyword windows first, then score, then hits."""
    usable = F.filter(chunks, lambda c: c["section"] != "references")
    keys = F.transform(usable, lambda c, i: F.struct(
        F.when(c["source"] == "keyword_window", 0).otherwise(1).alias("a"), (-c["score"]).alias("b"),
        (-F.size(c["hits"])).alias("c"), i.alias("i"), c["chunk_id"].alias("chunk_id"), c["text"].alias("text")))
    return F.transform(F.slice(F.array_sort(keys), 1, limit), lambda k: F.struct(k["chunk_id"].alias("chunk_id"), snippet(k["text"]).alias("snippet")))


def accepted_ids(selected: Column, candidates: Column, limit: int = 20) -> Column:
    """First ``limit`` distinct selected ids that are candidates."""
    return F.slice(F.array_intersect(F.transform(selected, lambda s: F.trim(s)), candidates), 1, limit)


# --- budgeted selection (W11, W12) ----------------------------------------

def _by_score(chunks: Column) -> Column:
    return F.array_sort(F.transform(chunks, lambda c: F.struct(
        (-c["score"]).alias("neg"), c["pos"].alias("pos"), c["chunk_id"].alias("chunk_id"), F.length(c["text"]).alias("size"))))


def _take(order: Column, budget: int, ids: Column, total: Column, skip_unscored: bool) -> Column:
    """Add ranked chunks until one brings the total to the budget."""
    start = F.struct(ids.alias("ids"), total.alias("total"), F.lit(False).alias("full"))

    def step(state: Column, c: Column) -> Column:
        skip = state["full"]
        if skip_unscored:
            skip = skip | ((c["neg"] >= 0) & (F.size(state["ids"]) > 0))
        new = ~F.array_contains(state["ids"], c["chunk_id"])
        grown = state["total"] + F.when(new, c["size"]).otherwise(0)
        added = F.struct(
            F.when(new, F.array_append(state["ids"], c["chunk_id"])).otherwise(state["ids"]).alias("ids"),
            grown.alias("total"), (grown >= budget).alias("full"))
        return F.when(skip, state).otherwise(added)

    return F.aggregate(order, start, step, lambda s: F.struct(s["ids"].alias("ids"), s["total"].alias("total")))


def _same(field: str, value: str):
    return lambda c: c[field] == value


def base_ids(chunks: Column) -> Column:
    """Ids packed whatever their size: front, tail and the best chunk of each key section."""
    usable = F.filter(chunks, lambda c: c["section"] != "references")
    pool = F.when(F.size(usable) > 0, usable).otherwise(chunks)
    picks = [F.get(F.filter(pool, _same("source", source)), 0)["chunk_id"] for source in ("front_matter", "tail")]
    for section in KEY_SECTIONS:
        ranked = _by_score(F.filter(usable, _same("section", section)))
        picks.append(F.get(ranked, 0)["chunk_id"])
    return F.array_distinct(F.array_compact(F.array(*picks)))


def keyword_phase(chunks: Column, state: Column, budget: int) -> Column:
    wanted = F.filter(chunks, lambda c: (c["section"] != "references") & (c["source"] == "keyword_window") & (F.size(c["hits"]) > 0))
    return _take(_by_score(wanted), budget, state["ids"], state["total"], skip_unscored=False)


def remaining_phase(chunks: Column, state: Column, budget: int) -> Column:
    usable = F.filter(chunks, lambda c: c["section"] != "references")
    pool = F.when(F.size(usable) > 0, usable).otherwise(chunks)
    return _take(_by_score(pool), budget, state["ids"], state["total"], skip_unscored=True)


def total_length(chunks: Column, ids: Column) -> Column:
    sizes = F.transform(F.filter(chunks, lambda c: F.array_contains(ids, c["chunk_id"])), lambda c: F.length(c["text"]))
    return F.aggregate(sizes, F.lit(0), lambda s, n: s + n)


def included_chunks(chunks: Column, ids: Column, budget: int) -> Column:
    """Selected chunks in text order, the last one cut at the budget."""
    picked = F.array_sort(
        F.filter(chunks, lambda c: F.array_contains(ids, c["chunk_id"])),
        lambda a, b: F.when(a["char_start"] < b["char_start"], -1).when(a["char_start"] > b["char_start"], 1)
        .when(a["pos"] < b["pos"], -1).otherwise(1))
    start = F.struct(F.lit(0).alias("sent"), F.array().cast("array<int>").alias("takes"))

    def step(state: Column, c: Column) -> Column:
        take = F.greatest(F.least(F.length(c["text"]), budget - state["sent"]), F.lit(0))
        return F.struct((state["sent"] + take).alias("sent"), F.array_append(state["takes"], take).alias("takes"))

    takes = F.aggregate(picked, start, step, lambda s: s["takes"])
    cut = F.zip_with(picked, takes, lambda c, n: F.struct(
        c["chunk_id"].alias("chunk_id"), c["source"].alias("source"), c["section"].alias("section"), c["heading"].alias("heading"),
        c["char_start"].alias("char_start"), F.least(c["char_end"], c["char_start"] + n).alias("char_end"),
        c["char_end"].alias("source_end"), c["score"].alias("score"), c["hits"].alias("hits"), n.alias("chars_sent"),
        F.substring(c["text"], F.lit(1), n).alias("text")))
    return F.filter(cut, lambda c: c["chars_sent"] > 0)


def pack_text(included: Column) -> Column:
    """Packed text: one header line and the piece per chunk."""
    def part(c: Column) -> Column:
        hits = F.coalesce(F.nullif(F.array_join(F.slice(c["hits"], 1, 8), ", "), F.lit("")), F.lit("none"))
        return F.concat(
            F.lit("[chunk "), c["chunk_id"], F.lit(" | source="), c["source"], F.lit(" | section="), c["section"],
            F.lit(" | chars="), c["char_start"].cast("string"), F.lit("-"), c["source_end"].cast("string"),
            F.lit(" | hits="), hits, F.lit("]\n"), c["text"])

    return F.array_join(F.transform(included, part), "\n\n---\n\n")
