"""Text expressions."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from evistrata.common import as_col

# Every character the reference semantics strip as whitespace.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE_CLASS = r"[\s\x1c-\x1f\x85\p{Z}]"

# Section headings and the section each one opens.
SECTION_HEADINGS = {
    "introduction": ("introduction", "background", "intro", "preamble", "scientific background"),
    "abstract": ("abstract", "summary"),
    "methods": (
        "methods", "method", "materials and methods", "materials & methods", "experimental procedures",
        "participants and methods", "subjects and methods", "methods and materials",
    ),
    "results": ("results", "findings"),
    "discussion": ("discussion", "general discussion"),
    "conclusion": ("conclusion", "conclusions", "concluding remarks"),
    "references": ("references", "bibliography", "literature cited"),
}


def strip(value: str | Column) -> Column:
    return F.btrim(as_col(value), F.lit(WHITESPACE))


def collapse_space(value: str | Column) -> Column:
    return strip(F.regexp_replace(as_col(value), SPACE_CLASS + "+", " "))


def text_blob(*parts: str | Column) -> Column:
    """Lower-case concatenation of the given fields, absent ones as '' (P7)."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(as_col(p), F.lit("")) for p in parts]))


def strip_html(value: str | Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(as_col(value), F.lit("")), "<[^>]+>", ""))


def year_of(value: str | Column) -> Column:
    """Integer before the first dash or space, NULL when it is not one."""
    head = F.element_at(F.split(strip(as_col(value).cast("string")), r"[-\s]"), 1)
    return head.try_cast("int")


def canonical_section(line: str | Column) -> Column:
    """Section a heading line opens, else NULL."""
    bare = F.regexp_replace(strip(line), r"(?i)^(?:\d+(?:\.\d+)*|[IVX]+)[).\s:-]+", "")
    name = F.lower(F.regexp_replace(bare, r"[:.\s]+$", ""))
    lookup = [
        F.lit(text) for section, names in SECTION_HEADINGS.items() for heading in names for text in (heading, section)
    ]
    return F.when(F.length(name) <= 80, F.try_element_at(F.create_map(*lookup), name))


#: How the headings end, and how many characters of that tell most other lines apart.
HEADING_END = 4
HEADING_ENDS = sorted({name[-HEADING_END:] for names in SECTION_HEADINGS.values() for name in names})


def may_name_section(line: str | Column) -> Column:
    """True for every line that :func:`canonical_section` knows, and for few others."""
    bare = F.rtrim(as_col(line), F.lit(WHITESPACE + ":."))
    return F.lower(F.substring(bare, -HEADING_END, HEADING_END)).isin(HEADING_ENDS)


def looks_like_heading(line: str | Column) -> Column:
    """Known heading, numbered line, or a short all-capitals line."""
    bare = strip(line)
    letters = F.regexp_replace(bare, "[^A-Za-z]", "")
    capitals = (F.length(letters) >= 4) & (letters == F.upper(letters))
    short = F.size(F.split(collapse_space(bare), " ")) <= 8
    numbered = bare.rlike(r"(?iU)^(?:\d+(?:\.\d+)*|[IVX]+)\s+[\w(]")
    shape = canonical_section(bare).isNotNull() | numbered | (capitals & short)
    return (bare != "") & (F.length(bare) <= 100) & shape


def snippet(value: str | Column, size: int = 500) -> Column:
    return F.substring(collapse_space(value), 1, size)


def question_terms(value: str | Column) -> Column:
    """Latin words or runs of two or more CJK characters, in order."""
    return F.regexp_extract_all(as_col(value), F.lit(r"[A-Za-z0-9_\-]+|[\u4e00-\u9fff]{2,}"), 0)


def search_terms(value: str | Column) -> Column:
    """Distinct sorted words of three or more characters (P21, long form)."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(as_col(value), F.lit(r"[\p{L}\p{N}_-]{3,}"), 0)))


# --- citations ------------------------------------------------------------

def _parse_bound(value: Column) -> Column:
    return strip(value).try_cast("bigint")


def numeric_citations(value: str | Column) -> Column:
    """Numbers cited as ``[1]``, ``[1, 2]`` or ``[1-3]``, in order."""
    inner = F.regexp_extract_all(as_col(value), F.lit(r"\[([0-9][0-9,\s\-]*)\]"), 1)
    parts = F.transform(F.flatten(F.transform(inner, lambda i: F.split(i, ","))), strip)
    nothing = F.array().cast("array<bigint>")

    def expand(part: Column) -> Column:
        single = part.try_cast("bigint")
        bounds = F.split(part, "-", 2)
        start, end = _parse_bound(F.get(bounds, 0)), _parse_bound(F.get(bounds, 1))
        usable = (start > 0) & (end >= start) & (end - start <= 100)
        return (
            F.when(part.contains("-"), F.when(usable, F.sequence(start, end)).otherwise(nothing))
            .when(single > 0, F.array(single))
            .otherwise(nothing)
        )

    return F.flatten(F.transform(parts, expand))


def sanitize_citations(value: str | Column, allowed: str | Column) -> Column:
    """Rewrite citation brackets to the allowed numbers only, dropping empty ones.

    ``allowed`` is an ``array<bigint>``.  Ranges pick from it, so their width is irrelevant.
    """
    pattern = r"\[([\d\s,\-]+)\]"
    allowed = F.array_sort(F.array_distinct(as_col(allowed)))
    between = F.split(as_col(value), pattern, -1)
    inner = F.regexp_extract_all(as_col(value), F.lit(pattern), 1)

    def keep(part: Column) -> Column:
        bounds = F.split(part, "-", -1)
        start, end = _parse_bound(F.get(bounds, 0)), _parse_bound(F.get(bounds, 1))
        single = _parse_bound(part)
        in_range = F.filter(allowed, lambda n: (F.size(bounds) == 2) & (n >= start) & (n <= end))
        return F.when(part.contains("-"), in_range).otherwise(F.filter(allowed, lambda n: n == single))

    def rewrite(bracket: Column) -> Column:
        kept = F.array_distinct(F.flatten(F.transform(F.transform(F.split(bracket, ","), strip), keep)))
        return F.when(F.size(kept) > 0, F.concat(F.lit("["), F.array_join(kept.cast("array<string>"), ", "), F.lit("]"))).otherwise("")

    rewritten = F.transform(inner, rewrite)
    return F.array_join(F.zip_with(between, rewritten, lambda t, b: F.concat(t, F.coalesce(b, F.lit("")))), "")


def split_references(report: str | Column, heading: str = "参考文献|References") -> Column:
    """Struct of body and reference list, cut at the first reference heading."""
    report = as_col(report)
    at = F.regexp_instr(report, F.lit(rf"\n##\s*(?:{heading})"))
    found = at > 0
    return F.struct(
        F.when(found, F.substring(report, F.lit(1), at - 1)).otherwise(report).alias("body"),
        F.when(found, F.substring(report, at, F.length(report))).otherwise("").alias("references"),
    )


def reference_lines(references: str | Column) -> Column:
    """Array of (num, line) for lines that start with ``[n] ``."""
    lines = F.filter(F.split(as_col(references), "\n"), lambda x: x.rlike(r"^\[\d+\]\s+"))
    return F.transform(lines, lambda x: F.struct(
        F.regexp_extract(x, r"^\[(\d+)\]\s+", 1).try_cast("bigint").alias("num"),
        F.regexp_replace(x, r"^\[\d+\]\s+", "").alias("line"),
    ))


# --- prose ----------------------------------------------------------------

def sentences(value: str | Column) -> Column:
    """Sentences of all lines, without list, quote and heading marks."""
    lines = F.transform(
        F.split(as_col(value), "\r?\n"),
        lambda x: strip(F.regexp_replace(x, r"^\s*(?:[-*+]\s+|>\s+|#{1,6}\s+)", "")),
    )
    pieces = F.flatten(F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.split(x, r"(?<=[.!?。！？])\s+")))
    return F.filter(F.transform(pieces, strip), lambda x: x != "")


def coverage_text(value: str | Column) -> Column:
    """Prose without emphasis marks, single-spaced and case-folded."""
    return case_fold(collapse_space(F.regexp_replace(F.coalesce(as_col(value), F.lit("")), "[`*_]", "")))


# Letters whose case folding is not their lower case.
FOLDED = {"ß": "ss", "ς": "σ", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ŉ": "ʼn", "ſ": "s"}


def case_fold(value: str | Column) -> Column:
    """Lower case with ß and the Latin ligatures spelled out and one form of sigma."""
    folded = F.lower(as_col(value))
    for letter, spelled in FOLDED.items():
        folded = F.replace(folded, F.lit(letter), F.lit(spelled))
    return folded


def missing_qualifiers(sentence: str | Column, required: str | Column) -> Column:
    """Required qualifiers the sentence does not contain, case aside (P50)."""
    lowered = F.lower(as_col(sentence))
    return F.filter(as_col(required), lambda q: ~lowered.contains(F.lower(q)))


def paragraph_chunks(value: str | Column, max_chars: int = 10_000) -> Column:
    """Greedy paragraph-bounded chunks."""
    text = as_col(value)
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("size"))

    def add(state: Column, paragraph: Column) -> Column:
        cost = F.length(paragraph) + 2
        full = state["open"].isNotNull() & (state["size"] + cost > max_chars)
        return F.struct(
            F.when(full, F.concat(state["done"], F.array(state["open"]))).otherwise(state["done"]).alias("done"),
            F.when(full | state["open"].isNull(), paragraph)
            .otherwise(F.concat(state["open"], F.lit("\n\n"), paragraph)).alias("open"),
            F.when(full, cost).otherwise(state["size"] + cost).alias("size"),
        )

    folded = F.aggregate(F.split(text, "\n\n"), empty, add, lambda s: F.concat(s["done"], F.array(s["open"])))
    return F.when(F.length(text) <= max_chars, F.array(text)).otherwise(folded)


def _heading_blocks(report: Column) -> Column:
    blocks = F.split(F.concat(F.lit("\n"), report), "\n## ", -1)
    return F.slice(blocks, F.lit(2), F.size(blocks))


def report_headings(report: str | Column) -> Column:
    """Second-level headings of a report."""
    return F.array_distinct(F.transform(_heading_blocks(as_col(report)), lambda b: strip(F.substring_index(b, "\n", 1))))


def report_section(report: str | Column, title: str | Column) -> Column:
    """Text below ``## title`` up to the next second-level heading, '' when absent."""
    wanted = as_col(title)
    block = F.get(F.filter(_heading_blocks(as_col(report)), lambda b: F.substring_index(b, "\n", 1) == wanted), 0)
    body = F.when(block.contains("\n"), F.substring(block, F.length(wanted) + 2, F.length(block)))
    return F.coalesce(strip(body), F.lit(""))


# --- loosely written JSON (P44) -------------------------------------------

def _first_json(value: str | None) -> str | None:
    if value is None:
        return None
    decoder = json.JSONDecoder()
    starts = [i for i, ch in enumerate(value) if ch in "{["]
    for start in starts:
        try:
            return json.dumps(decoder.raw_decode(value, start)[0], ensure_ascii=False)
        except ValueError:
            continue
        except RecursionError:  # nested beyond what can be decoded; so is all inside it down to that depth
            return None
    return None


@F.pandas_udf(StringType())
def _salvage_json(values: pd.Series) -> pd.Series:
    return values.map(_first_json)


def lenient_json(value: str | Column) -> Column:
    """JSON text from fenced or surrounded output; NULL when nothing decodes.

    Clean values stay in the JVM: the Arrow function only sees the others.
    """
    bare = strip(F.regexp_replace(F.regexp_replace(strip(value), r"^```(?:json)?\s*", ""), r"\s*```$", ""))
    clean = F.try_parse_json(bare).isNotNull()
    return F.coalesce(F.when(clean, bare), _salvage_json(F.when(~clean, bare)))


# --- nested section trees (P52) -------------------------------------------

OUTLINE_SCHEMA = (
    "array<struct<heading:string,subsections:array<struct<heading:string,"
    "subsections:array<struct<heading:string>>>>>>"
)


def outline_nodes(outline: Column) -> Column:
    """Pre-order nodes (depth, heading, is_leaf) of a three-level section tree."""

    def node(depth: int, section: Column, leaf: Column) -> Column:
        return F.struct(F.lit(depth).alias("depth"), section["heading"].alias("heading"), leaf.alias("is_leaf"))

    def third(section: Column) -> Column:
        return F.array(node(3, section, F.lit(True)))

    def second(section: Column) -> Column:
        children = F.coalesce(section["subsections"], F.array())
        return F.concat(F.array(node(2, section, F.size(children) == 0)), F.flatten(F.transform(children, third)))

    def first(section: Column) -> Column:
        children = F.coalesce(section["subsections"], F.array())
        return F.concat(F.array(node(1, section, F.size(children) == 0)), F.flatten(F.transform(children, second)))

    return F.flatten(F.transform(outline, first))


def author_name(name: str | Column) -> Column:
    """Struct of last, first and single name of an author string."""
    clean = collapse_space(F.coalesce(as_col(name), F.lit("")))
    comma = F.instr(clean, ",")
    words = F.split(clean, " ")
    many = F.size(words) >= 2
    none = F.lit(None).cast("string")
    last = F.when(comma > 0, F.trim(F.substring(clean, F.lit(1), comma - 1))).when(many, F.element_at(words, -1))
    first = F.when(comma > 0, F.trim(F.substring(clean, comma + 1, F.length(clean)))).when(
        many, F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " "))
    single = F.when((clean != "") & (comma == 0) & ~many, clean).otherwise(none)
    return F.struct(last.alias("last"), first.alias("first"), single.alias("name"))


def vocabulary(value: Column, allowed: Sequence[str], default: str) -> Column:
    """Value when it is in the vocabulary, else the default."""
    return F.when(value.isin(*allowed), value).otherwise(F.lit(default))
