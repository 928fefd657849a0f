"""Rule-based candidate scoring."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from evistrata.common import as_col


@dataclass(frozen=True)
class Category:
    name: str
    terms: Sequence[str]
    weight: int
    required_for_top_tier: bool = False
    label: str | None = None


def categories_from(rules: Mapping) -> list[Category]:
    """Categories of a user-supplied rules mapping."""
    return [
        Category(name, tuple(spec.get("terms", ())), int(spec.get("weight", 0)), bool(spec.get("required_for_tier_a")), spec.get("label"))
        for name, spec in rules.get("categories", {}).items()
    ]


@dataclass(frozen=True)
class CitationPolicy:
    """Year bounds and citation minimums of the citation penalty."""

    protected_from: int = 2024
    recent_from: int = 2021
    recent_minimum: int = 3
    older_low: int = 5
    older_minimum: int = 10


def term_found(blob: str | Column, term: str) -> Column:
    """Substring for phrases, whole word for single words."""
    if " " in term or "-" in term:
        return as_col(blob).contains(term)
    return as_col(blob).rlike(f"(?<![a-z0-9]){re.escape(term)}(?![a-z0-9])")


def matched_terms(blob: str | Column, terms: Sequence[str]) -> Column:
    """Sorted matching terms."""
    if not terms:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(term_found(blob, t), F.lit(t)) for t in sorted(set(terms))]))


def citation_penalty(year: str | Column, citations: str | Column, policy: CitationPolicy = CitationPolicy()) -> Column:
    year, cited = as_col(year), F.coalesce(as_col(citations), F.lit(0))
    return (
        F.when(year.isNull() | (year == 0) | (year >= policy.protected_from), 0)
        .when(year >= policy.recent_from, F.when(cited < policy.recent_minimum, -1).otherwise(0))
        .when(cited < policy.older_low, -2)
        .when(cited < policy.older_minimum, -1)
        .otherwise(0)
    )


def screen(
    blob: str | Column, year: str | Column, citations: str | Column, rules: Sequence[Category],
    min_score: int = 4, policy: CitationPolicy = CitationPolicy(),
) -> Column:
    """Struct of keep, score, tier and reasons for one candidate (P10)."""
    if not rules:
        return F.struct(
            F.lit(True).alias("keep"), F.lit(0).alias("score"), F.lit("B").alias("tier"),
            F.array(F.lit("no domain screening profile configured")).alias("reasons"),
        )
    found = F.struct(*[matched_terms(blob, c.terms).alias(f"c{i}") for i, c in enumerate(rules)])
    cited = F.coalesce(as_col(citations), F.lit(0))
    facts = F.struct(found.alias("hits"), citation_penalty(year, citations, policy).alias("penalty"), as_col(year).alias("year"), cited.alias("cited"))
    # One-element arrays bind the matches and then the score, so that no term is searched twice.
    scored = F.transform(F.array(facts), lambda f: _scored(f, rules))
    return F.get(F.transform(scored, lambda f: _judged(f, rules, min_score, policy)), 0)


def _hit(facts: Column, i: int) -> Column:
    return F.size(facts["hits"][f"c{i}"]) > 0


def _scored(facts: Column, rules: Sequence[Category]) -> Column:
    score = facts["penalty"]
    for i, c in enumerate(rules):
        score = score + F.when(_hit(facts, i), c.weight).otherwise(0)
    kept = [facts[n].alias(n) for n in ("hits", "penalty", "year", "cited")]
    return F.struct(*kept, score.alias("score"))


def _judged(facts: Column, rules: Sequence[Category], min_score: int, policy: CitationPolicy) -> Column:
    reasons = []
    for i, c in enumerate(rules):
        listed = F.array_join(F.slice(facts["hits"][f"c{i}"], 1, 3), ",")
        if c.weight < 0:
            reason = F.concat(F.lit("exclude:"), listed)
        elif c.label is not None or len(c.terms) > 20:
            reason = F.lit(c.label or c.name.replace("_", "-"))
        else:
            reason = F.concat(F.lit(f"{c.name}:"), listed)
        reasons.append(F.when(_hit(facts, i), reason))
    age = F.when(facts["year"] < policy.recent_from, F.lit("older paper")).otherwise(facts["year"].cast("string"))
    reasons.append(F.when(facts["penalty"] != 0, F.concat(facts["cited"].cast("string"), F.lit(" citations for "), age)))
    top = F.lit(any(c.required_for_top_tier for c in rules))
    for i, c in enumerate(rules):
        if c.required_for_top_tier:
            top = top & _hit(facts, i)
    enough = facts["score"] >= min_score
    return F.struct(
        enough.alias("keep"), facts["score"].alias("score"), F.when(top, "A").when(enough, "B").otherwise("C").alias("tier"),
        F.array_compact(F.array(*reasons)).alias("reasons"),
    )


def screen_tag(base: str, tier: str | Column, score: str | Column) -> Column:
    """``base; screen:T; score:n`` without an empty base."""
    parts = [F.lit(base)] if base else []
    return F.concat_ws("; ", *parts, F.concat(F.lit("screen:"), as_col(tier)), F.concat(F.lit("score:"), as_col(score).cast("string")))


def tag_parts(tag: str | Column) -> Column:
    return F.filter(F.transform(F.split(as_col(tag), ";"), lambda p: F.trim(p)), lambda p: p != "")
