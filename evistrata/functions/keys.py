"""Record keys, stable identifiers and processing keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from evistrata.common import as_col, blank_to_null, first_text
from evistrata.functions.text import strip

# Identity parts that count as "not given".
EMPTY_IDENTITY_VALUES = ("not_reported", "unknown", "n/a")


def norm_doi(*candidates: str | Column) -> Column:
    """First given DOI, lower-cased and without resolver prefix; NULL when none.

    A ``PMID:`` value standing in a DOI slot is not a DOI.
    """
    given = [F.when(~F.upper(strip(c)).startswith("PMID:"), as_col(c)) for c in candidates]
    bare = F.regexp_replace(F.lower(strip(first_text(*given))), r"^https?://(dx\.)?doi\.org/", "")
    return F.nullif(bare, F.lit(""))


def pmid_from_doi_slot(value: str | Column) -> Column:
    """PMID written into a DOI slot, else NULL."""
    return F.when(F.upper(as_col(value)).startswith("PMID:"), F.trim(F.substring(as_col(value), F.lit(6), F.length(as_col(value)))))


def title_key(title: str | Column) -> Column:
    """Lower-case words and digits separated by single spaces."""
    lowered = F.lower(F.coalesce(as_col(title), F.lit("")))
    return F.trim(F.regexp_replace(lowered, "[^a-z0-9]+", " "))


def record_key(doi: str | Column, title: str | Column, raw_record_id: str | Column) -> Column:
    """``doi:`` key, else ``title:`` key, else the record's own ``raw:`` key."""
    by_title = title_key(title)
    return (
        F.when(as_col(doi).isNotNull(), F.concat(F.lit("doi:"), as_col(doi)))
        .when(by_title != "", F.concat(F.lit("title:"), by_title))
        .otherwise(F.concat(F.lit("raw:"), as_col(raw_record_id)))
    )


def _id_part(value: str | Column) -> Column:
    return F.lower(F.trim(F.coalesce(as_col(value).cast("string"), F.lit(""))))


def stable_id(prefix: str, *parts: str | Column) -> Column:
    """Prefix and 16 hex digits of the SHA-256 of the JSON array of parts."""
    digest = F.sha2(F.to_json(F.array(*[_id_part(p) for p in parts])), 256)
    return F.concat(F.lit(f"{prefix}_"), F.substring(digest, 1, 16))


def json_digest(fields: Mapping[str, str | Column]) -> Column:
    """SHA-256 of compact JSON with sorted keys (P5)."""
    body = F.struct(*[as_col(fields[name]).alias(name) for name in sorted(fields)])
    return F.sha2(F.to_json(body, {"ignoreNullFields": "false"}), 256)


def processing_key(
    content_hash: str | Column, question: str, model: str, version: str,
    use_pack: bool = True, rerank: bool = False, vectors: bool = False,
) -> Column:
    """24 hex digits that name one processing of one document."""
    digest = json_digest({
        "cache_version": F.lit(version),
        "content_sha256": content_hash,
        "question": F.lit(question),
        "model": F.lit(model),
        "input_mode": F.lit("evidence_pack" if use_pack else "full_prefix"),
        "rerank": F.lit(bool(rerank and use_pack)),
        "vectors": F.lit(bool(vectors and use_pack)),
    })
    return F.substring(digest, 1, 24)


# --- extraction entities (P40, P41) ---------------------------------------

def publication_id(doi: str | Column, pmid: str | Column, title: str | Column) -> Column:
    return stable_id("pub", first_text(doi, pmid, title))


def study_id(publication: str | Column, label: str | Column, ordinal: str | Column) -> Column:
    return stable_id("study", publication, label, ordinal)


def study_identity_key(publication: str | Column, label: str | Column) -> Column:
    return stable_id("study-key", publication, label)


def evidence_id(
    study: str | Column, outcome: str | Column, quote: str | Column, page: str | Column,
    section: str | Column, figure: str | Column, table: str | Column, ordinal: str | Column,
) -> Column:
    return stable_id("evidence", study, outcome, quote, page, section, figure, table, ordinal)


def configured_outcome_key(study: str | Column, fields: Sequence[tuple[str, str | Column]]) -> Column:
    """Key over the configured identity fields that carry a value; NULL when none does."""
    parts = []
    for name, value in fields:
        text = F.trim(as_col(value).cast("string"))
        given = text.isNotNull() & (text != "") & ~F.lower(text).isin(*EMPTY_IDENTITY_VALUES)
        parts.append(F.when(given, F.lower(F.concat(F.lit(f"{name}="), text))))
    present = F.array_compact(F.array(*parts))
    payload = F.to_json(F.concat(F.array(_id_part(study)), present))
    key = F.concat(F.lit("outcome-configured-key_"), F.substring(F.sha2(payload, 256), 1, 16))
    return F.when(F.size(present) > 0, key)


def outcome_identity(
    study: str | Column,
    outcome_id: str | Column,
    identity_key: str | Column,
    domain: str | Column,
    ordinal: str | Column,
    fields: Sequence[tuple[str, str | Column]] = (),
    fallback: str = "domain_and_ordinal",
) -> Column:
    """Struct of key, source, explicit id and warning, by falling certainty."""
    explicit_id = blank_to_null(F.trim(as_col(outcome_id)))
    explicit_key = blank_to_null(F.trim(as_col(identity_key)))
    configured = configured_outcome_key(study, fields) if fields else F.lit(None).cast("string")
    bare_domain = F.trim(F.coalesce(as_col(domain), F.lit("")))
    by_domain = (bare_domain != "") & F.lit(fallback in ("domain", "domain_only"))

    def row(key: Column, source: str, explicit: Column | None = None, warning: str = "") -> Column:
        return F.struct(
            key.alias("identity_key"), F.lit(source).alias("identity_source"),
            (explicit if explicit is not None else F.lit("")).alias("outcome_id"), F.lit(warning).alias("warning"),
        )

    return (
        F.when(explicit_id.isNotNull(), row(F.concat(F.lit("outcome-id:"), explicit_id), "explicit_outcome_id", explicit_id))
        .when(explicit_key.isNotNull(), row(explicit_key, "explicit_identity_key"))
        .when(configured.isNotNull(), row(configured, "configured_fields"))
        .when(by_domain, row(stable_id("outcome-domain-key", study, bare_domain), "domain_fallback"))
        .otherwise(row(
            stable_id("outcome-key", study, bare_domain, ordinal), "ordinal_fallback",
            warning="unstable_outcome_identity_fallback",
        ))
    )
