"""Presence, lookup and rule expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evistrata.common import as_col, blank_to_null

# The closed vocabularies of the data model.
EFFECT_DIRECTIONS = ("increase", "decrease", "no_change", "mixed", "unclear")
SUPPORT_RELATIONS = ("supports", "contradicts", "neutral", "mixed", "unclear")
SCREENING_STAGES = ("fulltext", "title_abstract")
SCREENING_DECISIONS = ("duplicate", "exclude", "include", "uncertain")
NOT_REPORTED = "not_reported"


def truthy(name: str, kind: T.DataType) -> Column:
    """TRUE when a value counts as given: not NULL, '', 0, FALSE or an empty collection."""
    col = F.col(name)
    if isinstance(kind, T.StringType):
        return col != ""
    if isinstance(kind, T.NumericType):
        return col != 0
    if isinstance(kind, T.BooleanType):
        return col
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.size(col) > 0
    return col.isNotNull()


def dotted(path: str, flat: Column | None = None, document: Column | None = None, default: Column | str | None = NOT_REPORTED) -> Column:
    """Value at a dotted path: the flat map first, then the JSON document, then the default."""
    found = []
    if flat is not None:
        found.append(F.try_element_at(flat, F.lit(path)))
    if document is not None:
        found.append(F.get_json_object(document, f"$['{path}']"))
        found.append(F.get_json_object(document, "$." + path))
    if default is not None:
        found.append(F.lit(default) if isinstance(default, str) else default)
    return F.coalesce(*found)


def display(value: str | Column) -> Column:
    """Text of a scalar with NULL and '' shown as the not-reported mark."""
    return F.coalesce(blank_to_null(as_col(value).cast("string")), F.lit(NOT_REPORTED))


def display_json(value: str | Column) -> Column:
    """Text of a nested value as JSON."""
    return F.coalesce(F.to_json(as_col(value)), F.lit(NOT_REPORTED))


def with_missing_values(fields: str | Column, spec: Mapping[str, Mapping]) -> Column:
    """Fill absent declared fields from their default or, when required, missing value."""
    fill = {}
    for name, rule in spec.items():
        if "default" in rule:
            fill[name] = str(rule["default"])
        elif rule.get("required"):
            fill[name] = str(rule.get("missing_value", NOT_REPORTED))
    if not fill:
        return as_col(fields)
    literal = F.create_map(*[F.lit(x) for pair in fill.items() for x in pair])
    given = as_col(fields)
    absent = F.map_filter(literal, lambda k, v: ~F.map_contains_key(given, k))
    return F.map_concat(given, absent)


# What each declared type must look like when it arrives as text.
_TEXT_SHAPES = {
    "number": r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$",
    "integer": r"^-?\d+$",
    "boolean": r"^(true|false)$",
    "list": r"^\s*\[",
    "object": r"^\s*\{",
}


def field_error(value: Column, present: Column, rule: Mapping) -> Column:
    """First rule a declared field breaks, else NULL."""
    kind = rule["type"]
    checks: list[tuple[Column, str]] = []
    if kind == "enum":
        checks.append((~value.isin(*rule["values"]), "expected_enum"))
    elif kind in _TEXT_SHAPES:
        checks.append((~value.rlike(_TEXT_SHAPES[kind]), f"expected_{kind}"))
    limits = rule.get("validation_rule", {})
    number = value.try_cast("double")
    if "min" in limits:
        checks.append((number < F.lit(float(limits["min"])), "below_minimum"))
    if "max" in limits:
        checks.append((number > F.lit(float(limits["max"])), "above_maximum"))
    if "pattern" in limits:
        checks.append((~value.rlike(limits["pattern"]), "pattern_mismatch"))
    given = value.isNotNull() & (value != rule.get("missing_value", NOT_REPORTED))
    error = F.when(F.lit(bool(rule.get("required"))) & ~present, F.lit("required"))
    for broken, code in checks:
        error = error.when(given & broken, F.lit(code))
    return error


def validation_errors(fields: str | Column, spec: Mapping[str, Mapping], prefix: Column | str = "") -> Column:
    """Array of (field, error) over a map of declared fields."""
    fields = as_col(fields)
    start = F.lit(prefix) if isinstance(prefix, str) else prefix
    rows = []
    for name, rule in spec.items():
        error = field_error(F.try_element_at(fields, F.lit(name)), F.map_contains_key(fields, F.lit(name)), rule)
        rows.append(F.when(error.isNotNull(), F.struct(F.concat(start, F.lit(name)).alias("field"), error.alias("error"))))
    return F.array_compact(F.array(*rows))


def item_errors(items: str | Column, path: str, item_spec: Mapping[str, Mapping]) -> Column:
    """(field, error) rows of a list field whose items are maps of declared fields."""
    per_item = F.transform(
        as_col(items),
        lambda item, i: validation_errors(item, item_spec, F.concat(F.lit(f"{path}["), i.cast("string"), F.lit("]."))),
    )
    return F.flatten(per_item)


def outcome_spec(fields: Mapping[str, Mapping], configured: Mapping[str, Mapping] | None = None) -> dict[str, dict]:
    """Declared outcome fields, else the older item schema completed with the standard ones."""
    if configured is not None:
        return {k: dict(v) for k, v in configured.items()}
    older = dict(fields.get("outcomes", {}).get("item_schema", {}))
    if "direction" in older:
        older.setdefault("effect_direction", older["direction"])
        older.pop("direction")
    older.pop("evidence_quote", None)
    standard = {
        "domain": {"type": "string", "required": True},
        "effect_direction": {"type": "enum", "values": list(EFFECT_DIRECTIONS), "required": True},
        "support_relation": {"type": "enum", "values": list(SUPPORT_RELATIONS), "required": True},
        "evidence": {"type": "list", "required": True, "item_schema": {"quote": {"type": "string", "required": True}}},
    }
    return {**standard, **older}


def support_relation(domain: str | Column, direction: str | Column, beneficial: Mapping[str, str]) -> Column:
    """Relation implied by the domain's configured beneficial direction."""
    direction = as_col(direction)
    usable = {d: b for d, b in beneficial.items() if b in ("increase", "decrease")}
    if not usable:
        return F.lit("unclear")
    wanted = F.try_element_at(F.create_map(*[F.lit(x) for p in usable.items() for x in p]), as_col(domain))
    return (
        F.when(wanted.isNull(), "unclear")
        .when(direction == wanted, "supports")
        .when(direction.isin("increase", "decrease"), "contradicts")
        .when(direction == "no_change", "neutral")
        .when(direction == "mixed", "mixed")
        .otherwise("unclear")
    )


def location_status(manual: str | Column, checked: Column | None) -> Column:
    """Validation status of an evidence location (P56): manual, validator or unverified."""
    manual = F.coalesce(as_col(manual), F.lit(False))
    if checked is None:
        return F.when(manual, "passed").otherwise("unverified")
    return F.when(manual, "passed").otherwise(F.when(checked, "passed").otherwise("failed"))


def table_view(title: Column, rows: Column, columns: Column, cells: Column, why: Column, coverage: Column, position: Column) -> Column:
    """Cleaned table view, NULL unless both dimensions are given."""
    def text(value: Column) -> Column:
        return F.trim(F.coalesce(value, F.lit("")))

    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(coverage.try_cast("double"), F.lit(0.0))))
    view = F.struct(
        F.substring(F.coalesce(blank_to_null(text(title)), F.concat(F.lit("Summary table "), position.cast("string"))), 1, 120).alias("title"),
        F.substring(text(rows), 1, 120).alias("row_dimension"),
        F.substring(text(columns), 1, 120).alias("column_dimension"),
        F.substring(F.coalesce(blank_to_null(text(cells)), F.lit("finding; strength; citation")), 1, 200).alias("cell_schema"),
        F.substring(text(why), 1, 500).alias("coverage_rationale"),
        share.alias("coverage"),
    )
    return F.when((text(rows) != "") & (text(columns) != ""), view)


def vector_norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(left: str | Column, right: str | Column) -> Column:
    """Cosine similarity, 0 when a vector has no length."""
    left, right = as_col(left), as_col(right)
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    dot = F.aggregate(F.filter(products, lambda p: p.isNotNull()), F.lit(0.0), lambda s, p: s + p)
    scale = vector_norm(left) * vector_norm(right)
    return F.when(scale > 0, dot / scale).otherwise(F.lit(0.0))


def id_union(*values: str | Column) -> Column:
    """Ordered distinct union of id arrays, stripped and without blanks."""
    nothing = F.array().cast("array<string>")
    joined = F.concat(*[F.coalesce(as_col(v), nothing) for v in values])
    return F.array_distinct(F.filter(F.transform(joined, lambda v: F.trim(v)), lambda v: v != ""))


def outcome_filter_reasons(rule: Mapping, domain: Column, direction: Column, relation: Column) -> Column:
    """Reasons an outcome fails a section's outcome filter."""
    def allowed(key: str) -> Sequence[str]:
        value = rule.get(key, [])
        return [str(v) for v in (value if isinstance(value, (list, tuple, set)) else [value]) if str(v)]

    reasons = []
    for key, actual, reason in (
        ("outcome_domains", domain, "outcome_domain_not_matched"),
        ("effect_directions", F.coalesce(direction, F.lit("unclear")), "effect_direction_not_matched"),
        ("support_relations", F.coalesce(relation, F.lit("unclear")), "support_relation_not_matched"),
    ):
        wanted = allowed(key)
        if wanted:
            reasons.append(F.when(~F.coalesce(actual.isin(*wanted), F.lit(False)), F.lit(reason)))
    return F.array_compact(F.array(*reasons)) if reasons else F.array().cast("array<string>")
