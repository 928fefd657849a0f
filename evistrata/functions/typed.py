"""Validation of JSON documents by declared types (P37, P57), on Spark's VARIANT.

A document is parsed once into a variant, whose values know their JSON type; the rules are
configuration and become one expression, nested as deep as the declared items are.  Every value is
bound before its rules read it: written out in each of them, its own expression would be run, and
the document parsed, once per use, multiplied at every level of items.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evistrata.common import as_col
from evistrata.functions.values import NOT_REPORTED

ERRORS = "array<struct<field:string,error:string>>"
# Whole numbers beyond 64 bits are decimals of scale 0; shorter such decimals were written as 1.0.
_SHAPES = {
    "string": "^STRING$", "number": r"^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$", "integer": r"^(BIGINT|DECIMAL\((19|[23]\d),0\))$",
    "boolean": "^BOOLEAN$", "list": "^ARRAY<", "object": "^OBJECT<",
}


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _member(value: Column, name: str) -> Column:
    """Value of one key; NULL when the key is absent, a null variant when it holds null."""
    if '"' in name:
        raise ValueError(f"field names hold no double quotes: {name}")
    return F.try_variant_get(value, f'$["{name}"]', "variant")


def _text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _equals(value: Column, kind: Column, constant: object) -> Column:
    """Whether a value of type ``kind`` is the constant, in type too."""
    if isinstance(constant, str):
        return (kind == "STRING") & (_text(value) == constant)
    return (kind != "STRING") & (F.to_json(value) == json.dumps(constant, separators=(",", ":")))


def _any_of(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for condition in conditions:
        out = out | condition
    return out


def _error(path: Column, code: str) -> Column:
    return F.struct(path.alias("field"), F.lit(code).alias("error"))


def _is_kind(value: Column, kind: Column, rule: Mapping) -> Column:
    if rule["type"] == "enum":
        texts = [v for v in rule.get("values", []) if isinstance(v, str)]
        others = [_equals(value, kind, v) for v in rule.get("values", []) if not isinstance(v, str)]
        return _any_of([(kind == "STRING") & _text(value).isin(texts), *others] if texts else others)
    return kind.rlike(_SHAPES[rule["type"]])


def _items(value: Column) -> Column:
    """Items of a list, NULL for other values."""
    return F.try_variant_get(value, "$", "array<variant>")


def _list_errors(items: Column, path: Column, rule: Mapping) -> Column:
    if not isinstance(rule.get("item_schema"), Mapping):
        return F.array().cast(ERRORS)
    return F.flatten(F.transform(items, lambda item, i: _bound(
        F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), lambda at: _item_errors(item, at, rule["item_schema"]))))


def value_errors(value: Column, kind: Column, path: Column, rule: Mapping) -> Column:
    """Errors of one given value of type ``kind``: its type, else its items and its limits."""
    limits = rule.get("validation_rule") or {}
    found = [F.array().cast(ERRORS)]
    if rule["type"] == "list":
        found.append(_list_errors(_items(value), path, rule))
    number = F.when(kind.rlike(_SHAPES["number"]), F.try_variant_get(value, "$", "double"))
    checks = []
    if "min" in limits:
        checks.append(F.when(number < float(limits["min"]), _error(path, "below_minimum")))
    if "max" in limits:
        checks.append(F.when(number > float(limits["max"]), _error(path, "above_maximum")))
    if "pattern" in limits:
        checks.append(F.when((kind == "STRING") & ~_text(value).rlike(str(limits["pattern"])), _error(path, "pattern_mismatch")))
    if checks:
        found.append(F.array_compact(F.array(*checks)))
    return F.when(~_is_kind(value, kind, rule), F.array(_error(path, f"expected_{rule['type']}"))).otherwise(F.concat(*found))


def _member_errors(holder: Column, name: str, path: Column, rule: Mapping, null_passes: bool) -> Column:
    """Errors of one key of an object: absent, given as missing, or those of its value."""
    nothing = F.array().cast(ERRORS)
    absent = F.array(_error(path, "required")) if rule.get("required") else nothing

    def given(value: Column, kind: Column) -> Column:
        skipped = _equals(value, kind, rule.get("missing_value", NOT_REPORTED))
        if null_passes:
            skipped = F.is_variant_null(value) | skipped
        return F.when(value.isNull(), absent).when(skipped, nothing).otherwise(value_errors(value, kind, path, rule))

    def judged(value: Column) -> Column:
        typed = _bound(F.schema_of_variant(value), lambda kind: given(value, kind))
        if rule["type"] != "list" or not isinstance(rule.get("missing_value", NOT_REPORTED), str):
            return typed
        # A list needs no schema, which would walk all of its items.
        return _bound(_items(value), lambda items: F.when(items.isNotNull(), _list_errors(items, path, rule)).otherwise(typed))

    return _bound(_member(holder, name), judged)


def _item_errors(item: Column, path: Column, schema: Mapping[str, Mapping]) -> Column:
    """Errors of one list item, which has to be an object; a null in it is a value of the wrong type."""
    found = [_member_errors(item, name, F.concat(path, F.lit(f".{name}")), rule, null_passes=False) for name, rule in schema.items()]
    is_object = F.try_variant_get(item, "$", "map<string,variant>").isNotNull()
    return F.when(is_object, F.concat(F.array().cast(ERRORS), *found)).otherwise(F.array(_error(path, "expected_object")))


def document_errors(document: str | Column, spec: Mapping[str, Mapping]) -> Column:
    """Array of (field, error) of a JSON text under ``spec`` (P37, P57), in the order of the fields.

    A required field is one whose key must be there; null and the field's missing value pass.  A
    text that is not a JSON object has the one error ``expected_object`` with an empty field; so
    has NULL.  Patterns are searched for, in Java's syntax.
    """
    # What parses and begins with a brace is an object; its schema would be written out to tell so.
    braced = F.ltrim(as_col(document), F.lit(" \t\r\n")).startswith("{")

    def errors(value: Column) -> Column:
        found = [_member_errors(value, name, F.lit(name), rule, null_passes=True) for name, rule in spec.items()]
        return F.when(value.isNotNull(), F.concat(F.array().cast(ERRORS), *found)).otherwise(F.array(_error(F.lit(""), "expected_object")))

    return _bound(F.when(braced, F.try_parse_json(as_col(document))), errors)


def error_rows(rows: DataFrame, keys: Sequence[str], document: str | Column, spec: Mapping[str, Mapping]) -> DataFrame:
    """:func:`document_errors` as rows of (keys, field, error).

    The outer generator: under an inner one Spark infers a filter that validates every document again.
    """
    return rows.select(*keys, F.inline_outer(document_errors(document, spec))).filter("field is not null")
