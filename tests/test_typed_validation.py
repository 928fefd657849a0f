"""Validation of JSON documents by declared types, against a plain rerun of the rules."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from evistrata.functions import typed

SPEC = {
    "name": {"type": "string", "required": True, "validation_rule": {"pattern": "[a-z]+"}},
    "n": {"type": "integer", "validation_rule": {"min": 2, "max": 4}, "missing_value": "none"},
    "x": {"type": "number", "validation_rule": {"max": 1.5}},
    "flag": {"type": "boolean"},
    "kind": {"type": "enum", "values": ["a", "b", 3]},
    "any": {"type": "object"},
    "dotted.name": {"type": "string"},
    "rows": {"type": "list", "item_schema": {
        "quote": {"type": "string", "required": True}, "page": {"type": "integer", "missing_value": 0},
        "parts": {"type": "list", "item_schema": {"id": {"type": "integer", "required": True, "validation_rule": {"min": 1}}}}}},
}
VALUES = [None, "", "abc", "ABC", "not_reported", "none", 3, 0, 5, -1, 1.5, 2.25, 1e30, 12345678901234567890, True, False, [], {}, ["a"], {"k": 1}, "b"]
ITEMS = [[None], ["bare"], [{}], [{"quote": "q"}, {"quote": None}], [{"quote": "not_reported", "page": 0}], [{"quote": 1, "page": "1"}],
         [{"quote": "q", "parts": [{"id": 1}, {"id": 0}, {}, 7, {"id": "x"}]}], [{"quote": "q", "parts": {}}], [{"quote": "q", "page": None}]]


def is_kind(value, rule):
    whole = isinstance(value, int) and not isinstance(value, bool)
    return {"string": isinstance(value, str), "integer": whole, "number": whole or isinstance(value, float), "boolean": isinstance(value, bool),
            "enum": any(type(value) is type(v) and value == v for v in rule.get("values", [])), "list": isinstance(value, list), "object": isinstance(value, dict)}[rule["type"]]


def plain_value(path, value, rule):
    if not is_kind(value, rule):
        yield path, f"expected_{rule['type']}"
        return
    for i, item in enumerate(value if "item_schema" in rule else ()):
        if not isinstance(item, dict):
            yield f"{path}[{i}]", "expected_object"
            continue
        for name, inner in rule["item_schema"].items():
            if name not in item:
                if inner.get("required"):
                    yield f"{path}[{i}].{name}", "required"
            elif item[name] != inner.get("missing_value", "not_reported"):
                yield from plain_value(f"{path}[{i}].{name}", item[name], inner)
    limits = rule.get("validation_rule", {})
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if number and "min" in limits and value < limits["min"]:
        yield path, "below_minimum"
    if number and "max" in limits and value > limits["max"]:
        yield path, "above_maximum"
    if isinstance(value, str) and "pattern" in limits and not re.search(limits["pattern"], value):
        yield path, "pattern_mismatch"


def plain(document):
    for name, rule in SPEC.items():
        if name not in document:
            if rule.get("required"):
                yield name, "required"
        elif document[name] is not None and document[name] != rule.get("missing_value", "not_reported"):
            yield from plain_value(name, document[name], rule)


def test_typed_rules_equal_a_plain_rerun(spark):
    documents = [{"name": "abc", field: value} for field in SPEC for value in VALUES] + [{"name": "x", "rows": rows} for rows in ITEMS] + [{}, {"name": None, "other": 1}]
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(documents)], "id bigint, doc string")
    got = {r.id: [tuple(e) for e in r.e] for r in rows.select("id", typed.document_errors("doc", SPEC).alias("e")).collect()}
    for i, document in enumerate(documents):
        assert got[i] == list(plain(document)), document


def test_other_texts_are_no_object(spark):
    rows = spark.createDataFrame([(t,) for t in (None, "", "no json", "[1]", "3", '{"name": ')], "doc string")
    for row in rows.select(typed.document_errors("doc", SPEC).alias("e")).collect():
        assert [tuple(e) for e in row.e] == [("", "expected_object")]
    assert rows.limit(0).select(F.inline(typed.document_errors("doc", SPEC))).count() == 0


def test_a_document_is_parsed_once(spark):
    """Written out per rule, the parse was multiplied at every level of items; under inner generators Spark repeats it in a filter."""
    rows = spark.createDataFrame([(1, '{"name": "x"}')], "id bigint, doc string")
    checked = typed.error_rows(rows, ["id"], "doc", SPEC)
    fields = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", 10000)
    try:
        plan = checked._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", fields)
    assert plan.lower().count("parsejson") + plan.lower().count("parse_json") == 1, plan


def test_limits_of_lists_in_any_rule(spark):
    spec = {"rows": {"type": "list", "missing_value": [], "item_schema": {"a": {"type": "object", "required": True}}}, "tags": {"type": "list", "missing_value": "none"}}
    texts = ['{"rows": [], "tags": "none"}', ' {"rows": [{"a": {}}, {"a": []}, {}], "tags": [1]}', '{"rows": 1, "tags": "no"}']
    rows = spark.createDataFrame(list(enumerate(texts)), "id bigint, doc string")
    got = {r.id: [tuple(e) for e in r.e] for r in rows.select("id", typed.document_errors("doc", spec).alias("e")).collect()}
    assert got == {0: [], 1: [("rows[1].a", "expected_object"), ("rows[2].a", "required")], 2: [("rows", "expected_list"), ("tags", "expected_list")]}
