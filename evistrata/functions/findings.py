"""Finding normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evistrata.common import as_col
from evistrata.functions.text import strip, vocabulary

# The vocabularies of findings.
RELEVANCE_LEVELS = ("direct", "indirect", "background", "irrelevant")
RELATION_DIRECTIONS = (
    "increase", "decrease", "positive_association", "negative_association", "no_association", "mixed", "not_applicable",
)
VARIABLE_ROLES = ("exposure", "outcome", "mediator", "moderator", "descriptor", "unknown")
RELATION_FIELDS = ("subject", "predicate", "object", "qualifier")
CONTEXT_FIELDS = ("study_type", "sample_or_system", "condition", "method")

PAYLOAD_SCHEMA = "relevant boolean, findings array<string>"
FINDING_SCHEMA = (
    "claim string, quote string, cite_key string, relevance_level string, include_in_main_report string, "
    "relation struct<subject:string,predicate:string,object:string,qualifier:string,direction:string>, "
    "context struct<study_type:string,sample_or_system:string,condition:string,method:string>, "
    "variables array<string>, constraints array<string>, tags map<string,string>, topic_tags map<string,string>"
)
VARIABLE_SCHEMA = "name string, role string"


def _text(value: Column) -> Column:
    return strip(F.coalesce(value, F.lit("")))


def _tags(value: Column) -> Column:
    """Tags with stripped keys and values, blanks dropped."""
    kept = F.filter(
        F.transform(F.map_entries(value), lambda e: F.struct(strip(e["key"]).alias("key"), _text(e["value"]).alias("value"))),
        lambda e: (e["key"] != "") & (e["value"] != ""))
    return F.map_from_entries(kept)


def _variables(items: Column) -> Column:
    """Named variables with a role from the vocabulary; plain strings have role unknown."""
    def read(item: Column) -> Column:
        plain = F.struct(item.alias("name"), F.lit("unknown").alias("role"))
        return F.when(item.startswith("{"), F.from_json(item, VARIABLE_SCHEMA)).otherwise(plain)

    def tidy(v: Column) -> Column:
        return F.struct(_text(v["name"]).alias("name"), F.lower(_text(v["role"])).alias("role"))

    named = F.filter(F.transform(F.transform(items, read), tidy), lambda v: v["name"] != "")
    return F.transform(named, lambda v: v.withField("role", vocabulary(v["role"], VARIABLE_ROLES, "unknown")))


def finding_shape(raw: Column) -> Column:
    """Finding struct with closed vocabularies, text values and no blank entries."""
    relation = [_text(raw["relation"][f]).alias(f) for f in RELATION_FIELDS]
    direction = vocabulary(F.lower(_text(raw["relation"]["direction"])), RELATION_DIRECTIONS, "not_applicable")
    none = F.create_map().cast("map<string,string>")
    topic = F.coalesce(_tags(raw["topic_tags"]), none)
    older = F.coalesce(_tags(raw["tags"]), none)
    nothing = F.array().cast("array<string>")
    variables = _variables(F.coalesce(raw["variables"], nothing))
    constraints = F.filter(F.transform(F.coalesce(raw["constraints"], nothing), _text), lambda c: c != "")
    return F.struct(
        raw["claim"].alias("claim"), raw["quote"].alias("quote"), raw["cite_key"].alias("cite_key"),
        raw["relevance_level"].alias("relevance_level"), raw["include_in_main_report"].alias("include_given"),
        F.struct(*relation, direction.alias("direction")).alias("relation"),
        F.struct(*[_text(raw["context"][f]).alias(f) for f in CONTEXT_FIELDS]).alias("context"),
        variables.alias("variables"), constraints.alias("constraints"),
        F.when(F.size(topic) > 0, topic).otherwise(older).alias("topic_tags"),
    )


def normalize_payload(payload: str | Column) -> Column:
    """Struct of the stated relevance and the usable findings of one document's JSON result (P25).

    Entries that are not objects and findings judged irrelevant are dropped; the
    document is relevant when it says so or keeps a finding.
    """
    parsed = F.from_json(as_col(payload), PAYLOAD_SCHEMA)
    relevant = F.coalesce(parsed["relevant"], F.lit(False))
    objects = F.filter(F.coalesce(parsed["findings"], F.array().cast("array<string>")), lambda f: f.startswith("{"))

    # Each pass binds the result of the one before, so every JSON text is parsed once.
    def judged(shaped: Column) -> Column:
        level = F.lower(_text(shaped["relevance_level"]))
        fallback = F.when(relevant, "direct").otherwise("irrelevant")
        level = F.when(level.isin(*RELEVANCE_LEVELS), level).otherwise(fallback)
        refused = F.coalesce(F.lower(shaped["include_given"]).isin("false", "0", ""), F.lit(False))
        return shaped.withField("relevance_level", level).withField("include_given", F.when(refused, "no").otherwise("yes"))

    read = F.transform(objects, lambda item: F.from_json(item, FINDING_SCHEMA))
    levelled = F.transform(F.transform(read, finding_shape), judged)
    included = F.transform(levelled, lambda f: f.withField(
        "include_in_main_report", (f["relevance_level"] == "direct") & (f["include_given"] == "yes")).dropFields("include_given"))
    return F.struct(relevant.alias("relevant"), F.filter(included, lambda f: f["relevance_level"] != "irrelevant").alias("findings"))


def metadata_text(relation: Column, context: Column, variables: Column, tags: Column) -> Column:
    """Non-empty parts of a finding as one line."""
    def pairs(struct: Column, names) -> list[Column]:
        return [F.when(F.coalesce(struct[n], F.lit("")) != "", F.concat(F.lit(f"{n}="), struct[n])) for n in names]

    directed = F.when(struct_given(relation["direction"]) & (relation["direction"] != "not_applicable"), F.concat(F.lit("direction="), relation["direction"]))
    named = F.filter(variables, lambda v: F.coalesce(v["name"], F.lit("")) != "")
    parts = (
        ("relation: ", F.concat_ws("; ", *pairs(relation, RELATION_FIELDS), directed)),
        ("context: ", F.concat_ws("; ", *pairs(context, CONTEXT_FIELDS))),
        ("variables: ", F.array_join(F.transform(named, lambda v: F.concat(v["name"], F.lit("("), F.coalesce(v["role"], F.lit("unknown")), F.lit(")"))), ", ")),
        ("topic_tags: ", F.array_join(F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ")),
    )
    text = F.concat_ws(" | ", *[F.when(body != "", F.concat(F.lit(label), body)) for label, body in parts])
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("metadata: none"))


def struct_given(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) != ""


def claim_shape(claim: Column, scope: Column, refs: Column, certainty: Column, location: Column) -> Column:
    """Claim with integer references and bounded texts."""
    numbers = F.filter(F.transform(F.coalesce(refs, F.array().cast("array<string>")), lambda r: strip(r).try_cast("bigint")), lambda n: n.isNotNull())
    return F.struct(
        F.substring(F.coalesce(claim, F.lit("")), 1, 1000).alias("claim"), F.substring(F.coalesce(scope, F.lit("")), 1, 500).alias("scope"),
        numbers.alias("evidence_refs"), F.coalesce(certainty, F.lit("unclear")).alias("certainty"),
        F.substring(F.coalesce(location, F.lit("")), 1, 300).alias("location"))
