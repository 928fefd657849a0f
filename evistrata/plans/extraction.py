"""Queries over versioned extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from evistrata.common import cut_lineage
from evistrata.functions import typed
from evistrata.functions import values as V
from evistrata.functions.keys import configured_outcome_key, outcome_identity, stable_id
from evistrata.operators import extraction as ops
from evistrata.plans.bindings import OUTCOMES_SQL, outcomes, studies
from evistrata.plans.registry import query, table


@query("p34_dotted_fields", """
select event_id, case when event_id % 3 = 0 then 'flat' when event_id % 3 = 1 then cast(cast(json_extract(props, '$.k') as bigint) as varchar) else 'not_reported' end as value from events""")
def p34(spark, d):
    e = F.col("event_id") % 3
    flat = F.when(e == 0, F.create_map(F.lit("a.k"), F.lit("flat"))).otherwise(F.create_map(F.lit("z"), F.lit("z")))
    doc = F.when(e == 1, F.concat(F.lit('{"a":'), "props", F.lit("}"))).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", V.dotted("a.k", flat, doc).alias("value"))


@query("p35_display", """
select event_id, case when event_id % 4 = 0 then 'not_reported' else event_type end as shown, case when event_id % 5 = 0 then 'not_reported' else '["' || event_type || '","' || user_id || '"]' end as listed from events""")
def p35(spark, d):
    e = F.col("event_id")
    shown = F.when(e % 8 == 0, "").when(e % 4 == 0, None).otherwise(F.col("event_type"))
    listed = F.when(e % 5 != 0, F.array("event_type", F.col("user_id").cast("string")))
    return table(spark, d, "events").select("event_id", V.display(shown).alias("shown"), V.display_json(listed).alias("listed"))


SPEC = {
    "type": {"type": "enum", "values": ["ECONOMY", "STANDARD", "PROMO"], "required": True},
    "size": {"type": "integer", "required": True, "missing_value": "none", "validation_rule": {"min": 5, "max": 40}},
    "price": {"type": "number", "default": "1.5"},
    "brand": {"type": "string", "required": True, "validation_rule": {"pattern": "#[12]$"}},
    "note": {"type": "boolean"},
}


def declared(spark, d):
    k = F.col("p_partkey")
    pairs = F.filter(F.array(
        F.struct(F.lit("type").alias("k"), F.col("p_type").alias("v")),
        F.struct(F.lit("size").alias("k"), F.when(k % 7 == 0, "x").otherwise(F.col("p_size").cast("string")).alias("v")),
        F.when(k % 3 == 0, F.struct(F.lit("price").alias("k"), F.col("p_retailprice").cast("string").alias("v"))),
        F.when(k % 5 != 0, F.struct(F.lit("brand").alias("k"), F.col("p_brand").alias("v"))),
        F.when(k % 4 == 0, F.struct(F.lit("note").alias("k"), F.when(k % 8 == 0, "true").otherwise("yes").alias("v"))),
    ), lambda p: p.isNotNull())
    return table(spark, d, "part").select("p_partkey", F.map_from_entries(pairs).alias("fields"))


@query("p36_missing_values", """
select p_partkey, case when p_partkey % 3 = 0 then 'given' else '1.5' end as price, case when p_partkey % 5 = 0 then 'not_reported' else p_brand end as brand, case when p_partkey % 7 = 0 then 'x' else cast(p_size as varchar) end as size from part""")
def p36(spark, d):
    f = declared(spark, d).select("p_partkey", V.with_missing_values("fields", SPEC).alias("f"))
    return f.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, "given").otherwise(F.col("f.price")).alias("price"), F.col("f.brand").alias("brand"), F.col("f.size").alias("size"))


@query("p37_validation_errors", """
select p_partkey, 'type' as field, 'expected_enum' as error from part where p_type not in ('ECONOMY', 'STANDARD', 'PROMO')
union all select p_partkey, 'size', 'expected_integer' from part where p_partkey % 7 = 0
union all select p_partkey, 'size', 'below_minimum' from part where p_partkey % 7 <> 0 and p_size < 5
union all select p_partkey, 'size', 'above_maximum' from part where p_partkey % 7 <> 0 and p_size > 40
union all select p_partkey, 'brand', 'required' from part where p_partkey % 5 = 0
union all select p_partkey, 'brand', 'pattern_mismatch' from part where p_partkey % 5 <> 0 and p_brand not in ('Brand#1', 'Brand#2')
union all select p_partkey, 'note', 'expected_boolean' from part where p_partkey % 8 = 4""")
def p37(spark, d):
    return declared(spark, d).select("p_partkey", F.inline_outer(V.validation_errors("fields", SPEC))).filter("field is not null")


@query("p37_item_errors", """
with i as (select c_custkey, unnest([0, 1]) as i from customer)
select c_custkey, 'items[' || i || '].quote' as field, 'required' as error from i where (c_custkey + i) % 3 = 0
union all select c_custkey, 'items[' || i || '].page', 'expected_integer' from i where (c_custkey + i) % 4 = 1""")
def p37b(spark, d):
    k = F.col("c_custkey")
    def item(i):
        page = F.when((k + i) % 4 == 1, "p9").otherwise("9")
        return F.when((k + i) % 3 == 0, F.create_map(F.lit("page"), page)).otherwise(F.create_map(F.lit("page"), page, F.lit("quote"), F.lit("q")))
    spec = {"quote": {"type": "string", "required": True}, "page": {"type": "integer"}}
    return table(spark, d, "customer").select("c_custkey", F.inline_outer(V.item_errors(F.array(item(0), item(1)), "items", spec))).filter("field is not null")


@query("p57_outcome_spec_errors", f"""
with {OUTCOMES_SQL}, r as (select outcome_id, case when pk % 13 = 0 then 'upwards' else effect_direction end as effect_direction, case when pk % 17 = 0 then null else support_relation end as support_relation, n_evidence from outc)
select outcome_id, 'effect_direction' as field, 'expected_enum' as error from r where effect_direction = 'upwards'
union all select outcome_id, 'support_relation', 'required' from r where support_relation is null""")
def p57(spark, d):
    o = outcomes(spark, d, "pk")
    pk_direction = F.when(F.col("pk") % 13 == 0, "upwards").otherwise(F.col("effect_direction"))
    pairs = F.array_compact(F.array(
        F.struct(F.lit("domain").alias("k"), F.col("domain").alias("v")), F.struct(F.lit("effect_direction").alias("k"), pk_direction.alias("v")),
        F.when(F.col("pk") % 17 != 0, F.struct(F.lit("support_relation").alias("k"), F.col("support_relation").alias("v"))),
        F.struct(F.lit("evidence").alias("k"), F.to_json("evidence").alias("v"))))
    spec = V.outcome_spec({"outcomes": {"item_schema": {"direction": {"type": "enum", "values": list(V.EFFECT_DIRECTIONS), "required": True}, "evidence_quote": {"type": "string"}}}})
    fields = o.select("outcome_id", F.map_from_entries(pairs).alias("fields"))  # a column of its own: built once a row
    return fields.select("outcome_id", F.inline_outer(V.validation_errors("fields", spec))).filter("field is not null")


TYPED_SPEC = {
    "type": {"type": "enum", "values": ["ECONOMY", "STANDARD", "PROMO"], "required": True},
    "size": {"type": "integer", "required": True, "validation_rule": {"min": 5, "max": 40}},
    "price": {"type": "number"},
    "note": {"type": "string", "validation_rule": {"pattern": "^s"}},
    "meta": {"type": "object"},
    "evidence": {"type": "list", "required": True, "item_schema": {"quote": {"type": "string", "required": True}, "page": {"type": "integer", "validation_rule": {"min": 3}}}},
}


@query("p37_typed_errors", """
select p_partkey, 'type' as field, 'expected_enum' as error from part where p_type not in ('ECONOMY', 'STANDARD', 'PROMO')
union all select p_partkey, 'size', case p_brand when 'Brand#2' then 'expected_integer' when 'Brand#4' then 'required' else case when p_size < 5 then 'below_minimum' else 'above_maximum' end end from part
  where p_brand in ('Brand#2', 'Brand#4') or p_size < 5 or p_size > 40
union all select p_partkey, 'price', 'expected_number' from part where p_brand = 'Brand#3'
union all select p_partkey, 'note', 'pattern_mismatch' from part where p_name not like 's%'
union all select p_partkey, 'meta', 'expected_object' from part where p_brand = 'Brand#5'
union all select p_partkey, 'evidence', 'required' from part where p_brand = 'Brand#6'
union all select p_partkey, 'evidence[0].page', 'below_minimum' from part where p_brand <> 'Brand#6' and p_size < 3
union all select p_partkey, 'evidence[1]', 'expected_object' from part where p_brand <> 'Brand#6' and p_type = 'ECONOMY'
union all select p_partkey, unnest(['evidence[1].quote', 'evidence[1].page']), unnest(['required', 'expected_integer']) from part where p_brand <> 'Brand#6' and p_type <> 'ECONOMY'
union all select p_partkey, 'evidence[2].quote', 'expected_string' from part where p_brand <> 'Brand#6'""")
def p37_typed(spark, d):
    def brand(n):
        return F.col("p_brand") == f"Brand#{n}"
    size = F.col("p_size").cast("string")
    stated = F.when(brand(2), F.format_string('"size": "%s", ', size)).when(brand(4), "").otherwise(F.format_string('"size": %s, ', size))
    listed = F.format_string(', "evidence": [{"quote": "%s", "page": %s}, %s, {"quote": null, "page": 9}]', "p_name", size,
                             F.when(F.col("p_type") == "ECONOMY", '"bare"').otherwise('{"page": 1.5}'))
    document = F.concat(F.lit('{"type": "'), "p_type", F.lit('", '), stated, F.lit('"price": '), F.when(brand(3), "true").otherwise(F.col("p_retailprice").cast("string")),
                        F.lit(', "note": "'), "p_name", F.lit('", "meta": '), F.when(brand(5), "[]").otherwise("{}"), F.when(brand(6), "").otherwise(listed), F.lit("}"))
    return typed.error_rows(table(spark, d, "part"), ["p_partkey"], document, TYPED_SPEC)


@query("p57_typed_outcome_errors", f"""
with {OUTCOMES_SQL}, r as (select *, unnest(generate_series(0, n_evidence - 1)) as i from outc where n_evidence > 0)
select outcome_id, 'evidence[' || i || '].quote' as field, 'required' as error from r where validation_status = 'failed'
union all select outcome_id, 'effect_direction', 'expected_enum' from outc where effect_direction = 'mixed'""")
def p57_typed(spark, d):
    o = outcomes(spark, d)
    quoted = F.transform("evidence", lambda e: F.struct(F.when(e["validation_status"] != "failed", e["quote"]).alias("quote"), e["page"].alias("page")))
    direction = F.when(F.col("effect_direction") == "mixed", "both").otherwise(F.col("effect_direction")).alias("effect_direction")
    document = F.to_json(F.struct("domain", direction, "support_relation", quoted.alias("evidence")))
    return typed.error_rows(o, ["outcome_id"], document, V.outcome_spec({}))


@query("p38_support_relation", f"""
with {OUTCOMES_SQL} select outcome_id, case when domain not in ('d0', 'd1') then 'unclear' when effect_direction = case domain when 'd0' then 'increase' else 'decrease' end then 'supports'
  when effect_direction in ('increase', 'decrease') then 'contradicts' when effect_direction = 'no_change' then 'neutral' when effect_direction = 'mixed' then 'mixed' else 'unclear' end as relation from outc""")
def p38(spark, d):
    return outcomes(spark, d).select("outcome_id", V.support_relation("domain", "effect_direction", {"d0": "increase", "d1": "decrease", "d2": "sideways"}).alias("relation"))


@query("p39_migrated_direction", f"""
with {OUTCOMES_SQL} select outcome_id, case when pk_ % 3 = 2 then 'unclear' else effect_direction end as effect_direction, (pk_ % 3 = 1)::int as warned from (select *, l_orderkey as pk_ from outc)""")
def p39(spark, d):
    k = F.col("seq") % 3
    o = outcomes(spark, d).select("study_id", "outcome_id", F.when(k == 0, F.col("effect_direction")).alias("effect_direction"), F.when(k == 1, F.col("effect_direction")).alias("direction"))
    moved, warnings = ops.migrate_direction(o)
    flags = warnings.select("outcome_id", F.lit(1).alias("w"))
    return moved.join(flags, "outcome_id", "left").select("outcome_id", "effect_direction", F.coalesce("w", F.lit(0)).alias("warned"))


@query("p43_focus_terms", """
with t as (select p_partkey as seq, unnest([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), p_type, 'find ' || p_size, p_brand]) as term, unnest([0, 1, 2, 3, 4]) as pos from part),
r as (select *, row_number() over (partition by term order by seq, pos) as rn from t where term <> '') select term, seq, pos from r where rn = 1""")
def p43(spark, d):
    spec = table(spark, d, "part").select(
        F.col("p_partkey").alias("seq"), F.replace("p_name", F.lit(" "), F.lit(".")).alias("name"), F.concat(F.col("p_type"), F.lit(" ")).alias("description"),
        F.concat(F.lit("find "), F.col("p_size").cast("string")).alias("instruction"), F.array(F.col("p_brand")).alias("aliases"))
    return ops.focus_terms(spec)


def versioned(spark, d):
    """Outcomes with run metadata on their evidence."""
    o = outcomes(spark, d).withColumn("extraction_run_id", F.lit("run1"))
    located = F.transform("evidence", lambda e, i: F.struct(
        e["quote"].alias("quote"), e["page"].alias("page"), F.lit("").alias("section"), F.lit("").alias("figure"), F.lit("").alias("table"),
        e["validation_status"].alias("validation_status"), F.when((F.col("seq") + i) % 6 == 0, "superseded").otherwise("active").alias("status"),
        F.when((F.col("seq") + i) % 5 == 0, "run0").otherwise("run1").alias("extraction_run_id")))
    return o.withColumn("evidence", located)


@query("w13_evidence_rows", f"""
with {OUTCOMES_SQL}, e as (select *, unnest(generate_series(0, n_evidence - 1)) as i from outc where n_evidence > 0)
select 'evidence_' || substr(sha256(to_json([study_id, outcome_id, 'quote ' || substr(outcome_id, 2), cast(i + 1 as varchar), '', '', '', cast(i as varchar)])::varchar), 1, 16) as evidence_id, study_id, outcome_id, cast(i as int) as ordinal, validation_status
from e where (l_orderkey + i) % 6 <> 0 and (l_orderkey + i) % 5 <> 0""")
def w13(spark, d):
    return ops.evidence_rows(versioned(spark, d), current_only=True).select("evidence_id", "study_id", "outcome_id", "ordinal", "validation_status")


@query("p56_location_status", f"""
with {OUTCOMES_SQL} select outcome_id, case when l_orderkey % 4 = 0 then 'passed' when validation_status = 'failed' then 'failed' else 'passed' end as status,
  (l_orderkey % 4 <> 0 and validation_status = 'failed')::int as error, case when l_orderkey % 4 = 0 then 'passed' else 'unverified' end as unchecked from outc""")
def p56(spark, d):
    o = outcomes(spark, d)
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("sk"))
    flags = li.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("outcome_id"), (F.col("sk") % 7 != 0).alias("ok"))
    loc = o.join(flags, "outcome_id").select("study_id", "outcome_id", F.lit("q").alias("quote"), (F.col("seq") % 4 == 0).alias("manual_verified"), "ok")
    judged, errors = ops.judge_locations(loc, F.col("ok"))
    unchecked, _ = ops.judge_locations(loc.select("study_id", "outcome_id", "quote", "manual_verified"))
    return (judged.select("outcome_id", F.col("validation_status").alias("status")).join(errors.select("outcome_id", F.lit(1).alias("e")), "outcome_id", "left")
            .join(unchecked.select("outcome_id", F.col("validation_status").alias("unchecked")), "outcome_id").select("outcome_id", "status", F.coalesce("e", F.lit(0)).alias("error"), "unchecked"))


# Two snapshots of the outcome of every order and line: ids must survive, lost lines close.
def snapshot(spark, d, keep, explicit):
    o = outcomes(spark, d).filter(keep)
    line = F.substring_index("outcome_id", "-", -1)
    fields = [("domain", F.concat(F.lit("line"), line)), ("timepoint", F.lit("unknown"))]
    key = configured_outcome_key("study_id", fields)
    given = F.when(explicit, F.concat(F.lit("X"), "outcome_id")).otherwise("")
    identity = outcome_identity("study_id", given, F.lit(""), F.lit(""), line, fields)
    named = o.select("study_id", F.concat(F.lit("p"), (F.col("seq") % 500).cast("string")).alias("publication_id"), F.col("outcome_id").alias("row_id"), "seq",
                     identity["identity_key"].alias("identity_key"), given.alias("explicit_id"), key.alias("configured"))
    aliases = F.array_compact(F.array(F.col("identity_key"), F.nullif("explicit_id", F.lit("")), F.col("configured")))
    return named.withColumn("aliases", aliases)


def two_versions(spark, d, **kept):
    old = snapshot(spark, d, "seq % 500 < 400 and domain <> 'd1'", F.col("seq") % 10 == 0)
    previous = old.withColumns({
        "outcome_id": F.coalesce(F.nullif("explicit_id", F.lit("")), stable_id("outcome", "study_id", "identity_key")),
        "extraction_run_id": F.lit("run1"), "extraction_version": F.lit(1), "status": F.lit("active")})
    previous = cut_lineage(previous)
    new = cut_lineage(snapshot(spark, d, "seq % 500 >= 100 and domain <> 'd2'", F.col("seq") % 20 == 5))
    return previous, new, ops.reingest(previous, new, "run2", **kept)


def _okey(expr: str) -> str:
    return f"'outcome_' || substr(sha256(to_json([study_id, {expr}])::varchar), 1, 16)"


VERSION_SQL = f"""
{OUTCOMES_SQL},
k as (select *, l_orderkey % 500 as pub, 'outcome-configured-key_' || substr(sha256(to_json([study_id, 'domain=line' || l_linenumber])::varchar), 1, 16) as ckey from outc),
prev as (select *, case when l_orderkey % 10 = 0 then 'X' || outcome_id else {_okey('ckey')} end as id from k where pub < 400 and domain <> 'd1'),
new as (select k.*, case when k.l_orderkey % 20 = 5 then 'X' || k.outcome_id else coalesce(p.id, {_okey('k.ckey').replace('study_id', 'k.study_id')}) end as id, p.id as matched,
    case when k.pub < 400 and exists (select 1 from prev q where q.pub = k.pub) then 2 else 1 end as version
  from k left join prev p using (outcome_id) where k.pub >= 100 and k.domain <> 'd2')"""


@query("w5_reingest_opened", f"""
with {VERSION_SQL} select outcome_id as row_id, id as outcome_id, cast(version as int) as extraction_version, case when matched is not null then 'run1' else '' end as supersedes from new""")
def w5(spark, d):
    return two_versions(spark, d)[2].opened.select("row_id", "outcome_id", "extraction_version", "supersedes")


@query("w5_reingest_state", f"""
with {VERSION_SQL} select id as outcome_id, 'run2' as extraction_run_id, 'active' as status from new
union all select id, 'run1', 'superseded' from prev where pub in (select pub from new) and id not in (select id from new)
union all select id, 'run1', 'active' from prev where pub not in (select pub from new)""")
def w5b(spark, d):
    return two_versions(spark, d, keep=cut_lineage)[2].state.select("outcome_id", "extraction_run_id", "status")


@query("w3_current_rows", f"""
with {VERSION_SQL} select id as outcome_id, 'run2' as extraction_run_id from new union all select id, 'run1' from prev where pub not in (select pub from new)""")
def w3(spark, d):
    previous, _, result = two_versions(spark, d, keep=cut_lineage)
    columns = ["outcome_id", "extraction_run_id", "status", "seq"]
    ledger = previous.select(columns).unionByName(result.closed.select(columns)).unionByName(result.opened.select(columns))
    return ops.current_rows(ledger, result.state, "outcome_id", strict=True).select("outcome_id", "extraction_run_id")


@query("w14_current_errors", """
with e as (select event_id, case when user_id % 2 = 0 then 'outcome' else 'study' end as entity_type, user_id as id, case event_id % 4 when 0 then 'run1' when 1 then 'run2' else '' end as run,
  case when event_id % 6 = 0 then 'resolved' else 'active' end as status from events),
s as (select distinct user_id as id, case when user_id % 2 = 0 then 'outcome' else 'study' end as entity_type, 'run' || (1 + user_id % 2) as run, 1 + user_id % 2 as version from events where user_id % 5 <> 0)
select event_id from e left join s using (entity_type, id) where status <> 'resolved' and (s.run is null or case when e.run <> '' then e.run = s.run else version = 1 end)""")
def w14(spark, d):
    e, u = F.col("event_id"), F.col("user_id")
    kind = F.when(u % 2 == 0, "outcome").otherwise("study").alias("entity_type")
    ev = table(spark, d, "events")
    errors = ev.select("event_id", kind, u.cast("string").alias("entity_id"), F.when(e % 4 == 0, "run1").when(e % 4 == 1, "run2").otherwise("").alias("extraction_run_id"),
                       F.when(e % 6 == 0, "resolved").otherwise("active").alias("status"))
    state = ev.filter("user_id % 5 <> 0").select(kind, u.cast("string").alias("entity_id"), F.concat(F.lit("run"), (1 + u % 2).cast("string")).alias("extraction_run_id"), (1 + u % 2).alias("extraction_version")).distinct()
    return ops.current_errors(errors, state).select("event_id")


@query("j35_extraction_links", """
with m as (select 'p' || c_custkey as publication_id, case when c_custkey % 4 = 0 then null else 'r' || c_custkey end as record_id from customer)
select 'study' as kind, 's' || o_orderkey as id, record_id from orders join m on publication_id = 'p' || o_custkey union all select 'error', publication_id, null from m where record_id is null""")
def j35(spark, d):
    k = F.col("c_custkey")
    matches = table(spark, d, "customer").select(
        F.concat(F.lit("p"), k.cast("string")).alias("publication_id"), F.when(k % 4 != 0, F.concat(F.lit("r"), k.cast("string"))).alias("record_id"),
        F.lit("doi").alias("link_method"), F.lit("exact").alias("confidence"), F.lit("f.pdf").alias("source_file"))
    _, by_study, errors = ops.extraction_links(matches, studies(spark, d), "h")
    return by_study.select(F.lit("study").alias("kind"), F.col("study_id").alias("id"), "record_id").unionByName(
        errors.select(F.lit("error").alias("kind"), F.col("publication_id").alias("id"), F.lit(None).cast("string").alias("record_id")))
