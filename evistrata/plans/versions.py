"""Queries over versions of all entities of an extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from evistrata.common import written
from evistrata.operators import versions as ops
from evistrata.plans.registry import query, table


def _text(*parts):
    return F.concat(*[p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts])


def orders_and_lines(spark, d, versions):
    """Orders with a customer and lines with an order of either version, each written once, with flags v0 and v1.

    ``versions``: market segment, order status and return flag that each leaves out.
    """
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.col("o_totalprice").cast("bigint").alias("price"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus").repartition("l_orderkey")
    lines = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("linestatus"))
    for v, (segment, status, _) in enumerate(versions):
        customers = table(spark, d, "customer").filter(F.col("c_mktsegment") != segment).select(F.col("c_custkey").alias("o_custkey")).distinct()
        orders = orders.join(customers.withColumn(f"v{v}", F.lit(True)), "o_custkey", "left")
        orders = orders.withColumn(f"v{v}", F.coalesce(F.col(f"v{v}") & (F.col("o_orderstatus") != status), F.lit(False)))
    orders = written(orders.filter("v0 or v1"), "orders")
    for v, (_, _, flag) in enumerate(versions):
        keys = orders.filter(f"v{v}").select(F.col("o_orderkey").alias("l_orderkey")).distinct().withColumn(f"v{v}", F.lit(True))
        lines = lines.join(keys, "l_orderkey", "left").withColumn(f"v{v}", F.coalesce(F.col(f"v{v}") & (F.col("flag") != flag), F.lit(False)))
    return orders, written(lines.filter("v0 or v1"), "lines")


def extraction(customers, orders, lines, place, named):
    """Customers as publications, orders as studies with one arm, lines as outcomes, one location each.

    ``named`` gives lines their explicit outcome id.
    """
    key, ref = F.col("o_orderkey"), _text("o", F.col("l_orderkey"), "-", F.col("l_linenumber"))
    study = _text("s", key).alias("study_ref")
    nothing, zero = F.lit(None).cast("string"), F.lit(0)
    studies = orders.select(
        study, _text("p", F.col("o_custkey")).alias("publication_id"), F.when(F.col("o_orderpriority") == "1-URGENT", _text("S", key)).alias("study_id"),
        nothing.alias("identity_key"), _text("order ", key).alias("label"), (key + place).cast("int").alias("ordinal"))
    arms = orders.select(_text("a", key).alias("arm_ref"), study, nothing.alias("arm_id"), F.col("o_orderstatus").alias("role"), F.col("o_orderpriority").alias("label"), zero.alias("ordinal"))
    of_line = _text("s", F.col("l_orderkey")).alias("study_ref")
    outcomes = lines.select(ref.alias("outcome_ref"), of_line, named(ref).alias("outcome_id"), nothing.alias("identity_key"),
                            _text("line ", F.col("l_linenumber")).alias("domain"), (F.col("l_linenumber") + place).alias("ordinal"))
    blank = [F.lit("").alias(n) for n in ("section", "figure", "table")]

    def location(kind, owner, quote, page):
        return [F.lit(kind).alias("owner_kind"), owner.alias("owner_ref"), zero.alias("ordinal"), quote.alias("quote"), page.alias("page"), *blank]

    locations = lines.select(of_line, *location("outcome", ref, _text("line ", F.col("l_linenumber")), F.col("l_linenumber").cast("string")))
    locations = locations.unionByName(orders.select(study, *location("arm", _text("a", key), F.col("o_orderpriority"), F.lit("1"))))
    locations = locations.unionByName(orders.select(study, *location("field", F.lit("price"), F.col("price").cast("string"), F.lit("2"))))
    publications = customers.select(_text("p", F.col("c_custkey")).alias("publication_id"))
    return ops.Extraction(publications, studies, arms, outcomes, locations)


VERSIONS = (("MACHINERY", "P", "A"), ("BUILDING", "F", "R"))


def two_extractions(spark, d):
    """Two versions, each of which leaves out one market segment, order status and return flag."""
    orders, lines = orders_and_lines(spark, d, VERSIONS)
    named = (lambda ref: F.when(F.col("linestatus") == "F", F.concat(F.lit("X"), ref)),
             lambda ref: F.when((F.col("linestatus") == "O") & (F.col("flag") == "N"), F.concat(F.lit("Y"), ref)))
    first, second = [
        extraction(table(spark, d, "customer").filter(F.col("c_mktsegment") != segment), orders.filter(f"v{v}"), lines.filter(f"v{v}"), v, named[v])
        for v, (segment, _, _) in enumerate(VERSIONS)]
    opened = ops.reingest_entities(spark.createDataFrame([], ops.LEDGER), first, "t1", ["domain"]).opened
    return ops.reingest_entities(opened, second, "t2", ["domain"], keep=False)


def _id(prefix: str, *parts: str) -> str:
    listed = ", ".join(f"lower(trim(cast({p} as varchar)))" for p in parts)
    return f"'{prefix}_' || substr(sha256(to_json([{listed}])::varchar), 1, 16)"


def _entities(v: str) -> str:
    """Stacked rows of one version: kind, entity, parent, publication, and whether it continues one before (``cont``)."""
    def evidence(owner, quote, page):
        return _id("evidence", "sid", owner, quote, page, "''", "''", "''", "0")
    arm = _id("arm", "sid", "o_orderstatus", "o_orderpriority", "0")
    return f"""
select 'publication' as kind, pub as entity_id, '' as parent_id, pub, false as cont from pub{v}
union all select 'study', sid, pub, pub, cont from study{v}
union all select 'arm', {arm}, sid, pub, null from study{v}
union all select 'location', {evidence(arm, 'o_orderpriority', "'1'")}, {arm}, pub, null from study{v}
union all select 'location', {evidence("'price'", 'cast(trunc(o_totalprice) as bigint)', "'2'")}, sid, pub, null from study{v}
union all select 'outcome', oid, sid, pub, cont from outcome{v}
union all select 'location', {evidence('oid', "'line ' || l_linenumber", 'l_linenumber')}, oid, pub, null from outcome{v}"""


ENTITIES_SQL = f"""
line as (select l_orderkey, l_linenumber, min(l_returnflag) as flag, min(l_linestatus) as linestatus from lineitem group by all),
pub1 as (select c_custkey, 'p' || c_custkey as pub from customer where c_mktsegment <> 'MACHINERY'),
pub2 as (select c_custkey, 'p' || c_custkey as pub from customer where c_mktsegment <> 'BUILDING'),
study1 as (select *, case when o_orderpriority = '1-URGENT' then 'S' || o_orderkey else {_id('study', 'pub', "'order ' || o_orderkey", 'o_orderkey')} end as sid, false as cont
  from orders join pub1 on c_custkey = o_custkey where o_orderstatus <> 'P'),
study2 as (select o.*, pub2.pub, case when o.o_orderpriority = '1-URGENT' then 'S' || o.o_orderkey else coalesce(s.sid, {_id('study', 'pub2.pub', "'order ' || o.o_orderkey", 'o.o_orderkey + 1')}) end as sid, s.sid is not null as cont
  from orders o join pub2 on c_custkey = o_custkey left join study1 s on s.o_orderkey = o.o_orderkey where o.o_orderstatus <> 'F'),
ckey as (select l.*, 'o' || l_orderkey || '-' || l_linenumber as ref from line l),
outcome1 as (select c.*, sid, pub, case when linestatus = 'F' then 'X' || ref else {_id('outcome', 'sid', _id('outcome-configured-key', 'sid', "'domain=line ' || l_linenumber"))} end as oid, false as cont
  from ckey c join study1 on o_orderkey = l_orderkey where flag <> 'A'),
outcome2 as (select c.*, s.sid, s.pub, case when c.linestatus = 'O' and c.flag = 'N' then 'Y' || c.ref
    else coalesce(p.oid, {_id('outcome', 's.sid', _id('outcome-configured-key', 's.sid', "'domain=line ' || c.l_linenumber"))}) end as oid, p.oid is not null as cont
  from ckey c join study2 s on s.o_orderkey = c.l_orderkey left join outcome1 p on p.ref = c.ref where c.flag <> 'R'),
v1 as ({_entities('1')}), v2 as ({_entities('2')}),
runs as (select pub2.pub, {_id('extraction-run', 'pub2.pub', "'t2'", 'case when pub1.pub is null then 1 else 2 end')} as run, case when pub1.pub is null then 1 else 2 end as version,
    case when pub1.pub is null then '' else {_id('extraction-run', 'pub2.pub', "'t1'", '1')} end as before from pub2 left join pub1 using (pub)),
old as (select v1.*, {_id('extraction-run', 'v1.pub', "'t1'", '1')} as run, runs.pub is not null as touched, v2.kind is not null as again
  from v1 left join runs using (pub) left join v2 using (kind, parent_id, entity_id)),
state as (select v2.kind, v2.entity_id, v2.parent_id, runs.run as extraction_run_id, version as extraction_version, 'active' as status,
    case when v2.kind = 'publication' or v2.cont or (v2.cont is null and old.kind is not null) then before else '' end as supersedes
  from v2 join runs using (pub) left join old using (kind, parent_id, entity_id)
  union all select kind, entity_id, parent_id, run, 1, case when touched then 'superseded' else 'active' end, '' from old where not (touched and again))"""


@query("w5_entity_state", f"with {ENTITIES_SQL} select * from state")
def w5_state(spark, d):
    return two_extractions(spark, d).state.select("kind", "entity_id", "parent_id", "extraction_run_id", "extraction_version", "status", "supersedes")


@query("w5_entity_closed", f"""
with {ENTITIES_SQL} select old.kind, entity_id, parent_id, runs.run as superseded_by from old join runs using (pub)""")
def w5_closed(spark, d):
    return two_extractions(spark, d).closed.select("kind", "entity_id", "parent_id", "superseded_by")
