"""Versions of all entities of an extraction: publications, studies, arms, outcomes and evidence locations.

The ledger is one stacked table with a row per entity and version: ``kind``, ``entity_id``,
``parent_id`` (publication of a study, study of an arm, outcome or study field, owner of a
location), ``publication_id``, ``aliases``, ``ordinal``, ``extraction_run_id``,
``extraction_version``, ``status``, ``supersedes``.  Ids are settled from the top down, since the
id of a child is made from its parent's; closing and opening are one step for all kinds.

Nearly all that belongs together lies in one publication, so new rows and the rows before are dealt
by publication once, as they come, and ids, owners and earlier versions are found where they lie.
Publications that share a study, owners of another publication, and publications of more than
``LARGE`` rows are dealt by alias and by identity, in a shuffle a step.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evistrata.common import as_col, blank_to_null, written
from evistrata.functions.keys import configured_outcome_key, evidence_id, outcome_identity, stable_id, study_id, study_identity_key

IDENTITY = ["kind", "parent_id", "entity_id"]
LEDGER = ("kind string, entity_id string, parent_id string, publication_id string, aliases array<string>, ordinal int, "
          "extraction_run_id string, extraction_version int, status string, supersedes string")
COLUMNS = ["kind", "entity_id", "parent_id", "publication_id", "aliases", "ordinal", "extraction_run_id", "extraction_version", "status", "supersedes"]
STATE = [*IDENTITY, "publication_id", "extraction_run_id", "extraction_version", "status", "supersedes"]
FACTS = ["ordinal", "publication_id", "extraction_version", "aliases", "supersedes"]
#: Rows of a publication that one task may read, and rows that one task of the dealt rows should read.
LARGE, SHARE = 500_000, 400_000
BUCKETS = 1 << 14


@dataclass
class Extraction:
    """Rows of new extractions; a ``*_ref`` is unique within its table and links a child to its owner.

    Empty and NULL ids, keys and labels mean "not given".
    """
    publications: DataFrame  # publication_id: all that were extracted again, those without studies too
    studies: DataFrame  # study_ref, publication_id, study_id, identity_key, label, ordinal
    arms: DataFrame  # arm_ref, study_ref, arm_id, role, label, ordinal
    outcomes: DataFrame  # outcome_ref, study_ref, outcome_id, identity_key, domain, ordinal, identity fields
    locations: DataFrame  # study_ref, owner_kind (field, arm, outcome), owner_ref (name of a field), ordinal, quote, page, section, figure, table


@dataclass
class EntityVersions:
    opened: DataFrame  # ledger rows of the new versions, active
    closed: DataFrame  # ledger rows of the versions before, superseded, with superseded_by
    state: DataFrame  # one row per entity: IDENTITY, publication_id, extraction_run_id, extraction_version, status, supersedes
    orphans: DataFrame  # kind, ref, error: rows that name an owner the extraction lacks


def continued(incoming: DataFrame, previous: DataFrame) -> DataFrame:
    """Previous entity that each incoming row continues: ref, previous_id, previous_run.

    ``incoming``: ref, parent_id, explicit_id, ordinal, aliases in falling certainty.  The first
    alias that the parent's entities have decides; of several with one alias the last counts.
    An entity is continued by one row only, so no two rows share its id: by the one that names
    its id, else by the most certain alias, else by the least ordinal.

    A row has half a dozen aliases, so they are what is shuffled: parent and alias travel as the first
    12 bytes of their SHA-256 digest (ids themselves are 8 bytes of one).
    """
    parent = F.concat(F.length("parent_id").cast("string"), F.lit(":"), F.col("parent_id"))

    def digest(alias: Column) -> Column:
        return F.substring(F.unhex(F.sha2(F.concat(parent, alias), 256)), 1, 12)

    def digests(aliases: Column) -> Column:
        return F.transform(aliases, digest)

    known = previous.select(F.explode(digests(F.array_distinct(F.array_compact("aliases")))).alias("alias"), "entity_id", "extraction_run_id", "extraction_version", "ordinal")
    known = known.groupBy("alias").agg(
        F.max(F.struct("extraction_version", "ordinal", "entity_id", "extraction_run_id")).alias("_k"))
    asked = incoming.select("ref", "parent_id", "explicit_id", "ordinal", F.posexplode(digests(F.array_compact("aliases"))).alias("certainty", "alias"))
    hits = asked.join(known, "alias").groupBy("ref").agg(
        F.min(F.struct("certainty", "parent_id", "_k.entity_id", "_k.extraction_run_id", "explicit_id", "ordinal")).alias("_h"))
    other = ~F.col("_h.explicit_id").eqNullSafe(F.col("_h.entity_id"))
    claim = F.struct(other.alias("other"), "_h.certainty", "_h.ordinal", "ref", "_h.extraction_run_id")
    won = hits.groupBy("_h.parent_id", "_h.entity_id").agg(F.min(claim).alias("_w"))
    return won.select(F.col("_w.ref").alias("ref"), F.col("entity_id").alias("previous_id"), F.col("_w.extraction_run_id").alias("previous_run"))


def _settled(rows: DataFrame, previous: DataFrame, fresh: Column) -> DataFrame:
    """``rows`` with ``entity_id``: the explicit id, else that of the entity continued, else ``fresh``."""
    if previous.isEmpty():  # a first extraction has nothing to look up
        matched = rows.withColumns({"previous_id": F.lit(None).cast("string"), "previous_run": F.lit(None).cast("string")})
    else:
        matched = rows.join(continued(rows, previous), "ref", "left")
    chosen = F.coalesce("explicit_id", "previous_id", fresh)
    return matched.withColumns({"entity_id": chosen, "supersedes": F.coalesce("previous_run", F.lit(""))}).drop("previous_id", "previous_run", "explicit_id")


def continued_near(rows: DataFrame, deal: Sequence[str], asking: Column) -> DataFrame:
    """``rows`` with ``previous_id`` and ``previous_run``: the rule of :func:`continued`, found where the rows lie.

    ``rows``: new ones (``_new``: ref, parent_id, explicit_id, ordinal, aliases) and the ones before (with entity_id,
    extraction_run_id, extraction_version as well) in one table that is dealt by ``deal``, such that rows of a
    parent lie together; only rows with ``asking`` have part in it.  Nothing is shuffled.
    """
    here = [F.col(name) for name in deal]
    known = F.when(~F.col("_new") & F.col("_alias").isNotNull(), F.struct("extraction_version", "ordinal", "entity_id", "extraction_run_id"))
    listed = rows.withColumn("_row", F.monotonically_increasing_id()).select(
        "*", F.posexplode_outer(F.when(asking, F.array_compact("aliases"))).alias("_certainty", "_alias"))
    listed = listed.withColumn("_hit", F.max(known).over(Window.partitionBy(*here, "parent_id", "_alias")))
    listed = listed.withColumn("_hit", F.when(F.col("_new") & F.col("_alias").isNotNull(), F.col("_hit")))
    first = F.row_number().over(Window.partitionBy(*here, "_row").orderBy(F.col("_hit").isNull(), "_certainty"))
    found = listed.withColumn("_first", first).filter("_first = 1")
    other = ~F.col("explicit_id").eqNullSafe(F.col("_hit.entity_id"))
    claim = F.when(F.col("_hit").isNotNull() & F.col("ref").isNotNull(), F.struct(other.alias("other"), "_certainty", "ordinal", "ref"))
    won = F.min(claim).over(Window.partitionBy(*here, "parent_id", "_hit.entity_id"))["ref"] == F.col("ref")
    found = found.withColumn("_won", F.col("_hit").isNotNull() & won)
    return found.withColumns({name: F.when(F.col("_won"), F.col(f"_hit.{of}")) for name, of in (("previous_id", "entity_id"), ("previous_run", "extraction_run_id"))}).drop(
        "_row", "_certainty", "_alias", "_hit", "_first", "_won")


def _given(value: str | Column) -> Column:
    return blank_to_null(F.trim(as_col(value)))


def _large(rows: DataFrame, key: str) -> DataFrame | None:
    """Values of ``key`` with more than ``LARGE`` rows, if any; a bucket of values holds at least as many rows as any of them, so
    only where one is full they are counted by value.
    """
    buckets = rows.groupBy(F.pmod(F.xxhash64(key), F.lit(BUCKETS))).agg(F.count(F.lit(1)).alias("n"))
    if not buckets.agg(F.count_if(F.col("n") > LARGE)).first()[0]:
        return None
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LARGE).select(key)


def settle_studies(studies: DataFrame, previous: DataFrame, tasks: int) -> DataFrame:
    """Study ids by explicit id, identity key within the publication, else publication, label and place.

    New studies and those before are dealt by publication once, over ``tasks``, but for those of large publications.
    """
    fresh = study_id("parent_id", "label", "ordinal")

    def keyed(rows: DataFrame) -> DataFrame:
        label = F.coalesce(_given("label"), F.concat(F.lit("study-"), (F.col("ordinal") + 1).cast("string")))
        rows = rows.withColumns({"label": label, "explicit_id": _given("study_id"), "parent_id": F.col("publication_id")}).withColumnRenamed("study_ref", "ref")
        rows = rows.withColumn("_key", F.coalesce(_given("identity_key"), study_identity_key("publication_id", "label")))
        # Studies of one key in one publication keep their places apart.
        return rows.withColumn("_aliases", F.array(stable_id("study-place", "_key", "ordinal"), F.col("_key"))).drop("_key", "study_id", "identity_key")

    columns = ["ref", "parent_id", "publication_id", "ordinal", "aliases", "entity_id", "supersedes"]
    known = previous.filter("kind = 'study'")
    if known.isEmpty():  # a first extraction has nothing to look up
        rows = keyed(studies).withColumnsRenamed({"_aliases": "aliases"})
        return rows.withColumns({"entity_id": F.coalesce("explicit_id", fresh), "supersedes": F.lit("")}).select(columns)
    large = _large(studies.select("publication_id").unionByName(known.select(F.col("parent_id").alias("publication_id"))), "publication_id")
    large = None if large is None else written(large.filter("publication_id is not null"), "large")
    near = studies if large is None else studies.join(large, "publication_id", "left_anti")
    rows = near.select(F.lit(True).alias("_new"), "study_ref", "publication_id", "study_id", "identity_key", "label", "ordinal")
    before = known.select(
        F.lit(False).alias("_new"), F.col("parent_id").alias("publication_id"), "entity_id", "aliases", "ordinal", "extraction_run_id", "extraction_version")
    before = before if large is None else before.join(large, "publication_id", "left_anti")
    rows = keyed(rows.unionByName(before, allowMissingColumns=True).repartition(tasks, "publication_id"))
    rows = rows.withColumn("aliases", F.when(F.col("_new"), F.col("_aliases")).otherwise(F.col("aliases")))
    rows = continued_near(rows, ["publication_id"], F.lit(True)).filter("_new")
    rows = rows.withColumns({"entity_id": F.coalesce("explicit_id", "previous_id", fresh), "supersedes": F.coalesce("previous_run", F.lit(""))}).select(columns)
    if large is None:
        return rows
    far = keyed(studies.join(large, "publication_id", "left_semi")).withColumnsRenamed({"_aliases": "aliases"})
    return rows.unionByName(_settled(far, known, fresh).select(columns))


def _outcome_keys(parent: str, of: str, identity_fields: Sequence[str], fallback: str) -> dict[str, Column]:
    """Columns ``explicit_id``, ``_fresh`` and ``aliases`` of an outcome whose own columns are under ``of``, given its identity ``_i``."""
    fields = [(name, F.col(f"{of}{name}")) for name in identity_fields]
    domain = F.trim(F.coalesce(F.col(f"{of}domain"), F.lit("")))
    configured = configured_outcome_key(parent, fields) if fields else F.lit(None).cast("string")
    explicit, by_place = _given(F.col(f"{of}outcome_id")), stable_id("outcome-key", parent, domain, "ordinal")
    fresh = F.when(F.col("_i.identity_source") == "ordinal_fallback", stable_id("outcome", parent, domain, "ordinal")).otherwise(stable_id("outcome", parent, "_i.identity_key"))
    aliases = F.array_distinct(F.array_compact(F.array(F.col("_i.identity_key"), _given(F.col(f"{of}identity_key")), explicit, configured, by_place)))
    return {"explicit_id": explicit, "_fresh": fresh, "aliases": aliases}


def _outcome_identity(parent: str, of: str, identity_fields: Sequence[str], fallback: str) -> Column:
    fields = [(name, F.col(f"{of}{name}")) for name in identity_fields]
    return outcome_identity(parent, F.col(f"{of}outcome_id"), F.col(f"{of}identity_key"), F.col(f"{of}domain"), "ordinal", fields, fallback)


def _named(aliases: str, entity: str) -> Column:
    """Aliases of an outcome with its id, by which the next version may name it."""
    return F.array_union(aliases, F.array(F.concat(F.lit("outcome-id:"), F.col(entity)), F.col(entity)))


def settle_outcomes(outcomes: DataFrame, studies: DataFrame, previous: DataFrame, identity_fields: Sequence[str], fallback: str) -> DataFrame:
    """Outcome ids by explicit id, any alias within the study, else the identity key."""
    owners = studies.select(F.col("ref").alias("study_ref"), F.col("entity_id").alias("parent_id"), "publication_id", "extraction_version")
    rows = outcomes.join(owners, "study_ref").withColumn("_i", _outcome_identity("parent_id", "", identity_fields, fallback))
    keys = [column.alias(name) for name, column in _outcome_keys("parent_id", "", identity_fields, fallback).items()]
    rows = rows.select(F.col("outcome_ref").alias("ref"), "parent_id", "publication_id", "extraction_version", "ordinal", *keys)
    settled = _settled(rows, previous.filter("kind = 'outcome'"), F.col("_fresh")).drop("_fresh")
    return settled.withColumn("aliases", _named("aliases", "entity_id"))


def _children(new: Extraction, identity_fields: Sequence[str]) -> DataFrame:
    """Arms, outcomes and locations in one table, what each kind has of its own in a struct; ``owner_kind`` and ``ref`` name an arm or outcome."""
    of_outcome = list(dict.fromkeys(["outcome_id", "identity_key", "domain", *identity_fields]))
    of_place = ["quote", "page", "section", "figure", "table"]
    arms = new.arms.select("study_ref", F.lit("arm").alias("kind"), F.lit("arm").alias("owner_kind"), F.col("arm_ref").alias("ref"), "ordinal", F.struct("arm_id", "role", "label").alias("arm"))
    outcomes = new.outcomes.select(
        "study_ref", F.lit("outcome").alias("kind"), F.lit("outcome").alias("owner_kind"), F.col("outcome_ref").alias("ref"), "ordinal", F.struct(*of_outcome).alias("outcome"))
    locations = new.locations.select("study_ref", F.lit("location").alias("kind"), "owner_kind", F.col("owner_ref").alias("ref"), "ordinal", F.struct(*of_place).alias("place"))
    return arms.unionByName(outcomes, allowMissingColumns=True).unionByName(locations, allowMissingColumns=True)


def _of_study(children: DataFrame, studies: DataFrame, tasks: int, *more: str) -> DataFrame:
    """Children with id (``_sid``) and publication of their study, dealt by ``study_ref``."""
    sids = studies.select(F.col("ref").alias("study_ref"), F.col("entity_id").alias("_sid"), "publication_id", *more)
    return children.repartition(tasks, "study_ref").join(sids, "study_ref")


def _lost(rows: DataFrame) -> DataFrame:
    """Locations whose study lacks their owner."""
    return rows.filter("kind = 'location' and owner_kind <> 'field' and not _owned").select("owner_kind", "ref", "publication_id")


def _shared(studies: DataFrame, active: DataFrame | None) -> tuple[DataFrame | None, bool]:
    """Publications that share the id of a study (ids are made of it in lower case), if any, and whether a study comes twice.

    Of a first extraction also those of which two studies have one id, since its rows are dealt by study.
    """
    study = F.lower(F.trim("entity_id")).alias("study")
    if active is None:
        named = studies.select(study, "publication_id", F.col("ref").alias("of"))
    else:
        named = studies.unionByName(active.filter("kind = 'study'"), allowMissingColumns=True).select(study, "publication_id", F.col("publication_id").alias("of"))
    named = named.withColumn("study", F.xxhash64("study"))
    owned = named.groupBy("study").agg(F.min("of").alias("low"), F.max("of").alias("high"), F.count(F.lit(1)).alias("n"))
    shared, twice = owned.agg(F.count_if(F.col("low") != F.col("high")), F.count_if(F.col("n") > 1)).first()
    if not shared:
        return None, twice > 0
    return named.join(owned.filter("low <> high"), "study", "left_semi").select("publication_id"), twice > 0


def _owned_elsewhere(lost: DataFrame, new: Extraction, studies: DataFrame) -> DataFrame | None:
    """Publications of which one has a location whose owner is of another study, both of them, if any."""
    if lost.isEmpty():
        return None
    owners = new.arms.select("study_ref", F.lit("arm").alias("owner_kind"), F.col("arm_ref").alias("ref")).unionByName(
        new.outcomes.select("study_ref", F.lit("outcome").alias("owner_kind"), F.col("outcome_ref").alias("ref")))
    theirs = owners.join(lost, ["owner_kind", "ref"]).join(studies.select(F.col("ref").alias("study_ref"), F.col("publication_id").alias("theirs")), "study_ref")
    return theirs.select(F.explode(F.array("publication_id", "theirs")).alias("publication_id"))


def _first(children: DataFrame, studies: DataFrame, runs: DataFrame, timestamp: str, identity_fields: Sequence[str], fallback: str, tasks: int, twice: bool) -> DataFrame:
    """Ledger rows of a first extraction (``_new``), dealt by study once; and its locations without owner in their study (not ``_owned``)."""
    rows = _of_study(children, studies, tasks, "extraction_version")
    outcome, arm, location = (F.col("kind") == kind for kind in ("outcome", "arm", "location"))
    keys = _outcome_keys("_sid", "outcome.", identity_fields, fallback)
    rows = rows.withColumn("_i", F.when(outcome, _outcome_identity("_sid", "outcome.", identity_fields, fallback)))
    rows = rows.withColumns({
        "aliases": F.when(outcome, keys["aliases"]), "entity_id": F.when(outcome, F.coalesce(keys["explicit_id"], keys["_fresh"])).when(arm, _arm_id())}).drop("_i")
    rows = _located(rows.withColumns({"aliases": F.when(outcome, _named("aliases", "entity_id")), "parent_id": F.col("_sid")}), ["study_ref", "_sid"], F.lit(True))
    rows = _last(rows.withColumn("supersedes", F.lit("")), ["study_ref"]).select("kind", "parent_id", "entity_id", *FACTS, "owner_kind", "ref", "_owned")
    above = _publications(runs).unionByName(studies.select(F.lit("study").alias("kind"), "parent_id", "entity_id", *FACTS))
    above = above.withColumn("_owned", F.lit(True))
    above = _last(above.repartition(tasks, "publication_id"), ["publication_id"]).drop("_last") if twice else above
    rows = rows.unionByName(above, allowMissingColumns=True)
    rows = rows.withColumns({"status": F.lit("active"), "extraction_run_id": _run(timestamp), "aliases": F.coalesce("aliases", F.array().cast("array<string>"))})
    return rows.select(*COLUMNS, *[F.when(~F.col("_owned"), F.col(name)).alias(name) for name in ("owner_kind", "ref")], F.lit(True).alias("_new"), F.lit(True).alias("_touched"), F.lit(False).alias("_again"), "_owned")


def _arm_id() -> Column:
    return F.coalesce(_given(F.col("arm.arm_id")), stable_id("arm", "_sid", "arm.role", "arm.label", "ordinal"))


def _located(rows: DataFrame, deal: Sequence[str], new: Column) -> DataFrame:
    """``rows`` where locations have ``parent_id`` and ``entity_id`` of the owner that lies beside them (``_owned``)."""
    location, is_field = F.col("kind") == "location", F.col("owner_kind") == "field"
    owner = F.max(F.when(new & ~location, F.col("entity_id"))).over(Window.partitionBy(*deal, "owner_kind", "ref"))
    # Names that are NULL meet nobody.
    rows = rows.withColumn("_owner", F.when(F.col("owner_kind").isNotNull() & F.col("ref").isNotNull() & ~is_field, owner))
    parts = [F.coalesce(F.col(f"place.{name}"), F.lit("")) for name in ("quote", "page", "section", "figure", "table")]
    placed = new & location
    return rows.withColumn("_owned", ~placed | is_field | F.col("_owner").isNotNull()).withColumns({
        "parent_id": F.when(placed, F.when(is_field, F.col("_sid")).otherwise(F.col("_owner"))).otherwise(F.col("parent_id")),
        "entity_id": F.when(placed & F.col("_owned"), evidence_id("_sid", F.when(is_field, F.col("ref")).otherwise(F.col("_owner")), *parts, "ordinal")).otherwise(F.col("entity_id"))})


def _last(rows: DataFrame, deal: Sequence[str]) -> DataFrame:
    """A row that comes twice is one entity; so are two of one explicit id, of which the last counts."""
    order = Window.partitionBy(*deal, *IDENTITY).orderBy(*[F.desc(name) for name in FACTS])
    return rows.withColumn("_last", F.row_number().over(order)).filter("_last = 1 or not _owned")


def _packed(name: str) -> Column:
    """An id as binary: of one that ends in 16 hex digits, as made ids do, these travel as 8 bytes."""
    tail = F.substring(name, -16, 16)
    digits = F.unhex(tail)
    made = (F.length(digits) == 8) & (F.lower(F.hex(digits)) == tail)
    stem = F.substring(F.col(name), F.lit(1), F.length(name) - 16)
    return F.when(made, F.concat(F.lit(b"\1"), digits, F.encode(stem, "utf-8"))).otherwise(F.concat(F.lit(b"\0"), F.encode(F.col(name), "utf-8"))).alias(name)


def _unpacked(name: str) -> Column:
    def text(start: int) -> Column:
        return F.decode(F.substring(name, start, 1 << 30), "utf-8")
    return F.when(F.substring(name, 1, 1) == F.lit(b"\1"), F.concat(text(10), F.lower(F.hex(F.substring(name, 2, 8))))).otherwise(text(2))


def _next(active: DataFrame, studies: DataFrame, placed: DataFrame, runs: DataFrame, timestamp: str, identity_fields: Sequence[str], fallback: str, tasks: int) -> DataFrame:
    """New rows (``_new``) and the rows before, dealt by publication once: ledger columns, ``_touched`` (its publication is
    extracted again) and ``_again`` (the new rows have the entity).

    Each kind is dealt by itself, in rows as narrow as it needs; a union of tables that are dealt alike stays so.
    """
    def dealt(rows: DataFrame, is_new: bool, *names: str | Column) -> DataFrame:
        return rows.select(F.lit(is_new).alias("_new"), "kind", "publication_id", *names).repartition(tasks, "publication_id")

    def stacked(*tables: DataFrame) -> DataFrame:
        rows = tables[0]
        for more in tables[1:]:
            rows = rows.unionByName(more, allowMissingColumns=True)
        return rows

    earlier = ["parent_id", "entity_id", "extraction_run_id", "extraction_version", "supersedes"]
    child = ["_sid", "owner_kind", "ref", "ordinal"]
    outcomes = dealt(placed.filter("kind = 'outcome'"), True, *child, "outcome").withColumn("_i", _outcome_identity("_sid", "outcome.", identity_fields, fallback))
    outcomes = outcomes.withColumns(_outcome_keys("_sid", "outcome.", identity_fields, fallback)).withColumn("parent_id", F.col("_sid")).drop("_i", "outcome")
    # The id of an outcome is twice among its aliases; it travels once.
    names = [F.col("entity_id"), F.concat(F.lit("outcome-id:"), F.col("entity_id"))]
    both = F.coalesce(F.array_contains("aliases", names[0]) & F.array_contains("aliases", names[1]), F.lit(False))
    bare = F.when(both, F.filter("aliases", lambda alias: (alias != names[0]) & (alias != names[1]))).otherwise(F.col("aliases"))
    known = dealt(active.filter("kind = 'outcome'"), False, *earlier, "ordinal", bare.alias("aliases"), both.alias("_named"))
    known = known.withColumn("aliases", F.when(F.col("_named"), _named("aliases", "entity_id")).otherwise(F.col("aliases"))).drop("_named")
    outcomes = continued_near(stacked(outcomes, known), ["publication_id"], F.lit(True))
    outcomes = outcomes.withColumns({
        "entity_id": F.when(F.col("_new"), F.coalesce("explicit_id", "previous_id", "_fresh")).otherwise(F.col("entity_id")),
        "supersedes": F.when(F.col("_new"), F.coalesce("previous_run", F.lit(""))).otherwise(F.col("supersedes"))}).drop("explicit_id", "previous_id", "previous_run", "_fresh")
    outcomes = outcomes.withColumn("aliases", F.when(F.col("_new"), _named("aliases", "entity_id")))
    arms = dealt(placed.filter("kind = 'arm'"), True, *child, "arm").withColumns({"entity_id": _arm_id(), "parent_id": F.col("_sid")}).drop("arm")
    locations = dealt(placed.filter("kind = 'location' and (owner_kind = 'field' or _owned)"), True, *child, "place")
    rows = _located(stacked(outcomes, arms, locations), ["publication_id", "_sid"], F.col("_new")).filter("_owned").drop("_sid", "owner_kind", "ref", "place", "_owner", "_owned")

    of_new = ["parent_id", "entity_id", "ordinal", "aliases", "supersedes"]
    others = dealt(active.filter("kind <> 'outcome' or kind is null"), False, _packed("parent_id"), _packed("entity_id"), *earlier[2:])
    others = others.withColumns({name: _unpacked(name) for name in earlier[:2]})
    rows = stacked(rows, others, dealt(studies.withColumn("kind", F.lit("study")), True, *of_new),
                   dealt(_publications(runs), True, *of_new, "extraction_version"))
    # Publication, version and run of the new rows of a publication are the same.
    whole = Window.partitionBy("publication_id", *IDENTITY).orderBy(F.desc("_new"), *[F.desc(name) for name in ("ordinal", "aliases", "supersedes")])
    every = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.max(F.when(~F.col("_new") & F.col("kind").isin("arm", "location"), F.struct("extraction_version", "extraction_run_id"))).over(every)["extraction_run_id"]
    rows = rows.withColumns({"_last": F.row_number().over(whole), "_before": before, "_again": F.max("_new").over(every)})
    version = F.max(F.when(F.col("_new") & (F.col("kind") == "publication"), F.col("extraction_version"))).over(Window.partitionBy("publication_id"))
    rows = rows.withColumn("_version", version).filter("not _new or _last = 1").withColumn(
        "extraction_version", F.when(F.col("_new"), F.col("_version")).otherwise(F.col("extraction_version")))
    rows = rows.withColumns({
        "status": F.lit("active"), "supersedes": F.when(F.col("_new"), F.coalesce("supersedes", "_before", F.lit(""))).otherwise(F.col("supersedes")),
        "extraction_run_id": F.when(F.col("_new"), _run(timestamp)).otherwise(F.col("extraction_run_id")),
        "aliases": F.coalesce("aliases", F.array().cast("array<string>")), "_touched": F.col("_version").isNotNull()})
    return rows.select(*COLUMNS, "_new", "_touched", "_again")


def _run(timestamp: str) -> Column:
    return stable_id("extraction-run", "publication_id", F.lit(timestamp), "extraction_version")


def _publications(runs: DataFrame) -> DataFrame:
    return runs.select(F.lit("publication").alias("kind"), F.lit("").alias("parent_id"), F.col("publication_id").alias("entity_id"), F.lit(0).alias("ordinal"),
                       "publication_id", "extraction_version", F.array().cast("array<string>").alias("aliases"), F.col("_previous_run").alias("supersedes"))


def _far(active: DataFrame, studies: DataFrame, new: Extraction, runs: DataFrame, timestamp: str, identity_fields: Sequence[str], fallback: str) -> DataFrame:
    """Ledger rows of the new versions, each step dealt by its own keys, so that no publication lies in one task."""
    nothing = F.array().cast("array<string>")
    outcomes = written(settle_outcomes(new.outcomes, studies, active, identity_fields, fallback), "outcomes")
    sids = studies.select(F.col("ref").alias("study_ref"), F.col("entity_id").alias("_sid"), "publication_id", "extraction_version")
    arm_id = F.coalesce(_given("arm_id"), stable_id("arm", "_sid", "role", "label", "ordinal"))
    arms = new.arms.join(sids, "study_ref").select(
        F.col("arm_ref").alias("ref"), F.col("_sid").alias("parent_id"), "publication_id", "extraction_version", "ordinal", arm_id.alias("entity_id"))
    owners = outcomes.select(F.lit("outcome").alias("owner_kind"), F.col("ref").alias("owner_ref"), F.col("entity_id").alias("_owner")).unionByName(
        arms.select(F.lit("arm").alias("owner_kind"), F.col("ref").alias("owner_ref"), F.col("entity_id").alias("_owner")))
    placed = new.locations.join(sids, "study_ref").join(owners, ["owner_kind", "owner_ref"], "left")
    is_field = F.col("owner_kind") == "field"
    parts = [F.coalesce(F.col(name), F.lit("")) for name in ("quote", "page", "section", "figure", "table")]
    locations = placed.filter(is_field | F.col("_owner").isNotNull()).select(
        F.lit(None).cast("string").alias("ref"), F.when(is_field, F.col("_sid")).otherwise(F.col("_owner")).alias("parent_id"), "publication_id", "extraction_version", "ordinal",
        evidence_id("_sid", F.when(is_field, F.col("owner_ref")).otherwise(F.col("_owner")), *parts, "ordinal").alias("entity_id"))

    stack = _publications(runs)
    for kind, rows in (("study", studies), ("outcome", outcomes)):
        stack = stack.unionByName(rows.select(F.lit(kind).alias("kind"), "parent_id", "entity_id", *FACTS))
    for kind, rows in (("arm", arms), ("location", locations)):
        unnamed = rows.withColumns({"aliases": nothing, "supersedes": F.lit(None).cast("string")})
        stack = stack.unionByName(unnamed.select(F.lit(kind).alias("kind"), "parent_id", "entity_id", *FACTS))
    stack = stack.groupBy(*IDENTITY).agg(F.max(F.struct(*FACTS)).alias("_r")).select(*IDENTITY, "_r.*")
    same = active.filter("kind in ('arm', 'location')").groupBy(*IDENTITY).agg(
        F.max(F.struct("extraction_version", "extraction_run_id"))["extraction_run_id"].alias("_same_run"))
    opened = stack.join(same, IDENTITY, "left").withColumns({"status": F.lit("active"), "extraction_run_id": _run(timestamp)})
    return opened.withColumn("supersedes", F.coalesce("supersedes", "_same_run", F.lit(""))).select(COLUMNS)


def _together(found: Sequence[DataFrame | None]) -> DataFrame | None:
    """Publications to deal apart, each once, written; None if there are none."""
    found = [rows for rows in found if rows is not None]
    if not found:
        return None
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    return written(rows.filter("publication_id is not null").distinct(), "apart")


def _without_owner(lost: DataFrame, new: Extraction, known: DataFrame) -> DataFrame:
    """Those of the lost locations whose owner is in no study."""
    owners = new.arms.join(known, "study_ref", "left_semi").select(F.lit("arm").alias("owner_kind"), F.col("arm_ref").alias("ref")).unionByName(
        new.outcomes.join(known, "study_ref", "left_semi").select(F.lit("outcome").alias("owner_kind"), F.col("outcome_ref").alias("ref")))
    return lost.join(owners, ["owner_kind", "ref"], "left_anti")


def reingest_entities(previous: DataFrame, new: Extraction, timestamp: str, identity_fields: Sequence[str] = (), fallback: str = "domain_and_ordinal", keep: bool = True) -> EntityVersions:
    """Close every entity of the publications extracted again and open their new versions.

    ``previous``: ledger rows; active ones are matched and closed, publications of any status
    give the version to follow.  Each publication gets its own run id.  Studies and outcomes keep
    their ids through aliases, also along chains of versions that share one alias each; arms and
    locations are identified by their content and place.  An entity that is missing in the new
    extraction ends as superseded.  Other publications stay as they are.  Runs jobs: runs, settled
    studies, their children and the opened rows beside those before are written to the shared folder,
    for each is read several times.  Who reads one of ``opened`` and ``state`` once saves the last
    with ``keep=False``.
    """
    active = previous.filter("status = 'active'")
    touched = new.publications.select("publication_id").unionByName(new.studies.select("publication_id")).filter("publication_id is not null").distinct()
    before = previous.filter("kind = 'publication'").groupBy(F.col("entity_id").alias("publication_id")).agg(
        F.max(F.struct("extraction_version", "extraction_run_id")).alias("_b"))
    version = F.coalesce("_b.extraction_version", F.lit(0)) + 1
    runs = written(touched.join(before, "publication_id", "left").select(
        "publication_id", stable_id("extraction-run", "publication_id", F.lit(timestamp), version).alias("extraction_run_id"),
        version.cast("int").alias("extraction_version"), F.coalesce("_b.extraction_run_id", F.lit("")).alias("_previous_run")), "runs")

    plain = previous.isEmpty()
    first = plain or active.isEmpty()
    children = _children(new, identity_fields)
    total = children.count() + (0 if first else active.count())
    tasks = max(int(previous.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARE))

    studies = written(settle_studies(new.studies.filter("publication_id is not null"), active, tasks), "studies")
    versioned = studies.withColumn("extraction_version", F.lit(1)) if plain else studies.join(runs.select("publication_id", "extraction_version"), "publication_id")
    shared, twice = _shared(studies, None if first else active)
    large = _large(children, "study_ref")
    found = [shared, None if large is None else studies.join(large.withColumnRenamed("study_ref", "ref"), "ref", "left_semi").select("publication_id")]
    if not first:
        of_study = _of_study(children, studies, tasks)
        owners = F.max(F.col("kind") != "location").over(Window.partitionBy("study_ref", "owner_kind", "ref"))
        placed = written(of_study.withColumn("_owned", owners & F.col("owner_kind").isNotNull() & F.col("ref").isNotNull()).drop("study_ref"), "children")
        found += [_large(placed.select("publication_id").unionByName(active.select("publication_id")), "publication_id"), _owned_elsewhere(_lost(placed), new, studies)]
    apart = _together(found)

    def of(rows: DataFrame, how: str) -> DataFrame:
        return rows if apart is None else rows.join(apart, "publication_id", how)

    if first:
        rows = written(_first(children, of(versioned, "left_anti"), of(runs, "left_anti"), timestamp, identity_fields, fallback, tasks, twice), "opened")
        more = _owned_elsewhere(_lost(rows), new, studies)
        if more is not None and not more.isEmpty():
            apart = _together([apart, more])
            rows = written(_first(children, of(versioned, "left_anti"), of(runs, "left_anti"), timestamp, identity_fields, fallback, tasks, twice), "opened")
        lost, rows = _lost(rows), rows.filter("_owned")
    else:
        rows = _next(*[of(rows, "left_anti") for rows in (active, studies, placed, runs)], timestamp, identity_fields, fallback, tasks)
        lost, rows = _lost(placed), written(rows, "opened") if keep else rows
    opened = rows.filter("_new").select(COLUMNS)
    ended = F.when(~F.col("_new") & F.col("_touched"), F.lit("superseded")).otherwise(F.col("status"))
    state = rows.filter("_new or not (_touched and _again)").withColumn("status", ended).select(STATE)
    closed = active.select(COLUMNS).join(runs.select("publication_id", F.col("extraction_run_id").alias("superseded_by")), "publication_id")
    closed = closed.withColumn("status", F.lit("superseded")).select(*COLUMNS, "superseded_by")
    if apart is not None:
        theirs = written(_far(*[of(rows, "left_semi") for rows in (active, versioned)], new, of(runs, "left_semi"), timestamp, identity_fields, fallback), "opened")
        gone = of(closed, "left_semi").join(theirs, IDENTITY, "left_anti")
        untouched = of(active, "left_semi").join(runs, "publication_id", "left_anti")
        opened = opened.unionByName(theirs)
        state = state.unionByName(theirs.select(STATE)).unionByName(gone.select(STATE)).unionByName(untouched.select(STATE))

    known = studies.select(F.col("ref").alias("study_ref"))

    def without_study(rows: DataFrame, kind: str, ref: str) -> DataFrame:
        return rows.join(known, "study_ref", "left_anti").select(F.lit(kind).alias("kind"), F.col(ref).alias("ref"), F.lit("study_missing").alias("error"))

    orphans = without_study(new.arms, "arm", "arm_ref").unionByName(without_study(new.outcomes, "outcome", "outcome_ref"))
    orphans = orphans.unionByName(without_study(new.locations, "location", "owner_ref")).unionByName(
        _without_owner(lost, new, known).select(F.lit("location").alias("kind"), "ref", F.lit("owner_missing").alias("error")))
    orphans = orphans.unionByName(new.studies.filter("publication_id is null").select(F.lit("study").alias("kind"), F.col("study_ref").alias("ref"), F.lit("publication_missing").alias("error")))
    return EntityVersions(opened, closed, state, orphans)
