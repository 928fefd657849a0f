"""Catalog coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evistrata.common import blank_to_null
from evistrata.functions.text import strip_html

ITEM_FIELDS = ("title", "date", "publicationTitle", "DOI")
PATH_SEPARATOR = " > "


def collection_paths(collections: DataFrame) -> DataFrame:
    """Full path of every collection from its root (J5, downward).

    ``session.configure`` lifts Spark's row limit of recursive queries, a million by
    default; the depth limit of 100 levels still stops a cyclic hierarchy.
    """
    return collections.sparkSession.sql(
        """
        WITH RECURSIVE tree AS (
          SELECT collection_id, CAST(name AS STRING) AS path, 1 AS depth FROM {c} WHERE parent_id IS NULL
          UNION ALL
          SELECT c.collection_id, concat(t.path, ' > ', c.name), t.depth + 1
          FROM {c} c JOIN tree t ON c.parent_id = t.collection_id
        )
        SELECT collection_id, path, depth FROM tree
        """,
        c=collections,
    )


def find_collections(paths: DataFrame, name: str) -> DataFrame:
    """Collections with a given full path, or last name when no separator is given (J5, upward)."""
    if PATH_SEPARATOR in name:
        return paths.filter(F.col("path") == name)
    return paths.filter(F.element_at(F.split("path", PATH_SEPARATOR), -1) == name)


def parent_items(collection_items: DataFrame, attachments: DataFrame, notes: DataFrame) -> DataFrame:
    """Distinct (collection_id, item_id) without child attachments and child notes."""
    children = attachments.filter("parent_id is not null").select("item_id")
    child_notes = notes.filter("parent_id is not null").select("item_id")
    return (
        collection_items.select("collection_id", "item_id")
        .join(children, "item_id", "left_anti").join(child_notes, "item_id", "left_anti").distinct()
    )


def item_fields(item_data: DataFrame, fields: Sequence[str] = ITEM_FIELDS) -> DataFrame:
    """One row per item from (item_id, field, value) rows."""
    return (
        item_data.filter(F.col("field").isin(*fields)).groupBy("item_id").pivot("field", list(fields)).agg(F.max("value"))
    )


def item_authors(creators: DataFrame) -> DataFrame:
    """``Last, First`` names in order, joined by semicolons."""
    name = F.when(F.coalesce("first", F.lit("")) != "", F.concat_ws(", ", "last", "first")).otherwise(F.col("last"))
    listed = F.array_sort(F.collect_list(F.struct("order_index", name.alias("name"))))
    return creators.groupBy("item_id").agg(F.concat_ws("; ", F.transform(listed, lambda a: a["name"])).alias("authors"))


def attachment_candidates(
    attachments: DataFrame, base_dir: str, linked_dir: str | None = None, prefix_map: Sequence[tuple[str, str]] = (),
) -> DataFrame:
    """Possible locations of each attachment in order of preference.

    Adds ``kind`` and one row per (rank, target).
    """
    path = F.regexp_replace("path", r"\\", "/")
    drive = path.rlike("^[A-Za-z]:/")
    kind = (
        F.when(path.startswith("storage:"), "stored").when(path.startswith("attachments:"), "linked")
        .when(drive, "drive").when(path.startswith("/"), "absolute").otherwise("unknown")
    )
    options = [
        F.when(kind == "stored", F.concat(F.lit(f"{base_dir}/storage/"), "key", F.lit("/"), F.substring(path, F.lit(9), F.length(path)))),
        F.when((kind == "linked") & F.lit(bool(linked_dir)), F.concat(F.lit(f"{linked_dir}/"), F.substring(path, F.lit(13), F.length(path)))),
        F.when(kind == "absolute", path),
    ]
    for prefix, local in prefix_map:
        prefix = prefix.replace("\\", "/")
        mapped = F.concat(F.lit(local), F.substring(path, F.lit(len(prefix) + 1), F.length(path)))
        options.append(F.when(drive & F.startswith(F.lower(path), F.lit(prefix.lower())), mapped))
    return attachments.withColumn("kind", kind).select(
        "*", F.posexplode(F.array_compact(F.array(*options))).alias("rank", "target"))


def resolve_attachments(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """First existing location per attachment; ``files`` is a listing with ``path``."""
    existing = candidates.join(files.select(F.col("path").alias("target")).distinct(), "target", "left_semi")
    return existing.groupBy("item_id", "parent_id").agg(F.min_by("target", "rank").alias("full_path"))


def item_attachment(attachments: DataFrame, resolved: DataFrame, content_type: str = "application/pdf") -> DataFrame:
    """Last existing full text per parent item."""
    wanted = attachments.filter(F.col("content_type") == content_type).select("item_id", "seq")
    return resolved.join(wanted, "item_id").groupBy(F.col("parent_id").alias("item_id")).agg(
        F.max_by("full_path", "seq").alias("pdf_path"))


def collection_coverage(paths: DataFrame, members: DataFrame, with_file: DataFrame) -> DataFrame:
    """Total, covered and missing items per non-empty collection (A1).

    Counting comes before the path join, so a huge collection is combined on the map side.
    """
    have = with_file.select("item_id").distinct().withColumn("_has", F.lit(1))
    counted = members.join(have, "item_id", "left").groupBy("collection_id").agg(
        F.count(F.lit(1)).alias("total"), F.count("_has").alias("has_attachment"))
    return counted.join(paths, "collection_id").select(
        "collection_id", F.col("path").alias("name"), "total", "has_attachment", (F.col("total") - F.col("has_attachment")).alias("missing"))


def catalog_papers(items: DataFrame, fields: DataFrame, authors: DataFrame, files: DataFrame) -> DataFrame:
    """Result rows of a collection listing: plain-text metadata and full-text path."""
    def plain(name: str):
        return strip_html(name)

    joined = items.join(fields, "item_id", "left").join(authors, "item_id", "left").join(files, "item_id", "left")
    path = F.coalesce("pdf_path", F.lit(""))
    return joined.select(
        *[F.col(c) for c in items.columns],
        plain("title").alias("title"), F.coalesce("authors", F.lit("")).alias("authors"),
        plain("publicationTitle").alias("journal"), plain("date").alias("date"), plain("DOI").alias("doi"),
        (path != "").alias("pdf_available"), path.alias("pdf_path"))


def with_full_text(papers: DataFrame) -> DataFrame:
    return papers.filter("pdf_available")


def listing_summary(papers: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Items and items with full text."""
    return papers.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if("pdf_available").alias("with_full_text"))


def missing_path_segments(targets: DataFrame, paths: DataFrame, column: str = "target") -> DataFrame:
    """Path prefixes of the targets that no collection has yet, with their depth."""
    parts = F.filter(F.transform(F.split(column, ">"), lambda p: F.trim(p)), lambda p: p != "")
    prefix = F.array_join(F.slice("_parts", F.lit(1), F.col("depth")), PATH_SEPARATOR)
    prefixes = (
        targets.select(parts.alias("_parts")).filter(F.size("_parts") > 0)
        .select("_parts", F.explode(F.sequence(F.lit(1), F.size("_parts"))).alias("depth"))
        .select("depth", prefix.alias("path")).distinct()
    )
    return prefixes.join(paths.select("path"), "path", "left_anti")


def doi_index(item_data: DataFrame) -> DataFrame:
    """Known DOIs of a catalog."""
    value = F.lower(F.trim("value"))
    return item_data.filter(F.col("field") == "DOI").select(blank_to_null(value).alias("doi")).filter("doi is not null").distinct()
