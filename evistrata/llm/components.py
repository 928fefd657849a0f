"""Connected components of an edge table by alternating large and small stars.

Every node's edges are pointed at the least node it knows, first those to greater neighbours,
then those to smaller ones, until nothing changes; what is left are stars around the least node
of each component.  Both steps are an aggregate and an equi-join, so a node with a third of
all edges is combined on the map side and split by the adaptive skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evistrata.llm.base import stage


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def _star(pairs: DataFrame, node: str) -> DataFrame:
    """Edges from every pair's other end to the least of ``node`` and its neighbours."""
    least = pairs.groupBy(node).agg(F.min("b").alias("m")).select(node, F.least(node, "m").alias("m"))
    return pairs.join(least, node)


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (least node of its component) for every node of ``edges``.

    ``edges`` has two columns of one integer type; direction, repeats, loops and nulls do not
    matter.  Without edges the result is empty.
    """
    first, second = edges.columns
    now = stage(
        edges.filter(F.col(first) != F.col(second))
        .select(F.greatest(first, second).alias("u"), F.least(first, second).alias("v")).distinct(),
        "edges",
    )
    mark = _mark(now)
    while mark[0]:
        both = now.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(now.select(F.col("v").alias("a"), F.col("u").alias("b")))
        large = _star(both, "a").filter("b > a").select(F.col("b").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.col("u").alias("a"), F.col("v").alias("b"))
        small = _star(down, "a")
        small = small.select(F.col("b").alias("u"), F.col("m").alias("v")).unionByName(small.select(F.col("a").alias("u"), F.col("m").alias("v")))
        now = stage(small.filter("u <> v").distinct(), "edges")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
