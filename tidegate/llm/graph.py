"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.store import saved


def _smallest(pairs: DataFrame) -> DataFrame:
    """For each node the smallest of itself and its neighbours; combined before the shuffle."""
    return pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (
        both.join(_smallest(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` lead from the larger node u to the smaller v."""
    least = _smallest(edges)
    return (
        edges.join(least, "u")
        .select(F.explode(F.array("u", "v")).alias("u"), "m")
        .filter("u <> m")
        .select("u", F.col("m").alias("v"))
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (u, v); the component is its smallest node.

    Every round writes its edges to the shared folder. The rounds end when the edges no longer change, after a
    number of them that grows with the logarithm of the nodes. A node with very many neighbours costs a minimum
    that is combined before the shuffle, and a join whose hot key the adaptive skew join splits.
    """
    edges = saved(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    seen = None
    while True:
        edges = saved(_small_star(_large_star(edges)), "edges")
        digest = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if digest == seen:
            break
        seen = digest
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select("v", "v").distinct()
    )
