"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stable


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges(a long, b long) -> (node, root): every node of an edge that is not its component's least, with the least.

    Every round halves paths at least; rounds shuffle edges only, keep one row per edge and end when
    the edge set no longer changes. Aggregations are by node with map-side minima, joins may be split
    by the adaptive skew join, so a hub with many edges is not gathered in one task.
    """
    edges = stable(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = stable(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        before, state, edges = state, _state(after), after
        if state == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
