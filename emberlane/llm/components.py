"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on edges (a, b) with a < b.

    Large-star looks at all neighbours of a node and ties the greater ones to
    the least of them and itself; small-star ties the lesser ones and the node
    itself to their least.
    """
    seen = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    if large:
        seen = seen.unionByName(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    least = seen.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    tied = seen.join(least, "u")
    if large:
        made = tied.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        made = tied.select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b"))
    return made.where("a < b").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the least id reachable, for every id on an edge that
    isn't the least of its component. Every round's edges are written, so the
    plan doesn't grow; the loop ends when a round changes nothing."""
    edges = stored(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct())
    mark = lambda e: e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31)))).first()
    before = mark(edges)
    while before[0]:
        edges = stored(_star(_star(edges, True), False))
        now = mark(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("b").alias("id"), F.col("a").alias("component"))
