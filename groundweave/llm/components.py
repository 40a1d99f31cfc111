"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from groundweave.session import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every vertex hands its smallest neighbour to its larger (or not larger) ones.

    The minimum is combined before the shuffle; the join back on a hub is a sort-merge
    join whose hot partitions AQE can split.
    """
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("low", "u"))
    paired = both.join(least, "u")
    if large:
        out = paired.where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        out = paired.select(F.col("v").alias("u"), F.col("low").alias("v")).union(least.select("u", F.col("low").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component_id) for every vertex of the edges (a, b); component_id is the smallest id."""
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        edges = cut(_star(_star(edges, True), False), "stars")
        now = tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(pmod(xxhash64(v, u), 1000000007) as decimal(38,0)))")).first())
        if now == before:
            break
        before = now
    pairs = edges.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    return pairs.union(edges.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
