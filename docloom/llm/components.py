"""Connected components by alternating large-star and small-star steps, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import checkpointed


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: every node's farther (large) or nearer (small) neighbours, and it, are tied to its least neighbour."""
    if large:
        ties = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ties.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = ties.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, component: the least node that links reach, for every node in links."""
    edges = checkpointed(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct())
    size = lambda e: e.agg(F.count("*"), F.coalesce(F.expr("bit_xor(xxhash64(u, v))"), F.lit(0))).first()
    before = size(edges)
    while before[0]:
        edges = checkpointed(star(star(edges, True), False))
        after = size(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
