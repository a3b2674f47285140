"""Connected components by alternating large-star and small-star rounds (Kiveris et al., SoCC 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, table


def _toward_min(pairs: DataFrame) -> DataFrame:
    """pairs (u, v): v of each u replaced by the least of u and all its v; keeps v as the new end."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (u, v) of longs -> (node, component): the smallest node that can be reached, for every node with an edge.

    Self-loops and nulls are ignored. Each round is written to the shared folder; the groups are joined with their
    pre-aggregated minimum, so a hub's edges are never gathered in one task.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = table(e, "edges")
    seen = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _toward_min(both).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _toward_min(large)
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = table(small, "edges")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        drop(now)
        now = after
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = state
    raise RuntimeError(f"components have not settled after {max_rounds} rounds")
