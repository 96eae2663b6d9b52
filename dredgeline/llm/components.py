"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dredgeline.llm.store import scratch

ROUNDS = 64


def _least(edges: DataFrame) -> DataFrame:
    """(u, v, m): every directed edge and the smallest neighbour m of u. Partial aggregates come first, so a hub is no hot key there."""
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u")


def components(links: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node of the component. ``links`` has (a, b)."""
    edges = scratch(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    before = None
    for _ in range(ROUNDS):
        # Large star: every larger neighbour of u goes to the smallest of u and its neighbours.
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        # Small star: u and its smaller neighbours go to the smallest of them (edges run from larger to smaller).
        found = _least(large)
        small = found.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(found.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = scratch(small, "cc")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components not stable after {ROUNDS} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
