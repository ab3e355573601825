"""Connected components by alternating large-star and small-star steps.

Edges and labels stay distributed; each round is written to the shared
checkpoint folder.  A node with very many neighbours is joined by broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm.common import materialise, skew_join


def _with_least(pairs: DataFrame, total: int) -> DataFrame:
    """``pairs`` (u, v) with m, the least of u and all its v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select(
        "u", F.least("u", "m").alias("m"), "n"
    )
    return skew_join(pairs, least, "u", "n", total)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    found = _with_least(down, total)
    return found.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(
        F.col("e.v").alias("u"), F.col("e.m").alias("v")
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root (its component's least node) of all nodes of ``edges`` (u, v)."""
    clean = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    clean = materialise(clean, "cc-edges")
    before = None
    while True:
        total = 2 * clean.count()
        large = _large_star(clean, total).where("u <> v").distinct()
        clean = materialise(_small_star(large, total).where("u <> v").distinct(), "cc-round")
        state = clean.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            break
        before = state
    roots = clean.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
