"""Connected components of links by alternating large-star and small-star steps.

Every step is a map-side minimum and a join on its result, so a vertex with very many
links is split like any skewed join side; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import drop_scratch, stored


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(vid, root) for every vertex of ``links`` (u long, v long) but the roots themselves;
    root is the smallest vertex reachable. Repeated links and loops count for nothing;
    null ends are left out. No links: no rows."""
    edges = stored(links.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        after = stored(small_star(large_star(edges)), "edges")
        drop_scratch(edges)
        edges = after
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h"), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)")).alias("g")).first()
        if tuple(state) == before:
            return edges.select(F.col("u").alias("vid"), F.col("v").alias("root"))
        before = tuple(state)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
