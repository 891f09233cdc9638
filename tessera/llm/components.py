"""Connected components by alternating large-star and small-star steps on a DataFrame of edges.

Each step joins every edge to its vertex's smallest neighbour, an aggregate that combines before its shuffle, so a hub
costs no more than its edges, and adaptive execution may split the hub's partition. Nothing is gathered by the driver
but a count and a checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop_stage, stage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("_m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("_m"))
    moved = down.join(least, "a").where("b != _m").select(F.col("b").alias("a"), F.col("_m").alias("b"))
    return least.select("a", F.col("_m").alias("b")).unionByName(moved).where("a != b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, root) for every vertex of ``edges`` (two long columns a, b) but the roots; root: smallest id reachable."""
    now = stage(edges.where("a != b").distinct())
    seen = None
    for _ in range(rounds):
        before, now = now, stage(_small_star(_large_star(now)))
        drop_stage(before)
        mark = now.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x"), F.sum(F.xxhash64("b", "a").cast("decimal(20,0)")).alias("s")).first()
        if mark["n"] == 0 or mark == seen:
            return now.select("a", F.col("b").alias("root"))
        seen = mark
    raise RuntimeError(f"components: no fixed point after {rounds} rounds")
