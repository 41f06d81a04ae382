"""Connected components of an edge table, distributed: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, saved


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node reachable.

    Each round hangs larger neighbours on the smallest neighbour (large star), then smaller ones likewise (small star). Minima
    are sums of the map-side kind and joined back, so a node with very many edges never has them gathered in one task. Rounds
    are written to the checkpoint folder; they stop when no edge changes. Loops and null ends are ignored; an empty table
    gives no rows.
    """
    now = saved(
        edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    before = _mark(now)
    for _ in range(max_rounds if before[0] else 0):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        # every larger neighbour b of a hangs on the smallest of a's neighbourhood
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.where(F.col("a") != F.col("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a")
        last, now = now, saved(
            small.select(F.col("b").alias("a"), F.col("low").alias("b"))
            .unionByName(low.select("a", F.col("low").alias("b")))
            .where(F.col("a") != F.col("b"))
            .distinct()
        )
        dropped(last)
        after = _mark(now)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Count and two order-free sums, which tell whether a round changed anything."""
    hashed = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.bit_xor(hashed), F.sum(F.pmod(hashed, F.lit(1 << 31)))).first())
