"""Connected components by alternating star contractions, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.staging import release, stage


def _downward(edges: DataFrame) -> DataFrame:
    """Each edge once, from its larger to its smaller end."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the smallest node next to it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """Returns (node, root) for every node that has an edge; root is the smallest node it reaches.

    `edges` has columns a and b of one ordered type; loops, repeats and either
    direction are accepted, and an edge with a null end is no edge. The rows of a
    hub are never gathered: minima are combined before the shuffle, and the joins
    are plain inner joins, which adaptive execution splits when a key is hot.
    Each round is written to the shared folder and the one before is removed.
    """
    now = stage(_downward(edges.select("a", "b").dropna()))
    last = None
    for _ in range(most_rounds):
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == last or not state["n"]:
            stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        last = state
        large = stage(_downward(_large_star(now)))
        after = stage(_downward(_small_star(large)))
        release(now)
        release(large)
        now = after
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")
