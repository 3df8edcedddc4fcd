"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(vertex, component) of every vertex with an edge; a component is named by its least vertex.

    ``edges`` has long columns a and b.  Minima are hash aggregates, so a hub's neighbours are
    combined before the shuffle, and every round is written out once: nothing is collected.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    seen = _digest(edges)
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        edges = written(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct(), "cc")
        now = _digest(edges)
        if now == seen:
            return edges.select(F.col("a").alias("vertex"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct())
        seen = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
