"""Connected components of a graph of any size, by alternating star steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_components(edges: DataFrame, keep: Callable[[DataFrame], DataFrame], drop: Callable[[DataFrame], None] = lambda df: None, limit: int = 60) -> DataFrame:
    """(a, b) edges to (id, root): root is the smallest id reachable.

    ``keep`` writes a table and reads it again, which cuts the lineage of every round; ``drop`` frees one.
    Every step is an aggregate and an equi-join, so a vertex with very many neighbours is never
    gathered in one task.  Vertices without an edge are absent; a root has itself as root.
    """
    cur = keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(limit):
        # large star: every neighbour above u is tied to the smallest of u and its neighbours
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its lower neighbours are tied to the lowest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = keep(small)
        mark = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        drop(cur)
        cur = new
        if mark == before:
            return cur.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(cur.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
        before = mark
    raise RuntimeError(f"components did not settle in {limit} rounds")
