"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

MAX_ROUNDS = 50


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` (the smallest id that can be reached) of every id in the edges ``a, b``.

    Alternating large-star and small-star steps: every node hands its larger (then its smaller) neighbours to its
    smallest neighbour, until nothing changes. The number of rounds grows with the logarithm of the longest path;
    a node with very many neighbours costs one minimum (combined before the shuffle) and one join row for each edge.
    """
    now = settle(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    sign = None
    for _ in range(MAX_ROUNDS):
        # Large star: u's larger neighbours go to u's smallest.
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        # Small star: u (of edges pointing down) hands its smaller neighbours, and itself, to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        now = settle(small)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == tuple(seen):
            break
        sign = tuple(seen)
    else:
        raise RuntimeError("components did not settle")
    # Every edge now points from a node to its component's smallest.
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v")).distinct())
