"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tavola.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``v, c``: for each vertex of ``edges(a, b)`` the smallest vertex that it
    is linked with (itself included).

    Each round joins every vertex to the smallest vertex in its neighbourhood
    (large-star, small-star), so the number of rounds grows with the logarithm
    of the longest path and no vertex ever gathers its neighbours: neighbours
    meet in a mergeable minimum only. Nothing is collected but one row count
    and checksum a round. Null vertices are left out.
    """
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    e = stored(e, "cc")
    last = None
    while True:
        # Large-star: every larger neighbour of v is linked to v's smallest neighbour.
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))  # v = a, neighbour = b
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("m"))
        large = (both.filter("b > a").join(low, F.col("a") == F.col("v"))
                 .select(F.col("m").alias("a"), "b").distinct())
        # Small-star: v and its smaller neighbours are linked to the smallest of them.
        small = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(small, "b").select("a", "b", "m")
        new = (joined.select(F.col("m").alias("a"), F.col("b"))
               .unionByName(joined.select(F.col("m").alias("a"), F.col("a").alias("b")))
               .filter("a <> b").distinct())
        e = stored(new, "cc")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    out = e.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("c"))
    return stored(out.unionByName(e.select(F.col("a").alias("v"), F.col("a").alias("c")).distinct()), "cc-result")
