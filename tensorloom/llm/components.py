"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, sized


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of ``edges`` (a, b: long); root is the least vertex reached.

    Each round aggregates and joins the edges twice; the number of rounds grows with the logarithm of
    the longest path.  Stars, which is what the callers make, need two.  No edges, no rows.
    """
    flat = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    mark = None
    while True:
        both = flat.unionByName(flat.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # a vertex's least neighbour is found by aggregation and joined back, so a star's centre is no hot key
        least = sized(both.groupBy("a").agg(F.min("b").alias("m")))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
        large = cut(large.filter("a != b").distinct())
        least = sized(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        flat = cut(small.filter("a != b").distinct())
        now = flat.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    rooted = flat.select(F.col("a").alias("v"), F.col("b").alias("root"))
    return rooted.unionByName(flat.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct())
