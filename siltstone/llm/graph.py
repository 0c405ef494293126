"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (longs) reaches.

    Each step hangs a node's neighbours on the smallest of them, first the
    larger ones, then the smaller ones, until every component is a star; the
    number of steps grows with the logarithm of its diameter, and no step has
    more edges than its input. A step reads a written table, so plans stay
    short and a lost executor costs one step. Joins are on the node, where
    adaptive execution splits hot ones. Loops and null ends are dropped; a node
    without other edges does not appear.
    """
    pair = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a != b").distinct()
    now = Written(pair, "stars")
    mark = None
    while True:
        e = now.df
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a != b").distinct()
        mid = Written(large, "stars")
        low = mid.df.groupBy("a").agg(F.min("b").alias("least"))
        rest = mid.df.join(low, "a").filter("b != least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        small = low.select("a", F.col("least").alias("b")).unionByName(rest).filter("a != b").distinct()
        after = Written(small, "stars")
        n, total = after.df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        mid.drop()
        now.drop()
        now = after
        if (n, total) == mark:
            return now.df.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.df.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        mark = (n, total)
