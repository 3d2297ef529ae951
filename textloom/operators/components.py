"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.shared import forget, written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of an edge can reach.

    Each round hangs every node under the smallest of its neighbourhood; the number
    of rounds grows with the logarithm of the longest path.  Only counts reach the driver.
    Self loops keep their node as a component of its own; null ends are dropped.
    """
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna()
    loops = edges.filter("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    star = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        mark = star.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        both = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, star = star, written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        forget(before)
    roots = star.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return star.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots).unionByName(loops).groupBy("node").agg(F.min("component").alias("component"))
