"""Connected components over a table of links, by alternating large and small stars.

Each round is two aggregations and two joins; the driver only sees a row count and a checksum.
A node of any number of links is never gathered: minima are aggregated before the shuffle, and
the joins are plain ones that the adaptive planner splits where a key is large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def connected_components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """links: (a, b) of one type, any order, repeats and self links allowed. Returns (node, component)
    with the smallest node of each component, for every node that has a link to another."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    turn, seen = 0, None
    edges = scratch.write(edges, f"{name}-{turn}")
    while True:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        turn += 1
        edges = scratch.write(small.where("a <> b").distinct(), f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
