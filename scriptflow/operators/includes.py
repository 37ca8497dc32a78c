"""The graph of includes: edges, transitive closure, cycles and repeats, by iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import kept

def include_edges(tokens: DataFrame) -> DataFrame:
    """(file, line, target) of include directives, targets as written."""
    target = F.regexp_extract("value", r"(?i)^include\s*[\"<]([^\">]+)[\">]", 1)
    return tokens.where("type = 'preprocessor'").select("file", "line", target.alias("target")).where("target <> ''")


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst, depth): the shortest number of steps from src to every file it reaches, itself included if on a cycle.

    Runs to the fixpoint, whatever the depth. A path longer than 2^k begins with one of just 2^k steps,
    so each round joins those with all that is reached and doubles the depth. Rounds are written to
    the shared folder. edges: src, dst; a null on either side is no edge.
    """
    reached = kept(edges.select("src", "dst").where("src is not null and dst is not null").distinct().withColumn("depth", F.lit(1)), "closure")
    step = 1
    while True:
        onward = reached.select(F.col("src").alias("dst"), F.col("dst").alias("next"), F.col("depth").alias("more"))
        longer = reached.where(F.col("depth") == step).join(onward, "dst").groupBy("src", F.col("next").alias("dst")).agg((F.min("more") + step).alias("depth"))
        new = kept(longer.join(reached.select("src", "dst"), ["src", "dst"], "left_anti"), "closure")
        if new.isEmpty():
            return reached
        reached = kept(reached.unionByName(new), "closure")
        step *= 2


def cycles(reached: DataFrame) -> DataFrame:
    """Files that include themselves over others."""
    return reached.where("src = dst").select(F.col("src").alias("file"), "depth")


def repeats(edges: DataFrame, guarded: DataFrame) -> DataFrame:
    """(file, target, n): files that a file includes more than once without a guard in them. guarded: file."""
    many = edges.groupBy("src", "dst").agg(F.count("*").alias("n")).where("n > 1")
    return many.join(guarded.select(F.col("file").alias("dst")).distinct(), "dst", "left_anti").select(F.col("src").alias("file"), F.col("dst").alias("target"), "n")
