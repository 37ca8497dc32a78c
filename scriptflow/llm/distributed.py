"""Ranks and running sums without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def ranked(df: DataFrame, order: list[Column], scratch: Scratch, name: str) -> DataFrame:
    """Adds rank (long, from 0) by order, which should be total.

    Rows are dealt out by range and sorted; the driver gets one count per partition.
    """
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    staged = scratch.write(sorted_rows.withColumn("_at", F.monotonically_increasing_id()), name)
    part, within = F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    offset, offsets = 0, []
    for row in sorted(staged.groupBy(part).count().collect()):
        offsets.append((row["_part"], offset))
        offset += row["count"]
    bases = df.sparkSession.createDataFrame(offsets, "_part long, _base long")  # a row a partition
    placed = staged.withColumn("_part", part).join(F.broadcast(bases), "_part")
    return placed.withColumn("rank", (F.col("_base") + within).cast("long")).drop("_at", "_part", "_base")


def hash_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """The `most` rows with the smallest hash of a key (ties by the key), all if there are fewer.

    Rows that can't be among them are left out by a bound on the hash before the sort, so that no
    task and not the driver sees more than a few rows beyond `most`.
    """
    total = df.count()
    order = [F.xxhash64(key), F.col(key)]
    if total > most:
        share = min(1.0, most / total + 8 * (most**0.5 + 8) / total)
        if share < 1.0:
            df = df.where(F.xxhash64(key) <= F.lit(min((1 << 63) - 1, int(-(1 << 63) + share * ((1 << 64) - 1)))))
    return df.orderBy(*order).limit(most)
