"""A filter of fixed size over keys, broadcast ahead of a join so that most rows of the large side needn't move."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: 1 MB of bits, whatever the number of keys; with too many keys it lets more rows pass, no fewer.
BITS = 1 << 23


def mark(rows: DataFrame, hash_of_row: Column, keys: DataFrame, hash_of_key: Column, scratch: Scratch, name: str) -> DataFrame:
    """Adds _maybe (boolean): false only where no row of keys has the row's hash. Hashes are longs."""
    bit = F.pmod(hash_of_key, F.lit(BITS))
    words = keys.select(bit.alias("b")).groupBy(F.expr("b div 64").alias("_w")).agg(F.expr("bit_or(shiftleft(1L, cast(b % 64 as int)))").alias("_v"))
    words = scratch.write(words.coalesce(1), name)
    marked = rows.withColumn("_bit", F.pmod(hash_of_row, F.lit(BITS)))
    marked = marked.join(F.broadcast(words), F.expr("_bit div 64") == F.col("_w"), "left")
    return marked.withColumn("_maybe", F.expr("coalesce((shiftrightunsigned(_v, cast(_bit % 64 as int)) & 1L) = 1L, false)")).drop("_bit", "_w", "_v")
