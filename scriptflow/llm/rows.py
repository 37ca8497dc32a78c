"""Keys that tell rows apart even where ids are null or repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def with_row_key(docs: DataFrame, scratch: Scratch, key: str = "doc_id", name: str = "_row") -> DataFrame:
    """Adds a struct that no two rows share and that orders rows by key (null last), then by their content.

    Rows read from Parquet files are told apart by file and place, which every later read repeats;
    others are written first.
    """
    content = F.xxhash64(*(docs[c] for c in docs.columns))
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        place = (F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
        return docs.select("*", F.struct(docs[key].isNull().alias("none"), docs[key].alias("id"), content.alias("content"), *place).alias(name))
    numbered = docs.select("*", F.struct(docs[key].isNull().alias("none"), docs[key].alias("id"), content.alias("content"), F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at")).alias(name))
    return scratch.write(numbered, "numbered")
