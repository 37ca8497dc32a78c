"""The corpus pipeline: quality, near duplicates, repeated passages, mixing, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows
as Parquet in the shared folder and hands what it reads back to the next stage. An empty table gives
an empty table. Columns beside those of documents are dropped. A stage has its session send rows to
Python in small batches from then on, and Python workers give free memory back, as all stages run on the same executors.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptflow.llm import filters, ngram_jaccard, queries, sentencepiece_codec, source_mix, substring_dedup
from scriptflow.llm.rows import with_row_key
from scriptflow.llm.scratch import Scratch
from scriptflow.session import bounded_batches

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier rejects go; all others stay. Each row is scored by its text alone, so null
    ids, repeated ids and repeated rows change nothing; a null text counts as empty."""
    scored = queries.quality_scores(spark, docs, sf_dir, COLUMNS)
    return scored.where("predicted = 1").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: the one with the smallest id (null last), of equal ids the one
    with the smallest hash of its columns. Rows without words are in no group and stay, repeated ones
    too. Texts of most rows, which stay, aren't moved: a filter of fixed size tells them from the rest."""
    scratch = Scratch(spark, "near")
    docs = with_row_key(docs, scratch)
    found = scratch.write(ngram_jaccard.join(docs, key="_row"), "found")
    gone = found.where(~F.col("_row").eqNullSafe(F.col("component_id"))).select(F.col("_row").alias("_gone"))
    marked = filters.mark(docs, F.xxhash64("_row"), gone, F.xxhash64("_gone"), scratch, "filter")
    rest = marked.where("_maybe").join(gone, F.col("_row") == F.col("_gone"), "left_anti")
    return marked.where("not _maybe").select(*COLUMNS).union(rest.select(*COLUMNS))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go, from repeated rows and from rows with null ids as from any others; a text
    that loses some becomes its kept words, others stay as they are, null and empty ones too."""
    cut = substring_dedup.deduplicate(docs, ["doc_id", "lang", "source", "n_chars"], kept=True, whole=True)
    size = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars").cast("long"))
    return cut.select("doc_id", F.col("kept").alias("text"), "lang", "source", size.alias("n_chars"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in training order, one for each pass of the mix over them. Every row has passes of its own,
    also where ids are null or repeated; rows without words, null texts among them, have none and go."""
    docs = with_row_key(docs, Scratch(spark, "mixing"))
    plan = source_mix.mix(docs.select("_row", "text", "source"), key="_row", turn=F.col("_row.id"))
    passes = plan.select("_row", F.explode("positions").alias("_position"))
    return docs.join(passes, "_row").repartitionByRange("_position", "_row").sortWithinPartitions("_position", "_row").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text of every row; a null text counts as empty."""
    return sentencepiece_codec.encode(docs, queries.piece_model(), ids=False, digests=True)


def _bounded(stage: Stage) -> Stage:
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [(stage.__name__, _bounded(stage)) for stage in (quality, near_duplicates, passages, mixing, tokens)]
#: Training, sketches and tokenizing have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
