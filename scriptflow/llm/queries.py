"""The registered queries of the operators, with production parameters, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, license_scan, lm_scoring, ngram_jaccard, nn_search, oracles, quality_gam, sentencepiece_codec, source_mix, substring_dedup, toxicity

#: The tokenizer file; its folder can be set, the file is never copied.
PIECE_MODEL = "piece_bpe_32k.model"


def piece_model() -> str:
    if folder := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(folder, PIECE_MODEL)
    import public_tokenizers

    return public_tokenizers.path(PIECE_MODEL)


def fold(key: str, n: int) -> Column:
    """crc32 of the decimal key modulo n; -1 for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % n, F.lit(-1))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: odd ids lie one folder deeper than even ones, so that licences are inherited over one or two levels."""
    shard = F.when(F.col("doc_id") % 2 == 1, F.concat(F.lit("/p"), (F.col("doc_id") % 97).cast("string"))).otherwise("")
    path = F.concat("source", F.lit("/"), "lang", shard, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return license_scan.scan(_table(spark, sf_dir, "documents").withColumn("path", path), ["doc_id"])


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.join(_table(spark, sf_dir, "documents"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the number of passes over each document and the training time of the first one."""
    plan = source_mix.mix(_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", F.size("positions").cast("long").alias("passes"), F.round(F.get("positions", 0), 6).alias("first_position"))


def quality_scores(spark: SparkSession, docs: DataFrame, sf_dir: str, keys: list[str]) -> DataFrame:
    """keys, held_out, score and predicted for docs. The features are written once: training and scoring both read them."""
    from .scratch import Scratch

    labels = _table(spark, sf_dir, "labels")
    x = Scratch(spark, "quality").write(quality_gam.featurise(docs, [docs[k] for k in keys]), "features")
    model = quality_gam.train(x, labels, fold("doc_id", 5) > 0)
    return quality_gam.score(x, model).select(*keys, (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark, _table(spark, sf_dir, "documents"), sf_dir, ["doc_id"])


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicate(_table(spark, sf_dir, "documents"), ["doc_id"])


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target documents are those labelled as good."""
    return lm_scoring.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels").where("quality = 1"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)
    held = (fold("doc_id", 4) == 2).alias("held_out")
    return toxicity.score(docs, model, [docs["doc_id"]]).select("doc_id", held, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.deduplicate(_table(spark, sf_dir, "embeddings"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(_table(spark, sf_dir, "documents"), piece_model(), ids=False, digests=True)


def op10_nn_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_search.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_source_mix": op3_source_mix,
    "op4_quality": op4_quality,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_toxicity": op7_toxicity,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_nn_search": op10_nn_search,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(oracles.ORACLES)
