"""A session with settings that suit the engine's plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "scriptflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; conf overrides or adds settings (dots as __)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for key, value in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def bounded_batches(spark: SparkSession) -> None:
    """From now on rows go to Python in Arrow batches of about 8 MB, whatever their number; a size that the session
    names stays. An executor holds several copies of a batch for each of its tasks, and Spark's 64 MB fill it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, "8m")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset, as in tests, the context's own
    checkpoint folder, which is made on a single machine. On a cluster one must be named."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path.rstrip("/")
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        if not context.isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='shared-')}")
    return context.getCheckpointDir().get().rstrip("/")


def kept(df: DataFrame, what: str) -> DataFrame:
    """The rows as written to the shared folder, so that nothing behind them is computed again or held by an executor."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept_by(df: DataFrame, what: str, key: str) -> DataFrame:
    """As kept, in a bucket for each shuffle partition: windows and joins on the key move none of the rows again."""
    spark, name = df.sparkSession, f"{what}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).write.format("parquet").option("path", f"{shared_dir(spark)}/{name}").bucketBy(n, key).sortBy(key).saveAsTable(name)
    return spark.table(name)
