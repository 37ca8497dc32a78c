"""Incremental linting: differences between snapshots, and a stream that lints what changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SNAPSHOT = ["mtime_ns", "size"]


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file, change): added, changed or deleted between two snapshots of (file, mtime_ns, size)."""
    a = old.select("file", F.struct(*SNAPSHOT).alias("_old"))
    b = new.select("file", F.struct(*SNAPSHOT).alias("_new"))
    both = a.join(b, "file", "full_outer")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return both.select("file", change.alias("change")).where("change is not null")


def incremental(old: DataFrame, findings: DataFrame, new: DataFrame, lint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Findings for the new snapshot, of which only added and changed files are linted. new also holds text."""
    diff = snapshot_diff(old, new)
    fresh = lint(new.join(diff.where("change <> 'deleted'"), "file", "left_semi"))
    return findings.join(diff, "file", "left_anti").unionByName(fresh)


def lint_stream(spark: SparkSession, path: str, schema: str, lint: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, once: bool = True, every: str = "500 milliseconds") -> StreamingQuery:
    """Lints Parquet snapshots of (file, text, mtime_ns, size) as they arrive below path and appends findings to
    the sink. Of a file that a batch holds several times the latest version counts."""

    def batch(rows: DataFrame, number: int) -> None:
        latest = rows.groupBy("file").agg(F.max_by("text", "mtime_ns").alias("text"))
        lint(latest).withColumn("batch", F.lit(number)).write.mode("append").parquet(sink)

    writer = spark.readStream.schema(schema).parquet(path).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def events(diff: DataFrame, findings: DataFrame) -> DataFrame:
    """(file, deleted, diagnostics) for every file of a difference: its findings in order, none for one that is gone."""
    shown = F.struct("pass_no", "seq", "line", "column", "severity", "code", "message")
    of = findings.groupBy("file").agg(F.sort_array(F.collect_list(shown)).alias("_d"))  # one file's findings
    kept = F.transform(F.coalesce("_d", F.array().cast(of.schema["_d"].dataType)), lambda d: F.struct(*(d[c].alias(c) for c in ("line", "column", "severity", "code", "message"))))
    return diff.join(of, "file", "left").select("file", (F.col("change") == "deleted").alias("deleted"), kept.alias("diagnostics"))


def watch_stream(spark: SparkSession, path: str, lint: Callable[[DataFrame, DataFrame], DataFrame], index: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, once: bool = True, every: str = "500 milliseconds") -> StreamingQuery:
    """Watches whole snapshots (snap, file, text, mtime_ns, size) arriving as Parquet below path. Of a batch's snapshots the
    latest counts. If it differs from the one before, the index is built anew from it, changed and added files are linted
    with that index, and events are appended to the sink, deletions too. The last snapshot is kept beside the checkpoint,
    under its batch's number, so that a batch that runs again meets the same one."""
    schema = "snap bigint, file string, text string, mtime_ns bigint, size bigint"

    def batch(rows: DataFrame, number: int) -> None:
        last = rows.agg(F.max("snap")).first()[0]
        if last is None:
            return
        new = rows.where(F.col("snap") == last).groupBy("file").agg(F.max_by("text", "mtime_ns").alias("text"), F.max("mtime_ns").alias("mtime_ns"), F.max_by("size", "mtime_ns").alias("size"))
        new.write.mode("overwrite").parquet(f"{checkpoint}/snapshots/{number}")
        new = spark.read.parquet(f"{checkpoint}/snapshots/{number}")
        fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/snapshots")
        names = [s.getPath().getName() for s in fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(fs)]
        before = max((int(n) for n in names if n.isdigit() and int(n) < number), default=None)
        old = spark.read.parquet(f"{checkpoint}/snapshots/{before}") if before is not None else new.limit(0)
        diff = snapshot_diff(old, new)
        if diff.isEmpty():
            return
        found = lint(new.join(diff.where("change <> 'deleted'"), "file", "left_semi"), index(new))
        events(diff, found).withColumn("batch", F.lit(number)).write.mode("append").parquet(sink)

    writer = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
