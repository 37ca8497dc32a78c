"""Script corpora, registries, baselines, diffs and configs as tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import glob_pattern

#: Extensions that are linted, and those that only hold macros and fragments (fixed values).
SOURCE_EXTENSIONS = ["sqf", "sqs", "inc", "cpp", "hpp", "ext", "sqm"]
FRAGMENT_EXTENSIONS = ["h", "inc", "hpp", "cpp"]
CONFIG_EXTENSIONS = ["hpp", "ext"]
#: A folder of this name holds the engine's own state and is never scanned.
STATE_DIR = ".scriptflow"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def read_corpus(spark: SparkSession, path: str, extensions: Iterable[str] = SOURCE_EXTENSIONS, ignores: Iterable[str] = (), state_dir: str = STATE_DIR) -> DataFrame:
    """Files below path with (file, ext, text, mtime_ns, size). Names are filtered before contents are read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    kept = extension(F.col("path")).isin(*extensions) & ~F.array_contains(F.split("path", "/"), state_dir)
    for glob in ignores:
        kept &= ~F.col("path").rlike(glob_pattern(glob))
    return found.where(kept).select(F.col("path").alias("file"), extension(F.col("path")).alias("ext"), F.expr("decode(content, 'UTF-8')").alias("text"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.col("length").alias("size"))


def read_paths(spark: SparkSession, paths: Iterable[str], **options: object) -> DataFrame:
    """Files and folders as one corpus, each file once."""
    out = None
    for path in paths:
        part = read_corpus(spark, path, **options)
        out = part if out is None else out.unionByName(part)
    return out.dropDuplicates(["file"])


def from_texts(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """Snippets by label as a corpus."""
    rows = [(name, text, len(text.encode())) for name, text in texts.items()]
    made = spark.createDataFrame(rows, "file string, text string, size long")
    return made.select("file", extension(F.col("file")).alias("ext"), "text", F.lit(0).cast("long").alias("mtime_ns"), "size")


def read_registry(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Names, one a line, in lower case; blank lines and lines that begin with # don't count."""
    name = F.lower(F.trim("value"))
    return spark.read.text(path).select(F.lit(kind).alias("kind"), name.alias("name")).where("name <> '' and not startswith(name, '#')").distinct()


def additive_union(*registries: DataFrame) -> DataFrame:
    """All names of several registries, each once."""
    out = registries[0]
    for other in registries[1:]:
        out = out.unionByName(other)
    return out.distinct()


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """Diagnostics of an earlier run from JSON: a list, or an object with the list under diagnostics.
    ruleId, startLine and startColumn are read where code, line and column are missing."""
    item = "array<struct<file:string,line:bigint,column:bigint,code:string,message:string,ruleId:string,startLine:bigint,startColumn:bigint>>"
    raw = spark.read.text(path, wholetext=True)
    wrapped = F.from_json("value", f"struct<diagnostics:{item}>")["diagnostics"]
    d = raw.select(F.explode(F.coalesce(wrapped, F.from_json("value", item))).alias("d"))
    return d.select("d.file", F.coalesce("d.line", "d.startLine").alias("line"), F.coalesce("d.column", "d.startColumn").alias("column"), F.coalesce("d.code", "d.ruleId").alias("code"), "d.message")


def changed_lines(diff: DataFrame) -> DataFrame:
    """(file, line) of added or changed lines from unified diffs without context: (n, text) rows in
    order of n, one diff a column `diff`. A hunk without a count has one line, with 0 none."""
    order = Window.partitionBy("diff").orderBy("n")
    file = F.when(F.col("text").startswith("+++ b/"), F.substring("text", 7, 1 << 30)).when(F.col("text").startswith("+++ "), F.lit(""))
    start = F.regexp_extract("text", r"^@@ -\S+ \+(\d+)(?:,(\d+))? @@", 1)
    count = F.regexp_extract("text", r"^@@ -\S+ \+(\d+)(?:,(\d+))? @@", 2)
    hunks = diff.withColumn("file", F.last(file, ignorenulls=True).over(order)).where((start != "") & (F.col("file") != ""))
    n = F.when(count == "", 1).otherwise(count.cast("int"))
    return hunks.where(n > 0).select("file", F.explode(F.sequence(start.cast("int"), start.cast("int") + n - 1)).alias("line")).distinct()


def ancestors(directory: Column) -> Column:
    """A directory and those above it, nearest last; the top is the empty string."""
    parts = F.split(directory, "/")
    return F.transform(F.sequence(F.lit(0), F.when(directory == "", 0).otherwise(F.size(parts))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def nearest_config(files: DataFrame, configs: DataFrame) -> DataFrame:
    """(file, config): for each file the config of the nearest directory at or above its own; of several
    there the one with the smallest priority. configs: dir, config, priority. Joins run on distinct directories."""
    dirs = files.select(F.regexp_replace("file", "/?[^/]*$", "").alias("dir")).distinct()
    above = dirs.select("dir", F.posexplode(ancestors(F.col("dir"))).alias("depth", "at"))
    best = above.join(configs.withColumnRenamed("dir", "at"), "at").groupBy("dir").agg(F.max_by("config", F.struct("depth", -F.col("priority"))).alias("config"))
    return files.select("file", F.regexp_replace("file", "/?[^/]*$", "").alias("dir")).join(best, "dir", "left").select("file", "config")
