"""Tables between the steps of an operator, in the shared folder of spark.checkpoint.dir.

A step's rows are written as Parquet and read again, so that no later step depends on what an
executor holds, and the lineage ends there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir


class Scratch:
    """A folder of one run of an operator. Tables that the result still reads stay; drop() the others."""

    def __init__(self, spark: SparkSession, what: str = "", path: str | None = None):
        self.spark = spark
        self.path = path or f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, mode: str = "overwrite") -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.mode(mode).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, name: str, key: str, buckets: int, by: str | None = None) -> DataFrame:
        """As write, in so many files by the key's hash, each sorted by the key (in folders by a further
        column): joins and aggregations on the key move none of these rows again."""
        path = f"{self.path}/{name}"
        dealt = df.repartition(buckets, key)
        writer = dealt.write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, key).sortBy(key)
        table = f"scratch_{uuid.uuid4().hex}"
        (writer.partitionBy(by) if by else writer).saveAsTable(table)
        return self.spark.table(table)

    def open_bucketed(self, name: str, schema: str, key: str, buckets: int) -> DataFrame:
        """A table that bucketed() has written, perhaps in another job."""
        table = f"scratch_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {table} ({schema.replace(':', ' ')}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{self.path}/{name}'")
        return self.spark.table(table)

    def _file(self, name: str) -> tuple[object, object]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def write_text(self, name: str, text: str) -> None:
        """A small file, replaced as a whole: it is written under another name and renamed."""
        (fs, path), (_, new) = self._file(name), self._file(f"{name}.new")
        out = fs.create(new, True)
        out.write(text.encode())
        out.close()
        fs.delete(path, False)
        fs.rename(new, path)

    def read_text(self, name: str) -> str | None:
        """What write_text wrote; None if there is no such file. One that was written but not yet renamed counts."""
        for candidate in (name, f"{name}.new"):
            fs, path = self._file(candidate)
            if fs.exists(path):
                source = fs.open(path)
                text = bytes(source.readAllBytes()).decode()
                source.close()
                return text
        return None

    def drop(self, *names: str) -> None:
        """Deletes tables, and has the driver look for steps that nothing refers to any more: their shuffle files go then."""
        for name in names:
            fs, path = self._file(name)
            fs.delete(path, True)
        self.spark.sparkContext._jvm.System.gc()
