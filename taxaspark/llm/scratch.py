"""Intermediate tables in the folder that the cluster shares.

The folder is the session's ``spark.checkpoint.dir``; only where that is unset
(tests) a temporary folder is used.  A table written here cuts lineage, so a lost
executor never makes earlier stages run again.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"
_FALLBACK: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session, else one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not _FALLBACK:
        _FALLBACK.append(tempfile.mkdtemp(prefix="taxaspark-"))
    return "file://" + _FALLBACK[0]


class Scratch:
    """Tables of one operator call; each can be dropped once nothing reads it."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        """Write ``df`` and return the table as read back. Python workers get small Arrow batches meanwhile."""
        before = self.spark.conf.get(BATCH)
        self.spark.conf.set(BATCH, BATCH_BYTES)
        try:
            df.write.mode("overwrite").option("compression", compression).parquet(self.path(name))
        finally:
            self.spark.conf.set(BATCH, before)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def release(self) -> None:
        """Let Spark remove the shuffle files of earlier writes now: its cleaner acts when the driver's JVM collects their plans."""
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, name: str) -> None:
        """Remove a table, through Spark's file system so that any store works."""
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path(name))
        fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(where, True)
