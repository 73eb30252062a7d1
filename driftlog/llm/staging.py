"""Intermediate tables in the folder that all executors share, and joins behind a check of size."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark, name: str) -> str:
    """A new folder under spark.checkpoint.dir; a temporary one where that is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        base = "file://" + tempfile.gettempdir() + "/driftlog-shared"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """The frame written as Parquet to the shared folder and read back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = folder or shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Tables:
    """Intermediate tables of one job; on leaving, all of them are removed, so its result must be staged outside."""

    def __init__(self, spark, name: str) -> None:
        self.spark, self.folder, self.n = spark, shared_folder(spark, name), 0

    def __enter__(self) -> Tables:
        return self

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        return staged(df, name, f"{self.folder}/{self.n:03d}-{name}")

    def __exit__(self, *error: object) -> None:
        remove(self.spark, self.folder)


def in_small_batches(df: DataFrame, rows: int = 2_000) -> DataFrame:
    """The frame in a session of its own, a copy of its session in which Python workers get batches of at most so many rows.

    A worker, and the executor beside it, hold less at a time; the frame's own session stays as it is.
    """
    spark = df.sparkSession
    copy = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    copy.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    plan = df._jdf.queryExecution().logical()
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(copy._jsparkSession, plan), copy)


def semi_join(big: DataFrame, ids: DataFrame, column: str, limit: int = 1_000_000, count: int | None = None) -> DataFrame:
    """Rows of ``big`` whose ``column`` is in ``ids``, broadcast while ids are at most ``limit`` rows, else by a shuffle."""
    n = ids.count() if count is None else count
    ids = ids.select(column)
    return big.join(F.broadcast(ids) if n <= limit else ids.hint("shuffle_hash"), column, "left_semi")
