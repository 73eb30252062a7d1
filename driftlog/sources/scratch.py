"""Tables between the steps of a job, in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; a temporary one where that is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        base = "file://" + tempfile.gettempdir() + "/driftlog-shared"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Intermediate tables of one job: written, read back, and removed on leaving. ``result`` writes one that stays."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.name, self.folder, self.n = spark, name, shared_folder(spark, name), 0

    def __enter__(self) -> Scratch:
        return self

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        return self._written(df, f"{self.folder}/{self.n:03d}-{name}")

    def result(self, df: DataFrame) -> DataFrame:
        """The job's own table, which outlives it: a lost executor costs nothing, and no step is run again."""
        return self._written(df, shared_folder(self.spark, f"{self.name}-result"))

    def _written(self, df: DataFrame, path: str) -> DataFrame:
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __exit__(self, *error: object) -> None:
        remove(self.spark, self.folder)
