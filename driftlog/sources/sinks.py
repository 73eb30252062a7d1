"""Sinks: Parquet, ordered CSV, replacing one scope of a table, and units that are written once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlog.functions.hashing import content_hash


def parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(*(by or [])).parquet(path)


def csv(df: DataFrame, path: str, columns: list[str], order: list[str]) -> None:
    """A report table as one CSV file, columns in the order given. For tables of report size."""
    df.select(*columns).orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def replace_scope(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace the partitions that the frame has rows of; the table's other partitions stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*by).parquet(path)


def replaced(old: DataFrame, new: DataFrame, stale: Column) -> DataFrame:
    """What a table holds after rows that are stale have gone and the new ones have come."""
    return old.where(~F.coalesce(stale, F.lit(False))).unionByName(new)


def _read(df: DataFrame, path: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return df.sparkSession.read.schema(df.schema).parquet(path)
    except AnalysisException:
        return None


def publish(df: DataFrame, path: str) -> bool:
    """Write a unit once: False if it is there with the same rows, an error if with others.

    The rows are written beside the unit and renamed to it, which fails if another writer was first.
    """
    old = _read(df, path)
    if old is None and _renamed(df, path):
        return True
    a, b = (content_hash(x, df.columns).first() for x in (df, _read(df, path)))
    if a.content_sha256 != b.content_sha256:
        raise ValueError(f"{path} holds other rows")
    return False


def _renamed(df: DataFrame, path: str) -> bool:
    import uuid

    from py4j.protocol import Py4JJavaError

    spark = df.sparkSession
    jvm, conf, own = spark._jvm, spark._jsc.hadoopConfiguration(), f"{path.rstrip('/')}.{uuid.uuid4().hex}.tmp"
    df.write.option("compression", "zstd").parquet(own)
    made, target = jvm.org.apache.hadoop.fs.Path(own), jvm.org.apache.hadoop.fs.Path(path)
    files = made.getFileSystem(conf)
    try:
        none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), conf).rename(files.makeQualified(made), files.makeQualified(target), none)
    except Py4JJavaError as e:
        files.delete(made, True)
        if "FileAlreadyExists" in str(e.java_exception) or files.exists(target):
            return False
        raise
    return True


def write_once(df: DataFrame, path: str) -> bool:
    """``publish`` for a frame of one text column, such as a frozen gate."""
    return publish(df.coalesce(1), path)


def merged_metrics(parts: list[DataFrame]) -> DataFrame:
    """Metrics of all seeds as one table in the order of seed and step; rows whose seed or step is no number come first."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    seed, step = F.col("training_seed").try_cast("bigint"), F.col("step").try_cast("double").cast("bigint")
    bad = seed.isNull() | step.isNull()
    return rows.orderBy(F.when(bad, F.lit(0)).otherwise(seed), F.when(bad, F.lit(0)).otherwise(step))
