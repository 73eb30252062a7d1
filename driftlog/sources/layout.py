"""Tables in buckets, so that what is grouped or joined by the bucket's columns is not shuffled again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def bucketed(df: DataFrame, by: list[str], order: list[str], buckets: int, path: str, name: str | None = None) -> DataFrame:
    """The frame as an external table of ``buckets`` buckets by columns, sorted within them, and read back.

    A grouping whose keys hold all of ``by``, and a join on exactly ``by`` with a table of as many buckets, read
    their input as it lies. One file a bucket: rows are dealt to the buckets before they are written.
    ``name`` is the table's in the session's catalogue, ``path`` where its files are.
    """
    spark = df.sparkSession
    name = name or f"laid_out_{uuid.uuid4().hex}"
    df.repartition(buckets, *by).write.mode("overwrite").option("path", path).option("compression", "zstd").bucketBy(buckets, *by).sortBy(*order).saveAsTable(name)
    return spark.table(name)
