"""Resumable ingestion of shards: new files are appended once, by scope, as they come."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftlog.functions import multiset
from driftlog.sources.snapshots import Conflict, Snapshots


def follow(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, by: list[str], key: str) -> StreamingQuery:
    """Append the rows of new Parquet shards to a partitioned table, skipping keys that it has.

    The checkpoint remembers files; the anti-join makes a batch that is run again harmless. It reads the
    target's partitions that the batch has rows of, so a key that comes again under another partition is
    appended again; ``ingest`` knows the keys of the whole table.
    """
    from pyspark.errors import AnalysisException

    def add(batch: DataFrame, _: int) -> None:
        rows = batch.dropDuplicates([key])
        try:
            done = spark.read.schema(batch.schema).parquet(target).select(*by, key)
        except AnalysisException:
            done = None
        if done is not None:
            scopes = rows.select(*by).distinct().limit(1_001).collect()
            if len(scopes) <= 1_000:  # else the whole target is looked at
                done = done.where(reduce(Column.__or__, (reduce(Column.__and__, (F.col(c).eqNullSafe(F.lit(r[c])) for c in by)) for r in scopes), F.lit(False)))
            rows = rows.join(done, [*by, key], "left_anti")
        rows.write.mode("append").option("compression", "zstd").partitionBy(*by).parquet(target)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def publish_batch(table: Snapshots, batch: DataFrame, number: int, name: str, by: list[str], key: str) -> bool:
    """One batch of a named stream as one step: its new rows, their keys, the batch's summary and its mark, or nothing.

    All four are in the one version that the commit claims, so after a crash at any place the batch is either
    not there, and is made again, or there with its mark, and is left out: then False. Keys of the whole table
    count, whatever partition they are under; of rows that share a key in a batch one stays. NULL is a key.
    """
    spark = table.spark
    while True:
        state = table.state()
        if state["marks"].get(name, -1) >= number:
            return False
        rows = batch.dropDuplicates([key])
        known = [f"{table.path}/{f}" for f in state.get("keys", [])]
        if known:
            keys = spark.read.schema(rows.select(F.col(key).alias("_known")).schema).parquet(*known)
            rows = rows.join(keys, F.col(key).eqNullSafe(F.col("_known")), "left_anti")
        new = table.written(rows, by)
        made = spark.createDataFrame([], batch.schema)
        if new:
            made = spark.read.schema(batch.schema).option("basePath", f"{table.path}/{new[0]['top']}").parquet(*(f"{table.path}/{x['path']}" for x in new))
        folder = table.folder("keys")
        made.select(F.col(key).alias("_known")).write.option("compression", "zstd").parquet(f"{table.path}/{folder}")
        summary = multiset.digest(multiset.state(made.select(F.col(key).cast("string").alias(key)), [key], []), []).first()
        unit = {"stream": name, "batch": number, "n_rows": summary.n_rows if summary else 0, "keys_sha256": summary.content_hash if summary else None}

        def change(s: dict, new=new, folder=folder, unit=unit) -> dict:
            return table.checked(s, batch) | {"folders": s["folders"] + new, "keys": [*s.get("keys", []), folder], "units": [*s.get("units", []), unit], "marks": s["marks"] | {name: number}}

        try:
            table.commit(change, expect=state["version"])
        except Conflict:  # another writer's rows may hold these keys
            continue
        return True


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, by: list[str], key: str, name: str = "ingest") -> StreamingQuery:
    """Rows of new Parquet shards into a versioned table, each key once, batch by batch as ``publish_batch`` does."""
    table = Snapshots(spark, target)
    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(lambda batch, number: publish_batch(table, batch, number, name, by, key) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
