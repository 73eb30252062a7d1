"""Ids and content hashes. Hash texts and integers only: floats are written differently by other writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def record_id(**fields: Column) -> Column:
    """SHA-256 of compact JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields)))), 256)


def list_id(*fields: Column) -> Column:
    """SHA-256 of a compact JSON array of texts."""
    return F.sha2(F.to_json(F.array(*(f.cast("string") for f in fields))), 256)


def content_hash(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """One hash and row count of each scope: four numbers of 60 bits of the row hashes are summed, so order and partitioning do not matter."""
    row = F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
    halves = [F.sum(F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(38,0)")) for at in (1, 16, 31, 46)]
    out = df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n_rows"), *(h.alias(f"_{i}") for i, h in enumerate(halves)))
    digest = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(f"_{i}").cast("string"), F.lit("0")) for i in range(4)), F.col("n_rows").cast("string")), 256)
    return out.select(*(by or []), "n_rows", digest.alias("content_sha256"))
