"""Connected components by alternating large and small stars, with tables between the rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlog.llm.staging import Tables, staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each neighbour (``large``: of greater id; else of smaller id, and the node itself) to the node's least neighbour."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:  # edges hold b < a, so a's neighbours here are smaller
        both = both.select("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    linked = joined.where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return linked.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def components(edges: DataFrame, max_rounds: int = 40, table: Tables | None = None) -> DataFrame:
    """``(node, component)`` of every node in ``edges(a, b)``; a component's name is its least node."""
    table = table or staged
    edges = table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        edges = table(_star(_star(edges, True).distinct(), False).where("a != b").distinct(), "edges")
        now = tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
