"""Rescored trajectories beside their sources: canonical denominators, summaries and call groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_source(rows: DataFrame, source: DataFrame, columns: list[str]) -> DataFrame:
    """Rescore rows with columns of their source trajectory; coverage both ways is ``checks.covered``."""
    return rows.join(source.select("trajectory_id", *columns), "trajectory_id")


def canonical_weights(scores: DataFrame) -> DataFrame:
    """Weights of all rows against the identity pair's score of the same trajectory and seed.

    ``scores`` has target_sequence_logprob for every pair; the identity pair (b, b) gives the denominator.
    """
    base = scores.where("purpose = 'identity'").select("training_seed", "behavior_step", "trajectory_id", F.col("target_sequence_logprob").alias("canonical_logprob"))
    out = scores.join(base, ["training_seed", "behavior_step", "trajectory_id"])
    weight = F.col("target_sequence_logprob") - F.col("canonical_logprob")
    return out.withColumns({"log_weight": weight, "mean_log_ratio_per_token": weight / F.col("completion_length")})


def rescore_summary(rows: DataFrame, keys: list[str], bridge: Column | None = None, tolerance: float = 1e-3) -> DataFrame:
    """Greatest and mean absolute weight, and how far the logged score is from the canonical one."""
    out = [F.count(F.lit(1)).alias("n_rows"), F.max(F.abs("log_weight")).alias("max_abs_log_weight"), F.avg(F.abs("log_weight")).alias("mean_abs_log_weight")]
    if bridge is not None:
        gap = F.abs(bridge)
        out += [F.max(gap).alias("max_bridge_diff"), F.avg(gap).alias("mean_bridge_diff"), F.count_if(gap > tolerance).alias("n_bridge_over")]
    return rows.groupBy(*keys).agg(*out)


def status_counts(rows: DataFrame, keys: list[str], status: Column) -> DataFrame:
    """Counts of each parser status as a map, with truncation, ending and mean reward."""
    counted = rows.groupBy(*keys, status.alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum("correctness_reward").alias("r"), F.count_if("was_truncated").alias("t"))
    out = counted.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("status_counts"), F.sum("n").alias("n_rows"), F.sum("t").alias("n_truncated"), F.sum("r").alias("_r"))
    return out.withColumn("mean_reward", F.col("_r") / F.col("n_rows")).drop("_r")


def sample_limit(step: Column, audit: list[int], main: int, audit_limit: int) -> Column:
    """Samples a target has: more at the audit steps."""
    return F.when(step.isin(*audit), F.lit(audit_limit)).otherwise(F.lit(main))


def generation_call(rows: DataFrame, keys: list[str], index: int = 0) -> DataFrame:
    """Rows of the ``index``-th call of each key, calls standing in the order of their first prompt and sample."""
    usable = rows.where("generation_call_id is not null and sample_index is not null and prompt_id is not null")
    first = usable.groupBy(*keys, "generation_call_id").agg(F.min(F.struct("prompt_id", "sample_index", "generation_call_id")).alias("first"))
    at = F.row_number().over(Window.partitionBy(*keys).orderBy("first")) - 1
    chosen = first.withColumn("at", at).where(F.col("at") == index).select(*keys, "generation_call_id")
    return usable.join(chosen, [*keys, "generation_call_id"])


def mixed_fields(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Keys and fields with more than one value, NULL being a value."""
    kinds = [(F.count_distinct(f) + F.max(F.col(f).isNull().cast("int"))).alias(f) for f in fields]
    long = F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("bigint").alias("n_values")) for f in fields)))
    return rows.groupBy(*keys).agg(*kinds).select(*keys, long).where("n_values > 1")


def formal_failures(rows: DataFrame, token_atol: float, sequence_atol: float) -> tuple[DataFrame, DataFrame]:
    """Identity rows beyond the tolerances, and those whose stored flag says otherwise than the tolerances do."""
    fails = F.coalesce(F.col("identity_max_abs_token_logprob_diff") > token_atol, F.lit(False)) | F.coalesce(F.col("identity_abs_sequence_logprob_diff") > sequence_atol, F.lit(False))
    own = rows.where("purpose = 'identity'").withColumn("fails", fails)
    wrong = own.where(F.coalesce("identity_pass", F.lit(False)) == F.col("fails"))
    return own.where("fails").drop("fails"), wrong.drop("fails")


def identity_gate_gaps(summaries: DataFrame, grid: DataFrame) -> DataFrame:
    """Seeds and anchors of a grid without a passing identity summary."""
    passed = summaries.where("purpose = 'identity' and passed").select("training_seed", F.col("behavior_step").alias("anchor")).distinct()
    return grid.join(passed, ["training_seed", "anchor"], "left_anti")


def shard_index(shards: DataFrame, keys: list[str]) -> DataFrame:
    """Shards and rows of each key, and one hash of the shards' own hashes in the order of their units."""
    listed = F.array_sort(F.collect_list(F.struct("unit", "sha256")))
    return shards.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_shards"), F.sum("row_count").alias("n_rows"), F.sha2(F.array_join(F.transform(listed, lambda s: s["sha256"]), "\n"), 256).alias("shard_set_sha256"))


def spaced_targets(n: int, first: int = 20, last: int = 400, step: int = 20) -> tuple[int, ...]:
    """n targets of a grid, evenly spaced; a target that comes up twice gives way to the least unused ones."""
    grid = list(range(first, last + 1, step))
    if not 0 < n <= len(grid):
        raise ValueError(f"{n} targets of {len(grid)}")
    if n == 1:
        return (grid[(len(grid) - 1) // 2],)
    chosen = {grid[round(i * (len(grid) - 1) / (n - 1))] for i in range(n)}
    rest = [e for e in grid if e not in chosen]
    return tuple(sorted(chosen | set(rest[: n - len(chosen)])))
