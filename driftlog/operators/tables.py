"""Result tables over all pairs at once: fixed reuse, overlap, rolling comparison and sample size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlog.operators import bootstrap, overlap
from driftlog.operators.overlap import PAIR
from driftlog.sources.scratch import Scratch

DIAGNOSTICS = ["median_prompt_ess", "median_prompt_relative_ess", "p10_prompt_relative_ess", "mean_d2", "median_d2", "mean_max_normalized_weight", "p90_max_normalized_weight", "tokenwise_kl_proxy", "mean_abs_log_weight", "mean_log_weight", "sd_log_weight", "mean_completion_length", "truncation_rate"]


def pair_results(rows: DataFrame, samples: DataFrame) -> DataFrame:
    """Estimates, references, errors and diagnostics of every pair and estimator."""
    stats = overlap.prompt_stats(rows)
    accuracy = overlap.online_prompt_accuracy(samples)
    return overlap.with_errors(overlap.pair_summary(stats), overlap.online_reference(accuracy))


def fixed_table(results: DataFrame, ci: DataFrame | None = None) -> DataFrame:
    """Reuse of the first log: purpose fixed, behaviour step 0, a later target."""
    rows = results.where("purpose = 'fixed' and behavior_step = 0 and target_step > 0")
    return rows if ci is None else rows.join(ci, [*PAIR, "estimator"])


def overlap_table(rows: DataFrame) -> DataFrame:
    """Prompt statistics with the quarter of length and the pair's drift."""
    prompts = overlap.length_quantile(overlap.prompt_stats(rows))
    drift = (-F.sum("_sum_z") / F.sum("_tokens")).alias("pair_tokenwise_kl_proxy")
    drift = prompts.groupBy(*PAIR).agg(drift).withColumn("pair_abs_mean_log_ratio_per_token", F.abs("pair_tokenwise_kl_proxy"))
    return prompts.join(drift, PAIR)


def rolling_table(results: DataFrame) -> DataFrame:
    """Each later log beside the first log of the same seed and target; later logs without one are dropped."""
    key = ["split", "training_seed", "target_step", "estimator"]
    names = {"estimate": "estimate", "absolute_error": "absolute_error", "median_prompt_relative_ess": "median_relative_ess", "mean_d2": "mean_d2", "mean_max_normalized_weight": "mean_max_normalized_weight", "tokenwise_kl_proxy": "tokenwise_kl_proxy"}
    old = results.where("purpose = 'fixed' and behavior_step = 0").select(*key, F.col("behavior_step").alias("old_behavior_step"), *(F.col(c).alias(f"old_{n}") for c, n in names.items()))
    new = results.where("purpose = 'rolling'").select(*key, F.col("behavior_step").alias("recent_behavior_step"), "online_reference", "K", "n_prompts", *(F.col(c).alias(f"recent_{n}") for c, n in names.items()))
    out = new.join(old, key)
    delta = F.when(F.col("old_estimate").isNotNull() & F.col("recent_estimate").isNotNull(), F.col("old_absolute_error") - F.col("recent_absolute_error"))
    return out.withColumns({"delta_error_old_minus_recent": delta, "delta_relative_ess_recent_minus_old": F.col("recent_median_relative_ess") - F.col("old_median_relative_ess")})


def analysis(rows: DataFrame, samples: DataFrame, reps: int = 2000, enforce: bool = True) -> dict[str, DataFrame]:
    """All that a pair gives, over all pairs at once: ``fixed`` with its intervals, ``overlap``, ``rolling`` and ``replicates``.

    The prompts of a pair must be those of its reference (see ``overlap.matched``).
    """
    stats, accuracy = overlap.prompt_stats(rows), overlap.online_prompt_accuracy(samples)
    results = overlap.with_errors(overlap.pair_summary(stats), overlap.online_reference(accuracy))
    drawn = bootstrap.portable(overlap.matched(stats, accuracy, enforce), reps)
    return {"fixed": fixed_table(results, bootstrap.intervals(drawn)), "overlap": overlap_table(rows), "rolling": rolling_table(results), "replicates": drawn}


def sample_size_table(rows: DataFrame, samples: DataFrame, most: int, sizes: tuple[int, ...] = (8, 16, 32), reps: int = 50) -> DataFrame:
    """Estimates from the first K samples of every prompt, development pairs only."""
    sizes = tuple(sorted({k for k in sizes if k <= most} | {most}))
    rows = rows.where("split = 'development' and purpose in ('fixed', 'rolling')")
    keys = [*PAIR, "K"]
    # One pass: a sample belongs to every size above its index.
    size = F.explode(F.array(*(F.lit(k).cast("bigint") for k in sizes)))
    spread = rows.select("*", size.alias("_k")).where("sample_index < _k").withColumnRenamed("_k", "K_size")
    pair = [*PAIR, "K_size"]
    with Scratch(rows.sparkSession, "sample-size") as scratch:
        stats = scratch(overlap.prompt_stats(spread, pair).where("K = K_size"), "stats")
        accuracy = scratch(overlap.online_prompt_accuracy(samples), "accuracy")
        out = overlap.with_errors(overlap.pair_summary(stats, pair), overlap.online_reference(accuracy))
        if reps:
            ci = bootstrap.intervals(bootstrap.portable(overlap.matched(stats, accuracy), reps, pair), pair)
            out = out.join(ci.select(*pair, "estimator", (F.col("ope_ci_high") - F.col("ope_ci_low")).alias("bootstrap_ci_width"), "bootstrap_nonfinite_fraction"), [*pair, "estimator"])
        return scratch.result(out.drop("K").withColumnRenamed("K_size", "K").select(*keys, "estimator", "estimate", "estimate_status", "online_reference", "absolute_error", "median_prompt_relative_ess", "p10_prompt_relative_ess", *(["bootstrap_ci_width", "bootstrap_nonfinite_fraction"] if reps else []), "n_prompts"))


def column_subset(df: DataFrame, schema: str) -> DataFrame:
    """The columns of a schema in its order, NULL where the frame lacks one."""
    fields = df.sparkSession.createDataFrame([], schema).schema
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
