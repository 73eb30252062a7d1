"""Importance-weight statistics of prompts and pairs, in logarithms with a shift of their own for every sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlog.functions.numeric import clamp, finite, log_sums, safe_exp, safe_exp_status, weight
from driftlog.operators.checks import pair_prompts
from driftlog.operators.exact import exact_log_sums, exact_moments, exact_sums
from driftlog.operators.selection import beside, numbered, on_keys, quantiles
from driftlog.sources.scratch import Scratch

PAIR = ["split", "training_seed", "behavior_step", "target_step", "purpose"]
ESTIMATORS = ("is", "prompt_wis")


def prompt_stats(rows: DataFrame, pair: list[str] = PAIR, population_sd: bool = False) -> DataFrame:
    """One row a pair and prompt. The window and the aggregate share one exchange on their keys.

    A weight that is NaN or plus infinity makes all weight statistics of its prompt NaN; minus infinity is NULL, a weight of 0.
    """
    keys = [*pair, "prompt_id"]
    w = Window.partitionBy("prompt_id", *pair)  # sorts begin with a number: names are the same for many rows, and rows often come by prompt
    rows = rows.withColumn("log_weight", weight(F.col("log_weight")))
    z, good = F.col("log_weight"), F.col("correctness_reward") == 1
    shifted = rows.withColumns({"_m": F.max(z).over(w), "_m1": F.max(F.when(good, z)).over(w), "_m0": F.max(F.when(~good, z)).over(w)})
    k, m, m1, m0 = F.count(F.lit(1)), F.first("_m"), F.first("_m1"), F.first("_m0")
    log_k = F.ln(k.cast("double"))
    s1, s2 = F.sum(F.exp(z - F.col("_m"))), F.sum(F.exp(2 * (z - F.col("_m"))))
    g1, g2 = F.sum(F.when(good, F.exp(z - F.col("_m1")))), F.sum(F.when(good, F.exp(2 * (z - F.col("_m1")))))
    b2 = F.sum(F.when(~good, F.exp(2 * (z - F.col("_m0")))))
    sd = F.stddev_pop(z) if population_sd else F.stddev_samp(z)
    ess = clamp(s1 * s1 / s2, 1.0, k.cast("double"))
    return shifted.groupBy(*keys).agg(
        k.alias("K"),
        ess.alias("ess"),
        (ess / k).alias("relative_ess"),
        (2 * m + F.ln(s2) - log_k).alias("d2"),
        (1 / s1).alias("max_normalized_weight"),
        F.when(F.isnan(s1), F.lit(float("nan"))).otherwise(m1 + F.ln(g1) - log_k).alias("log_is"),
        F.coalesce(clamp(F.exp(m1 - m) * g1 / s1, 0.0, 1.0), F.lit(0.0)).alias("pwis"),
        F.avg(z).alias("mean_log_weight"),
        F.coalesce(sd, F.lit(0.0)).alias("sd_log_weight"),
        F.avg(F.abs(z)).alias("mean_abs_log_weight"),
        (-F.sum(z) / F.sum("completion_length")).alias("tokenwise_kl_proxy"),
        F.avg("correctness_reward").alias("reward_rate"),
        F.avg("completion_length").alias("mean_completion_length"),
        F.median("completion_length").alias("median_completion_length"),
        F.avg(F.col("was_truncated").cast("double")).alias("truncation_rate"),
        F.coalesce(clamp(F.exp(2 * (m1 - m)) * g2 / s2, 0.0, 1.0), F.lit(0.0)).alias("alpha"),
        (2 * m1 + F.ln(g2)).alias("log_sq_correct"),
        (2 * m0 + F.ln(b2)).alias("log_sq_incorrect"),
        F.sum(z).alias("_sum_z"),
        F.sum("completion_length").alias("_tokens"),
        F.sum(z * z).alias("_sum_z2"),
        F.sum(F.abs(z)).alias("_sum_abs"),
        F.sum(F.col("was_truncated").cast("long")).alias("_truncated"),
    )


def exact_weight_moments(rows: DataFrame, pair: list[str] = PAIR) -> DataFrame:
    """Mean, deviation (of samples, 0 for one) and mean absolute value of the log weights of every prompt, from exactly rounded sums."""
    names = {"n": "K", "mean": "mean_log_weight", "sd": "sd_log_weight", "mean_abs": "mean_abs_log_weight"}
    return exact_moments(rows, [*pair, "prompt_id"], weight(F.col("log_weight"))).withColumnsRenamed(names)


def length_quantile(stats: DataFrame, pair: list[str] = PAIR) -> DataFrame:
    """Adds the quarter of each prompt by mean length: floor(4 * rank / n), which is not ntile. Ranks are made without a pair in one task."""
    with Scratch(stats.sparkSession, "length-quantile") as scratch:
        ranked = numbered(stats, pair, ["mean_completion_length", "prompt_id"], scratch)
        quarter = F.least(F.lit(3), F.floor(4 * F.col("_rank") / F.col("_n")).cast("int"))
        labels = F.array(*(F.lit(x) for x in ("Q1_short", "Q2", "Q3", "Q4_long")))
        return scratch.result(ranked.withColumn("length_quantile", F.get(labels, quarter)).drop("_rank", "_n"))


#: Medians and tails of the diagnostics: column and share.
QUANTILES = {
    "median_prompt_ess": ("ess", 0.5),
    "median_prompt_relative_ess": ("relative_ess", 0.5),
    "p10_prompt_relative_ess": ("relative_ess", 0.1),
    "median_d2": ("d2", 0.5),
    "p90_max_normalized_weight": ("max_normalized_weight", 0.9),
}


def _diagnostics() -> list[Column]:
    """Means over prompts; sums over samples come from the prompts' own sums."""
    n, tokens = F.sum("K"), F.sum("_tokens")
    mean = F.sum("_sum_z") / n
    # The samples' deviation from sums of prompt sums: within plus between prompts.
    within = F.sum(F.col("_sum_z2") - F.col("_sum_z") * F.col("_sum_z") / F.col("K"))
    between = F.sum(F.col("_sum_z") * F.col("_sum_z") / F.col("K")) - F.sum("_sum_z") * F.sum("_sum_z") / n
    sd = F.sqrt(F.greatest(within + between, F.lit(0.0)) / F.nullif(n - 1, F.lit(0)))
    return [
        F.count(F.lit(1)).alias("n_prompts"),
        F.max("K").alias("K"),
        F.avg("d2").alias("mean_d2"),
        F.avg("max_normalized_weight").alias("mean_max_normalized_weight"),
        (-F.sum("_sum_z") / tokens).alias("tokenwise_kl_proxy"),
        (F.sum("_sum_abs") / n).alias("mean_abs_log_weight"),
        mean.alias("mean_log_weight"),
        F.coalesce(sd, F.lit(0.0)).alias("sd_log_weight"),
        (tokens / n).alias("mean_completion_length"),
        (F.sum("_truncated") / n).alias("truncation_rate"),
        F.abs(F.sum("_sum_z") / tokens).alias("pair_abs_mean_log_ratio_per_token"),
    ]


DIAGNOSTICS = ["n_prompts", "K", "median_prompt_ess", "median_prompt_relative_ess", "p10_prompt_relative_ess", "mean_d2", "median_d2", "mean_max_normalized_weight", "p90_max_normalized_weight", "tokenwise_kl_proxy", "mean_abs_log_weight", "mean_log_weight", "sd_log_weight", "mean_completion_length", "truncation_rate", "pair_abs_mean_log_ratio_per_token"]


def pair_diagnostics(stats: DataFrame, pair: list[str] = PAIR) -> DataFrame:
    """One row a pair with its diagnostics: plain aggregates, and quantiles selected without a pair in one task."""
    with Scratch(stats.sparkSession, "pair-diagnostics") as scratch:
        prompts = scratch(stats, "prompts")
        made = beside([prompts.groupBy(*pair).agg(*_diagnostics()), quantiles(prompts, pair, QUANTILES, scratch)], pair)
        return scratch.result(made.select(*pair, *DIAGNOSTICS))


def prompt_mean_diagnostics(stats: DataFrame, pair: list[str] = PAIR) -> DataFrame:
    """The variant that averages prompts: population deviation of prompt means, ratio weighted by tokens."""
    tokens = F.col("mean_completion_length") * F.col("K")
    with Scratch(stats.sparkSession, "prompt-mean-diagnostics") as scratch:
        prompts = scratch(stats, "prompts")
        means = prompts.groupBy(*pair).agg(
            F.avg("d2").alias("mean_d2"),
            F.avg("max_normalized_weight").alias("mean_max_normalized_weight"),
            (F.sum(F.col("tokenwise_kl_proxy") * tokens) / F.sum(tokens)).alias("tokenwise_kl_proxy"),
            F.avg("mean_abs_log_weight").alias("mean_abs_log_weight"),
            F.avg("mean_log_weight").alias("mean_log_weight"),
            F.stddev_pop("mean_log_weight").alias("sd_log_weight"),
            F.avg("mean_completion_length").alias("mean_completion_length"),
            F.avg("truncation_rate").alias("truncation_rate"),
        )
        made = beside([means, quantiles(prompts, pair, QUANTILES, scratch)], pair)
        return scratch.result(made.select(*pair, *(c for c in DIAGNOSTICS if c not in ("n_prompts", "K", "pair_abs_mean_log_ratio_per_token"))))


def _by_estimator(made: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each estimator from the pair's ``_log`` and ``_pwis``."""
    both = F.array(
        F.struct(F.lit("is").alias("estimator"), safe_exp(F.col("_log")).alias("estimate"), safe_exp_status(F.col("_log")).alias("estimate_status")),
        F.struct(F.lit("prompt_wis").alias("estimator"), finite(F.col("_pwis")).alias("estimate"), F.when(F.isnan("_pwis"), F.lit("nonfinite_estimator")).otherwise(F.lit("ok")).alias("estimate_status")),
    )
    return made.select(*keep, F.inline(both))


def estimates(stats: DataFrame, pair: list[str] = PAIR, exact: bool = False) -> DataFrame:
    """``(pair, estimator, estimate, estimate_status)``: ordinary and prompt-normalised importance sampling.

    With ``exact``, sums are exactly rounded.
    """
    if exact:
        logs = exact_log_sums(stats, pair, F.col("log_is"), {"_log": F.lit(True)})
        made = on_keys(logs, exact_sums(stats, pair, {"_pwis": F.col("pwis")}).drop("n"), pair)
    else:
        made = log_sums(stats, pair, F.col("log_is"), {"_log": F.lit(True)}, {"_pwis": F.col("pwis")})
    return _by_estimator(_means(made), pair)


def _means(made: DataFrame) -> DataFrame:
    return made.withColumns({"_log": F.col("_log") - F.ln(F.col("n").cast("double")), "_pwis": F.col("_pwis") / F.col("n")})


def pair_summary(stats: DataFrame, pair: list[str] = PAIR) -> DataFrame:
    """Estimates and diagnostics of every pair over prompts that are made once; no aggregate holds a pair's prompts."""
    with Scratch(stats.sparkSession, "pair-summary") as scratch:
        prompts = scratch(stats, "prompts")
        means = _means(log_sums(prompts, pair, F.col("log_is"), {"_log": F.lit(True)}, {"_pwis": F.col("pwis")})).drop("n")
        made = beside([prompts.groupBy(*pair).agg(*_diagnostics()), quantiles(prompts, pair, QUANTILES, scratch), means], pair)
        return scratch.result(_by_estimator(made, [*pair, *DIAGNOSTICS]))


def global_wis(rows: DataFrame, pair: list[str] = PAIR, exact: bool = False) -> DataFrame:
    """Self-normalised over all samples of a pair, from partial sums (with ``exact``, exactly rounded ones); NULL where a weight is NaN or infinite."""
    terms = {"_good": F.col("correctness_reward") == 1, "_all": F.lit(True)}
    made = (exact_log_sums if exact else log_sums)(rows, pair, F.col("log_weight"), terms)
    bad = F.isnan("_all") | (F.col("_all") == float("inf"))
    return made.select(*pair, F.when(~F.coalesce(bad, F.lit(False)), F.coalesce(F.exp(F.col("_good") - F.col("_all")), F.lit(0.0))).alias("global_wis"))


def online_prompt_accuracy(samples: DataFrame, most: int | None = None, exact: bool = False) -> DataFrame:
    """Success share of every prompt under a target, over its first ``most`` samples if given.

    With ``exact``, a prompt with another number of samples is an error, raised where the result is read.
    """
    rows = samples if most is None else samples.where(F.col("sample_index") < most)
    if exact:
        made = online_prompt_accuracy(rows)
        wrong = F.raise_error(F.concat(F.lit("not the samples wanted for prompt "), F.col("prompt_id").cast("string"))).cast("bigint")
        return made.withColumn("n_samples", F.when(F.col("n_samples") == most, F.col("n_samples")).otherwise(wrong))
    return rows.groupBy("split", "training_seed", "target_step", "prompt_id").agg(F.sum("correct").cast("long").alias("success_count"), F.count(F.lit(1)).alias("n_samples"), F.avg("correct").alias("prompt_accuracy"))


def online_reference(accuracy: DataFrame) -> DataFrame:
    """Mean accuracy of a target with its prompt and Monte Carlo standard errors, and the pooled rate beside it."""
    p, m = F.col("prompt_accuracy"), F.count(F.lit(1))
    mc = F.sqrt(F.sum(p * (1 - p) / F.nullif(F.col("n_samples") - 1, F.lit(0)))) / m
    return accuracy.groupBy("split", "training_seed", "target_step").agg(
        m.alias("n_prompts"),
        F.avg(p).alias("online_reference"),
        (F.sqrt(F.coalesce(F.var_samp(p), F.lit(0.0)) / m)).alias("prompt_standard_error"),
        mc.alias("mc_standard_error"),
        (F.sum("success_count") / F.sum("n_samples")).alias("pooled_accuracy"),
    )


def matched(stats: DataFrame, accuracy: DataFrame, enforce: bool = False, pair: list[str] = PAIR) -> DataFrame:
    """Prompt statistics with the prompt's on-policy accuracy; with ``enforce``, unequal prompt sets of a pair are an error."""
    if enforce:
        found = pair_prompts(stats, accuracy, pair).limit(3).collect()  # enough to name
        if found:
            raise ValueError("prompt sets differ: " + "; ".join(str(r.asDict()) for r in found))
    return stats.join(accuracy.select("split", "training_seed", "target_step", "prompt_id", "prompt_accuracy"), ["split", "training_seed", "target_step", "prompt_id"])


def with_errors(est: DataFrame, reference: DataFrame) -> DataFrame:
    """Estimates with reference, signed and absolute error; one exchange on the small side."""
    out = est.join(reference.select("split", "training_seed", "target_step", "online_reference"), ["split", "training_seed", "target_step"])
    error: Column = F.col("estimate") - F.col("online_reference")
    return out.withColumns({"signed_error": error, "absolute_error": F.abs(error)})
