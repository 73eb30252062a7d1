"""Tables of a report: estimators, lags, gates, training, sample sizes, heat map, rank correlation, horizon and inclusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlog.functions.numeric import correlation, finite, finite_mean, ratio, root_mean_square

# Diagnostics that are compared with the error, and their families.
DIAGNOSTIC_FAMILIES = (
    ("median_prompt_relative_ess", "second_order_overlap"),
    ("mean_d2", "second_order_overlap"),
    ("mean_max_normalized_weight", "weight_concentration"),
    ("tokenwise_kl_proxy", "first_order_drift"),
    ("mean_abs_log_weight", "first_order_drift"),
)


def estimator_table(fixed: DataFrame) -> DataFrame:
    """Errors of each estimator over the fixed cases of a split; a case without an "ok" estimate counts as not finite."""
    bad = (F.col("estimate_status") != "ok") | finite(F.col("estimate")).isNull()
    width = finite(F.col("ope_ci_high")) - finite(F.col("ope_ci_low")) if "ope_ci_low" in fixed.columns else F.lit(None).cast("double")
    return fixed.groupBy("split", "estimator").agg(
        F.count(F.lit(1)).alias("n_pair_seed_cases"),
        finite_mean(F.col("absolute_error")).alias("mean_absolute_error"),
        F.median(finite(F.col("absolute_error"))).alias("median_absolute_error"),
        root_mean_square(F.col("signed_error")).alias("rmse"),
        finite_mean(F.col("signed_error")).alias("mean_signed_error"),
        F.avg(width).alias("mean_ope_ci_width"),
        finite_mean(F.col("median_prompt_relative_ess")).alias("mean_median_prompt_relative_ess"),
        F.avg(bad.cast("double")).alias("nonfinite_case_fraction"),
    )


def lag_table(rolling: DataFrame, estimator: str = "prompt_wis") -> DataFrame:
    """Old and recent logs by the recent log's lag, and over all lags."""
    rows = rolling.where(F.col("estimator") == estimator)
    lag = (F.col("target_step") - F.col("recent_behavior_step")).cast("string")
    rows = rows.select("*", F.explode(F.array(lag, F.lit("overall"))).alias("recent_log_lag_steps"))
    better = F.coalesce(F.col("recent_absolute_error") < F.col("old_absolute_error"), F.lit(False)).cast("double")
    return rows.groupBy("split", "recent_log_lag_steps").agg(
        F.count(F.lit(1)).alias("n_pair_seed_cases"),
        finite_mean(F.col("old_absolute_error")).alias("mean_old_absolute_error"),
        finite_mean(F.col("recent_absolute_error")).alias("mean_recent_absolute_error"),
        finite_mean(F.col("delta_error_old_minus_recent")).alias("mean_error_reduction_old_minus_recent"),
        F.avg(better).alias("fraction_recent_lower_error"),
        finite_mean(F.col("old_median_relative_ess")).alias("mean_old_median_relative_ess"),
        finite_mean(F.col("recent_median_relative_ess")).alias("mean_recent_median_relative_ess"),
        finite_mean(F.col("delta_relative_ess_recent_minus_old")).alias("mean_relative_ess_gain"),
    )


def gate_table(decisions: DataFrame) -> DataFrame:
    """Decisions by role, gate and tolerance."""
    n, acc, fa, err = F.count(F.lit(1)), F.count_if("accepted"), F.count_if("false_accept"), finite(F.col("absolute_error"))
    return decisions.groupBy("evaluation_role", "gate_kind", "tolerance").agg(
        n.alias("n_pair_seed_cases"),
        ratio(acc, n).alias("accept_rate"),
        fa.alias("false_accept_count"),
        ratio(fa, acc).alias("false_accept_rate_among_accepted"),
        ratio(fa, n).alias("false_accept_fraction_all"),
        ratio(F.count_if("reliable"), n).alias("reliable_fraction"),
        F.avg(F.when(F.col("accepted"), err)).alias("accepted_mae"),
        F.avg(F.when(~F.col("accepted"), err)).alias("rejected_mae"),
        F.avg(err).alias("overall_mae"),
    )


def gate_validation(roles: dict[str, DataFrame], gate_kind: str) -> DataFrame:
    """Decision tables of one gate over several roles, each under its own label."""
    parts = [gate_table(d.where(F.col("gate_kind") == gate_kind)).withColumn("evaluation_role", F.lit(label)) for label, d in roles.items()]
    return reduce(DataFrame.unionByName, parts)


def step_overlap(fixed: DataFrame) -> DataFrame:
    """Rank correlation of a target's step with its overlap, for each seed."""
    return spearman(fixed, ["split", "training_seed", "estimator"], "target_step", "median_prompt_relative_ess")


def matched_refresh(rolling: DataFrame, estimator: str = "prompt_wis") -> DataFrame:
    """Old and recent logs of each seed side by side."""
    rows = rolling.where(F.col("estimator") == estimator)
    better = F.coalesce(F.col("recent_absolute_error") < F.col("old_absolute_error"), F.lit(False))
    return rows.groupBy("split", "training_seed").agg(F.count(F.lit(1)).alias("n"), *(finite_mean(F.col(c)).alias(f"mean_{c}") for c in ("old_absolute_error", "recent_absolute_error", "old_median_relative_ess", "recent_median_relative_ess")), F.count_if(better).alias("n_recent_better"))


def training_summary(metrics: DataFrame) -> DataFrame:
    """Last metrics of each seed, its greatest memory and mean speed."""
    last = lambda c: F.max_by(finite(F.col(c)), F.col("step"))
    names = ("mean_reward", "correctness_reward", "kl_proxy", "mean_completion_length", "truncation_rate")
    return metrics.groupBy("training_seed").agg(F.max("step").alias("final_step"), *(last(c).alias(f"final_{c}") for c in names if c in metrics.columns), F.max("gpu_memory_peak_bytes").alias("peak_gpu_memory_bytes"), finite_mean(F.col("tokens_per_second")).alias("mean_tokens_per_second"))


def sample_size_summary(table: DataFrame) -> DataFrame:
    out = [finite_mean(F.col(c)).alias(f"mean_{c}") for c in ("absolute_error", "median_prompt_relative_ess", "bootstrap_ci_width", "bootstrap_nonfinite_fraction") if c in table.columns]
    return table.groupBy("K", "estimator").agg(F.count(F.lit(1)).alias("n_pair_seed_cases"), *out)


def heatmap(overlap: DataFrame) -> DataFrame:
    """Median relative effective sample size by quarter of length and quarter of drift, first logs only.

    Bins are half open, the last closed. A split with fewer than four distinct drifts, edges that
    meet, or more than four empty cells gives no rows.
    """
    rows = overlap.where("behavior_step = 0").withColumn("drift", finite(F.col("pair_abs_mean_log_ratio_per_token"))).where("drift is not null")
    edges = rows.groupBy("split").agg(F.percentile("drift", F.array(*(F.lit(q) for q in (0.0, 0.25, 0.5, 0.75, 1.0)))).alias("edges"), F.count_distinct("drift").alias("levels"))
    edges = edges.where(F.size(F.array_distinct("edges")) == 5).where("levels >= 4")
    rows = rows.join(F.broadcast(edges), "split")  # a row a split
    at = F.when(F.col("drift") < F.col("edges")[1], 1).when(F.col("drift") < F.col("edges")[2], 2).when(F.col("drift") < F.col("edges")[3], 3).otherwise(4)
    cells = rows.groupBy("split", "length_quantile", at.cast("bigint").alias("drift_quantile")).agg(F.median("relative_ess").alias("median_relative_ess"), F.count(F.lit(1)).alias("n"))
    return cells.withColumn("_cells", F.count(F.lit(1)).over(Window.partitionBy("split"))).where("_cells >= 12").drop("_cells")


def average_rank(x: str, keys: list[str]) -> Column:
    """Rank among the rows of a group, ties sharing their mean rank."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, x)) - 1) / 2.0


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation of two columns in each group; NULL where one is constant."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    rows = rows.withColumns({"_x": average_rank(x, keys), "_y": average_rank(y, keys)})
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pair_cases"), correlation(F.col("_x"), F.col("_y")).alias("spearman"))


def diagnostic_benchmark(fixed: DataFrame) -> DataFrame:
    """Rank correlation of each diagnostic with the absolute error, over all seeds and for each."""
    long = F.inline(F.array(*(F.struct(F.lit(d).alias("diagnostic"), F.lit(f).alias("diagnostic_family"), F.col(d).alias("value")) for d, f in DIAGNOSTIC_FAMILIES)))
    rows = fixed.select("split", "estimator", "absolute_error", F.explode(F.array(F.lit("pooled"), F.col("training_seed").cast("string"))).alias("scope"), *DIAGNOSTIC_COLUMNS).select("split", "estimator", "scope", "absolute_error", long)
    out = spearman(rows, ["split", "scope", "estimator", "diagnostic", "diagnostic_family"], "value", "absolute_error")
    return out.withColumnRenamed("spearman", "spearman_with_absolute_error").withColumn("absolute_spearman", F.abs("spearman_with_absolute_error"))


DIAGNOSTIC_COLUMNS = [d for d, _ in DIAGNOSTIC_FAMILIES]


def reuse_horizon(fixed: DataFrame, tolerances: tuple[float, ...] = (0.01, 0.02, 0.05), prefix: bool = False) -> DataFrame:
    """How far past its log a target stays within a tolerance: its last reliable step, or with ``prefix`` the end of the first reliable run."""
    keys = ["split", "training_seed", "behavior_step", "estimator", "tolerance"]
    rows = fixed.select("*", F.explode(F.array(*(F.lit(t) for t in tolerances))).alias("tolerance"))
    rows = rows.withColumn("reliable", F.coalesce(F.col("absolute_error") <= F.col("tolerance"), F.lit(False)))
    counted = F.col("reliable")
    if prefix:
        w = Window.partitionBy(*keys).orderBy("target_step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.withColumn("_run", F.min("reliable").over(w))
        counted = F.col("_run")
    last = F.max(F.when(counted, F.col("target_step")))
    out = rows.groupBy(*keys).agg(last.alias("last_reliable_target_step"), F.count(F.lit(1)).alias("n_candidate_targets"), F.count_if("reliable").alias("n_reliable_targets"))
    return out.withColumn("horizon_steps", F.col("last_reliable_target_step") - F.col("behavior_step"))


def reference_inclusion(fixed: DataFrame) -> DataFrame:
    """How often the reference lies in the estimate's interval, ends included."""
    inside = (F.col("ope_ci_low") <= F.col("online_reference")) & (F.col("online_reference") <= F.col("ope_ci_high"))
    return fixed.groupBy("split", "estimator").agg(F.count(F.lit(1)).alias("n_pair_seed_cases"), F.count_if(inside).alias("mc_reference_inclusion_count"), ratio(F.count_if(inside), F.count(F.lit(1))).alias("mc_reference_inclusion_rate"))


def pooled(df: DataFrame, x: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """Mean of y for each x, and within each group if keys are given."""
    return df.groupBy(*(keys or []), x).agg(finite_mean(F.col(y)).alias(f"mean_{y}"), F.count(F.lit(1)).alias("n"))


def series(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Each group's points in the order of x, for a plot: a point for each row of a report table."""
    return df.where(finite(F.col(y)).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))).alias("points"))


# Characters that LaTeX reads as commands, and what stands for them.
LATEX = (("\\", "\\textbackslash{}"), ("&", "\\&"), ("%", "\\%"), ("$", "\\$"), ("#", "\\#"), ("_", "\\_"), ("{", "\\{"), ("}", "\\}"), ("~", "\\textasciitilde{}"), ("^", "\\textasciicircum{}"))


def latex_escape(text: Column) -> Column:
    """Text in which no character is a LaTeX command: each character is put once."""

    def one(c: Column) -> Column:
        out = None
        for x, by in LATEX:
            out = F.when(c == x, F.lit(by)) if out is None else out.when(c == x, F.lit(by))
        return out.otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


# What stands for digits in names that may hold letters only.
DIGITS = ("Zero", "One", "Two", "Three", "Four", "Five", "Six", "Seven", "Eight", "Nine")


def macro_name(key: Column, prefix: str) -> Column:
    """A name of letters alone: runs of letters begin with a capital, digits become words, the rest goes."""
    words = F.array(*(F.lit(w) for w in DIGITS))
    spelt = lambda part: F.array_join(F.transform(F.split(part, ""), lambda c: F.coalesce(F.get(words, c.try_cast("int")), F.lit(""))), "")
    capital = lambda part: F.concat(F.upper(F.substring(part, 1, 1)), F.substr(part, F.lit(2)))
    parts = F.regexp_extract_all(key, F.lit("[A-Za-z]+|[0-9]+"), F.lit(0))
    return F.concat(F.lit(prefix), F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), spelt(p)).otherwise(capital(p))), ""))


def key_values(df: DataFrame, name: Column, columns: list[str]) -> DataFrame:
    """``(key, value)`` of table cells, the key made of a row's name and the column's."""
    cells = F.array(*(F.struct(F.concat_ws(".", name, F.lit(c)).alias("key"), F.col(c).cast("double").alias("value")) for c in columns))
    return df.select(F.inline(cells))


def formatted(x: Column, digits: int = 4) -> Column:
    """A number as text: scientific from 1000 on and below 10 ** (1 - digits); "NA" where there is none."""
    plain = F.format_string(f"%.{digits}f", x)
    science = F.format_string(f"%.{max(digits - 1, 1)}e", x)
    return F.when(x.isNull() | F.isnan(x), F.lit("NA")).when((x != 0) & ((F.abs(x) >= 1000) | (F.abs(x) < 10.0 ** (1 - digits))), science).otherwise(plain)
