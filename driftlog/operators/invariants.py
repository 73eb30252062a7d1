"""Invariants of the result tables. Each function returns the broken rules of a table's rows in one pass over it.

A value that is NULL, NaN or infinite breaks no rule that compares it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlog.functions.numeric import finite, is_close
from driftlog.operators.checks import broken
from driftlog.operators.overlap import PAIR

# Labels that tables may hold.
QUARTERS = ("Q1_short", "Q2", "Q3", "Q4_long", "")
ACCEPTING = ("accept", "reuse", "accepted")
ESTIMATORS = ("is", "prompt_wis")


def _outside(x: Column, low: Column | float, high: Column | float, slack: float) -> Column:
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return ~finite(x).between(low - slack, high + slack)


def _apart(x: str, wanted: Column, atol: float = 1e-10) -> Column:
    return ~is_close(finite(F.col(x)), finite(wanted), atol=atol)


def _share(k: Column) -> Column:
    return F.try_divide(F.lit(1.0), k.cast("double"))


def training(df: DataFrame, mode: str | None = None, keys: tuple[str, ...] = ("training_seed", "step")) -> DataFrame:
    """Training metrics: steps are not negative, truncation is a share, and all rows are of the mode if one is given."""
    rules = {"step": F.col("step") < 0, "truncation_rate": _outside(F.col("truncation_rate"), 0.0, 1.0, 1e-12)}
    if mode:
        rules["mode"] = ~F.col("mode").eqNullSafe(F.lit(mode))
    return broken(df, rules, list(keys))


def missing_seeds(df: DataFrame, seeds: list[int]) -> DataFrame:
    """Seeds of the design that a table has no row of."""
    design = df.sparkSession.createDataFrame([(s,) for s in seeds], "training_seed bigint")
    return design.join(df.select(F.col("training_seed").cast("bigint").alias("training_seed")).distinct(), "training_seed", "left_anti")


def fixed_reuse(df: DataFrame) -> DataFrame:
    """Fixed cases start from step 0, have samples, an overlap in its range, and errors that follow from estimate and reference."""
    ok = (F.col("estimate_status") == "ok") & finite(F.col("estimate")).isNotNull() & finite(F.col("online_reference")).isNotNull()
    error = F.col("estimate") - F.col("online_reference")
    return broken(df, {
        "behavior_step": F.col("behavior_step") != 0,
        "K": F.col("K") <= 0,
        "median_relative_ess": _outside(F.col("median_prompt_relative_ess"), _share(F.col("K")), 1.0, 1e-8),
        "signed_error": ok & _apart("signed_error", error),
        "absolute_error": ok & _apart("absolute_error", F.abs(error)),
    }, [*PAIR, "estimator"])


def overlap_rows(df: DataFrame) -> DataFrame:
    """Prompt statistics in their ranges, and the quarter's label known."""
    k = F.col("K").cast("double")
    return broken(df, {
        "ess": _outside(F.col("ess"), 1.0, k, 1e-7),
        "relative_ess": _outside(F.col("relative_ess"), _share(k), 1.0, 1e-7),
        "ess_ratio": _apart("relative_ess", F.try_divide(F.col("ess"), k), atol=1e-8),
        "max_normalized_weight": _outside(F.col("max_normalized_weight"), _share(k), 1.0, 1e-7),
        "length_quantile": ~F.coalesce("length_quantile", F.lit("")).isin(*QUARTERS),
    }, [*PAIR, "prompt_id"])


def rolling(df: DataFrame) -> DataFrame:
    """Differences follow from both sides, and the recent log precedes its target."""
    return broken(df, {
        "delta_error": _apart("delta_error_old_minus_recent", F.col("old_absolute_error") - F.col("recent_absolute_error")),
        "delta_relative_ess": _apart("delta_relative_ess_recent_minus_old", F.col("recent_median_relative_ess") - F.col("old_median_relative_ess")),
        "recent_before_target": F.col("recent_behavior_step") >= F.col("target_step"),
    }, ["split", "training_seed", "target_step", "estimator", "recent_behavior_step"])


def calibration(df: DataFrame, estimator: str = "prompt_wis") -> DataFrame:
    """The gate is fitted on development cases of one estimator, and accepts a share of them."""
    rules = {"split": F.col("split") != "development", "accept_rate": _outside(F.col("accept_rate"), 0.0, 1.0, 1e-12)}
    if "estimator" in df.columns:
        rules["estimator"] = F.col("estimator") != estimator
    return broken(df, rules, ["split", "gate_kind", "tolerance"])


def decisions(df: DataFrame) -> DataFrame:
    """Flags of a decision follow from its error, tolerance and verdict."""
    accepted, reliable = F.col("accepted"), F.col("reliable")
    known = finite(F.col("absolute_error")).isNotNull() & finite(F.col("tolerance")).isNotNull()
    return broken(df, {
        "reliable": known & (reliable != (F.col("absolute_error") <= F.col("tolerance") + 1e-12)),
        "false_accept": F.col("false_accept") != (accepted & ~reliable),
        "false_reject": F.col("false_reject") != (~accepted & reliable),
        "decision": accepted & ~F.lower("decision").isin(*ACCEPTING),
    }, [*PAIR, "gate_kind", "tolerance"])


def robustness(df: DataFrame, dataset: str) -> DataFrame:
    """Rows are of the dataset and a known estimator, and the gate's flags follow from its verdict."""
    accepted, reliable = F.col("gate_accepted"), F.col("gate_reliable")
    return broken(df, {
        "dataset": F.upper("dataset") != dataset.upper(),
        "estimator": ~F.col("estimator").isin(*ESTIMATORS),
        "gate_false_accept": F.col("gate_false_accept") != (accepted & ~reliable),
        "gate_false_reject": F.col("gate_false_reject") != (~accepted & reliable),
    }, ["dataset", "training_seed", "behavior_step", "target_step", "estimator"])
