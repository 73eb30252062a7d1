"""Numeric column functions. Minus infinity is written as NULL, as in every frame of this library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Logarithms of the greatest and the least positive double.
LOG_GREATEST = 709.782712893384
LOG_LEAST = -744.4400719213812


def safe_exp(z: Column) -> Column:
    """exp(z); NULL (minus infinity) gives 0, NaN or overflow NULL, underflow 0."""
    return F.when(z.isNull(), F.lit(0.0)).when(F.isnan(z) | (z > LOG_GREATEST), F.lit(None).cast("double")).when(z < LOG_LEAST, F.lit(0.0)).otherwise(F.exp(z))


def safe_exp_status(z: Column) -> Column:
    return F.when(z.isNull(), F.lit("ok")).when(F.isnan(z) | (z > LOG_GREATEST), F.lit("nonfinite_estimator")).when(z < LOG_LEAST, F.lit("ok_underflow_to_zero")).otherwise(F.lit("ok"))


def finite(x: Column) -> Column:
    """x, or NULL where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def is_close(a: Column, b: Column, rtol: float = 1e-9, atol: float = 0.0) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(rtol) * F.greatest(F.abs(a), F.abs(b)), F.lit(atol))


def ratio(a: Column, b: Column) -> Column:
    """a / b; 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def next_up(x: Column) -> Column:
    """Least double above x."""
    return F.reflect(F.lit("java.lang.Math"), F.lit("nextUp"), x.cast("double")).cast("double")


def next_down(x: Column) -> Column:
    return F.reflect(F.lit("java.lang.Math"), F.lit("nextDown"), x.cast("double")).cast("double")


def clamp(x: Column, low: float | Column, high: float | Column) -> Column:
    """x within the bounds; NaN stays NaN."""
    lo, hi = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.when(F.isnan(x), x).otherwise(F.least(F.greatest(x, lo), hi))


def log_sum(values: Column) -> Column:
    """Logarithm of the sum of exp of an array's values, whatever their height; NULL (minus infinity) for none.

    NaN gives NaN, and plus infinity gives plus infinity. One pass with the greatest value so far.
    """
    start = F.struct(F.lit(float("-inf")).alias("m"), F.lit(0.0).alias("s"))

    def add(a: Column, x: Column) -> Column:
        m = F.greatest(a["m"], x)
        return F.struct(m.alias("m"), (a["s"] * F.exp(a["m"] - m) + F.exp(x - m)).alias("s"))

    infinite = F.lit(float("inf"))
    return F.aggregate(values, start, add, lambda a: F.when(a["m"] == infinite, infinite).when(a["s"] != 0, a["m"] + F.ln(a["s"])))


def weight(z: Column) -> Column:
    """A log weight, minus infinity put as NULL."""
    return F.nullif(z, F.lit(float("-inf")))


def log_sum_exp(z: Column) -> Column:
    """Aggregate: ``log_sum`` over a group, which holds the group's values, as an exact median beside it does."""
    return log_sum(F.collect_list(weight(z)))


def mean_exp(z: Column) -> Column:
    """Aggregate: logarithm of the mean of exp(z) over all rows, NULL counting as 0."""
    return log_sum_exp(z) - F.ln(F.count(F.lit(1)).cast("double"))


#: Height of the steps by which ``log_sums`` puts terms together; exp of it times any count is a double.
STEP = 500.0


def log_sums(df: DataFrame, keys: list[str], z: Column, terms: dict[str, Column], sums: dict[str, Column] | None = None) -> DataFrame:
    """By key: ``n`` rows, for each term the logarithm of the sum of exp(z) where its condition holds, and plain sums.

    Terms are first summed by key and step of height, with partial sums before the shuffle, so that a
    group of any size, and of any height, leaves a few rows; these are put together by ``log_sum``.
    """
    sums, height = sums or {}, F.when(F.abs("_z") < 1e15, F.floor(F.col("_z") / STEP) * F.lit(STEP)).otherwise(F.col("_z"))
    rows = df.select(*keys, weight(z).alias("_z"), *(c.alias(f"_if_{n}") for n, c in terms.items()), *(c.alias(n) for n, c in sums.items()))
    steps = rows.withColumn("_h", height).groupBy(*keys, "_h").agg(F.count(F.lit(1)).alias("n"), *((F.col("_h") + F.ln(F.sum(F.when(F.col(f"_if_{n}"), F.exp(F.col("_z") - F.col("_h")))))).alias(n) for n in terms), *(F.sum(n).alias(n) for n in sums))
    return steps.groupBy(*keys).agg(F.sum("n").alias("n"), *(log_sum(F.collect_list(n)).alias(n) for n in terms), *(F.sum(n).alias(n) for n in sums))


def finite_mean(x: Column) -> Column:
    return F.avg(finite(x))


def root_mean_square(x: Column) -> Column:
    return F.sqrt(F.avg(finite(x) * finite(x)))


def correlation(x: Column, y: Column) -> Column:
    """Aggregate: Pearson's coefficient; NULL where either side is constant."""
    return F.covar_pop(x, y) / F.nullif(F.sqrt(F.var_pop(x) * F.var_pop(y)), F.lit(0.0))
