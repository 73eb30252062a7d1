"""Exact quantiles and ranks of groups of any size, without a group in one task.

Quantiles are selected by radix steps over the ordered bits of doubles: the first 22 bits of all
values are counted by group, with partial counts before the shuffle; the step that holds a wanted rank is found in the
group's counts; only values in such steps go on to the next 21 bits, and the last 21 give the value.
A group leaves at most 2^22 counts to one task in any step, whatever its size, and some hundreds as a rule.

Row numbers come from ranges: rows are dealt out by ranges of (group, order) and sorted, a row's place in
its range is its number there, and the counts of the ranges before it are joined to it. Ranks of ties
come from counts of distinct values in the same way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlog.sources.scratch import Scratch

#: Bits of the three steps.
STEPS = (22, 21, 21)


def ordered_bits(x: Column) -> Column:
    """A bigint in the order of the doubles: minus infinity least, NaN greatest, both zeros the same."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.coalesce(x.cast("double"), F.lit(0.0)) + F.lit(0.0)).cast("bigint")
    return F.when(x.isNotNull(), F.when(bits < 0, bits.bitwiseXOR(F.lit(2**63 - 1))).otherwise(bits))


def from_ordered_bits(k: Column) -> Column:
    bits = F.when(k < 0, k.bitwiseXOR(F.lit(2**63 - 1))).otherwise(k)
    return F.reflect(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double")


def on_keys(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys of which NULL is one as any other; the keys are those of ``a``. No other column may be in both."""
    other = b.withColumnsRenamed({k: f"_on_{k}" for k in keys})
    equal = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in keys), F.lit(True))
    return a.join(other, equal, how).drop(*(f"_on_{k}" for k in keys))


def beside(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Frames of one row a group side by side; NULL keys are a group. For frames of few rows a group."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return both.groupBy(*keys).agg(*(F.first(c, ignorenulls=True).alias(c) for c in both.columns if c not in keys))


def _picked(counts: DataFrame, wanted: DataFrame, outer: list[str], step: str) -> DataFrame:
    """The wanted ranks with the step that holds them and their rank within it; ``counts(outer, step, n)``, ``wanted(outer, which, rank)``."""
    before = F.sum("n").over(Window.partitionBy(*outer).orderBy(step).rowsBetween(Window.unboundedPreceding, -1))
    placed = counts.withColumn("_before", F.coalesce(before, F.lit(0)))
    inside = (F.col("rank") >= F.col("_before")) & (F.col("rank") < F.col("_before") + F.col("n"))
    joined = on_keys(placed, wanted, outer).where(inside)
    return joined.select(*outer, step, "which", (F.col("rank") - F.col("_before")).alias("rank"))


def quantiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]], scratch: Scratch) -> DataFrame:
    """``keys`` and, by name, the quantile of a column at a share, as ``percentile`` gives it: exact, linear between neighbours.

    NULLs are not counted; a group without values has NULL. NaN is the greatest value, zeros are one value.
    ``wanted``: name to (column, share). Runs jobs; the result may be read while the scratch folder is there.
    """
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("c"), ordered_bits(F.col(c)).alias("k")) for i, c in enumerate(columns)))).alias("x")
    values = scratch(df.select(*keys, each).select(*keys, "x.c", "x.k").where("k is not null"), "bits")
    first, second, third = (F.shiftright("k", sum(STEPS[i + 1 :])).alias(f"s{i}") if i < 2 else F.col("k").alias("s2") for i in range(3))
    group = [*keys, "c"]

    counts = scratch(values.groupBy(*group, first).agg(F.count(F.lit(1)).alias("n")), "counts")
    total = counts.groupBy(*group).agg(F.sum("n").alias("total"))
    asked = F.array(*(F.struct(F.lit(columns.index(c)).alias("of"), F.lit(i).alias("q"), F.lit(float(share)).alias("share")) for i, (c, share) in enumerate(wanted.values())))
    places = total.select(*group, "total", F.explode(asked).alias("x")).where("x.of = c").select(*group, "x.q", ((F.col("total") - 1).cast("double") * F.col("x.share")).alias("place"))
    places = scratch(places.withColumns({"low": F.floor("place").cast("bigint"), "high": F.ceil("place").cast("bigint")}), "places")
    ends = F.explode(F.array(*(F.struct((F.col("q") * 2 + i).alias("which"), F.col(c).alias("rank")) for i, c in enumerate(("low", "high"))))).alias("x")
    ranks = places.select(*group, ends).select(*group, "x.which", "x.rank")

    at = scratch(_picked(counts, ranks, group, "s0"), "first")
    some = at.select(*group, "s0").distinct()
    staged = values.select(*group, "k", first)
    left = scratch(on_keys(staged, some, [*group, "s0"], "left_semi").select(*group, "s0", second, third), "left")
    counts = left.groupBy(*group, "s0", "s1").agg(F.count(F.lit(1)).alias("n"))
    at = _picked(counts, at, [*group, "s0"], "s1").drop("s0")
    counts = left.groupBy(*group, "s1", "s2").agg(F.count(F.lit(1)).alias("n"))
    at = _picked(counts, at, [*group, "s1"], "s2")

    found = at.groupBy(*group, F.floor(F.col("which") / 2).cast("int").alias("q")).agg(F.max(F.when(F.col("which") % 2 == 0, F.col("s2"))).alias("k_low"), F.max(F.when(F.col("which") % 2 == 1, F.col("s2"))).alias("k_high"))
    found = on_keys(found, places, [*group, "q"]).select(*keys, "q", "k_low", "k_high", "place", "low", "high")
    low, high = from_ordered_bits(F.col("k_low")), from_ordered_bits(F.col("k_high"))
    value = F.when(F.col("k_low") == F.col("k_high"), low).otherwise((F.col("high") - F.col("place")) * low + (F.col("place") - F.col("low")) * high)
    found = found.select(*keys, "q", value.alias("value"))
    got = found.groupBy(*keys).agg(*(F.max(F.when(F.col("q") == i, F.col("value"))).alias(name) for i, name in enumerate(wanted)))
    if not keys:
        return got
    return beside([df.select(*keys).distinct(), got], keys)


def exact_quantiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """``quantiles`` as a table of its own."""
    with Scratch(df.sparkSession, "quantiles") as scratch:
        return scratch.result(quantiles(df, keys, wanted, scratch))


def numbered(df: DataFrame, keys: list[str], order: list[str], scratch: Scratch) -> DataFrame:
    """The rows with ``_rank``, from 0 by group in an order, and ``_n``, the group's rows: no group is in one task.

    ``order`` must tell the rows of a group apart for the numbers to be the same every time. NULLs come first.
    Runs jobs; the result may be read while the scratch folder is there.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by = [*keys, *order]
    dealt = df.repartitionByRange(n, *by).sortWithinPartitions(*by)
    # a row's number within its partition are the low 33 bits of this id
    rows = scratch(dealt.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))}), "dealt")
    parts = rows.groupBy(*keys, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_here"))  # ranges and groups: far fewer than rows
    w = Window.partitionBy(*keys)
    before = F.sum("_here").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    parts = scratch(parts.select(*keys, "_range", "_first", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_here").over(w).alias("_n")), "ranges")
    return on_keys(rows, parts, [*keys, "_range"]).select(*df.columns, (F.col("_before") + F.col("_at") - F.col("_first")).alias("_rank"), "_n")


def average_ranks(df: DataFrame, keys: list[str], values: list[str], scratch: Scratch) -> DataFrame:
    """The rows with ``rank_<value>`` for each column, from 1 by group, ties sharing the mean of theirs; NULL for NULL.

    Ranks are made for distinct values and their counts. Runs jobs, as ``numbered`` does.
    """
    out = df
    for v in values:
        counts = out.where(F.col(v).isNotNull()).groupBy(*keys, v).agg(F.count(F.lit(1)).alias("_count"))
        ranks = _summed(counts, keys, v, scratch).select(*keys, v, (F.col("_before") + (F.col("_count") + 1) / 2).alias(f"rank_{v}"))
        ranks = scratch(ranks, f"ranks-{v}")
        out = on_keys(out, ranks, [*keys, v], "left")
    return out


def _summed(counts: DataFrame, keys: list[str], order: str, scratch: Scratch) -> DataFrame:
    """``counts`` with ``_before``: the counts of a group's smaller values, range by range."""
    n = max(1, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = scratch(counts, "distinct").repartitionByRange(n, *keys, order).withColumn("_range", F.spark_partition_id())
    rows = scratch(rows, "dealt")
    parts = rows.groupBy(*keys, "_range").agg(F.sum("_count").alias("_here"))
    before = F.sum("_here").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    parts = scratch(parts.select(*keys, "_range", F.coalesce(before, F.lit(0)).alias("_ranges_before")), "ranges")
    within = F.sum("_count").over(Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_within", F.coalesce(within, F.lit(0)))  # one range of a group
    return on_keys(rows, parts, [*keys, "_range"]).select(*counts.columns, (F.col("_ranges_before") + F.col("_within")).alias("_before"))
