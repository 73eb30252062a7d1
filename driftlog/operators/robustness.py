"""Transfer of a frozen gate to another dataset: pair templates, a registry spread over overlap, and its results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftlog.functions.numeric import ratio


def pair_templates(cases: DataFrame, seeds: list[int]) -> DataFrame:
    """Medians over the seeds of every pair of steps that has a case of each seed."""
    rows = cases.where(F.col("split") == "development").where(F.col("training_seed").isin(seeds))
    out = rows.groupBy("behavior_step", "target_step", "purpose").agg(F.count(F.lit(1)).alias("n"), F.median("median_prompt_relative_ess").alias("pooled_median_relative_ess"), F.median("tokenwise_kl_proxy").alias("pooled_tokenwise_kl_proxy"))
    return out.where(F.col("n") == len(seeds)).drop("n")


def spread_indices(n: int, k: int) -> list[int]:
    """k distinct indices of n, evenly spaced; a half goes to the even side, a taken index to the nearest free one, lower first."""
    if k > n:
        raise ValueError("more indices asked for than there are")
    if k == 1:
        return [n // 2]
    taken: set[int] = set()
    for i in range(k):
        want = round(i * (n - 1) / (k - 1))
        free = sorted((abs(x - want), x) for x in range(n) if x not in taken)
        taken.add(free[0][1])
    return sorted(taken)


def registry(templates: DataFrame, k: int = 8) -> DataFrame:
    """k templates spread from low to high overlap, with their band. Templates are a design grid, ranked in one task."""
    n = templates.count()
    rank = F.row_number().over(Window.orderBy("pooled_median_relative_ess", "behavior_step", "target_step")) - 1
    share = F.col("representative_rank") / F.lit(float(max(n - 1, 1)))
    band = F.when(share < 1 / 3, F.lit("low_overlap")).when(share < 2 / 3, F.lit("medium_overlap")).otherwise(F.lit("high_overlap"))
    rows = templates.withColumn("representative_rank", rank.cast("bigint")).withColumn("overlap_band", band)
    return rows.where(F.col("representative_rank").isin(spread_indices(n, min(k, n))))


def gated(results: DataFrame, decisions: DataFrame) -> DataFrame:
    """Results with the gate's decisions; ordinary estimates have none and say so."""
    key = ["split", "training_seed", "behavior_step", "target_step", "purpose"]
    wis = results.where("estimator = 'prompt_wis'").join(decisions.select(*key, "gate_kind", "tolerance", "decision", "accepted", "reliable", "false_accept", "false_reject"), key)
    plain = results.where("estimator = 'is'").withColumn("gate_kind", F.lit("not_applicable"))
    return wis.unionByName(plain, allowMissingColumns=True)


def band_summary(rows: DataFrame) -> DataFrame:
    """Decisions of the gates by tolerance and overlap band."""
    rows = rows.where("estimator = 'prompt_wis' and gate_kind in ('primary_ress', 'kl_baseline')")
    n, acc, fa = F.count(F.lit(1)), F.count_if("accepted"), F.count_if("false_accept")
    return rows.groupBy("gate_kind", "tolerance", "overlap_band").agg(
        n.alias("n_pair_seed_cases"), acc.alias("accepted_count"), ratio(acc, n).alias("accept_rate"), fa.alias("false_accept_count"), ratio(fa, acc).alias("false_accept_rate_among_accepted"), ratio(fa, n).alias("false_accept_fraction_all"),
        F.avg(F.when(F.col("accepted"), F.col("absolute_error"))).alias("accepted_mae"), F.avg(F.when(~F.col("accepted"), F.col("absolute_error"))).alias("rejected_mae"),
    )
