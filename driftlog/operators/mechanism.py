"""Why error moves between an old and a recent log: overlap and the rewarded share of squared weight.

For a target value v and a prompt's share alpha of squared weight on rewarded samples,
A = v^2 + (1 - 2v) alpha and the second moment is kappa2 * A.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlog.functions.numeric import clamp, mean_exp, safe_exp

KEY = ["split", "training_seed", "target_step", "old_behavior_step", "recent_behavior_step"]
# Names of the patterns and directions that a mechanism table holds.
PATTERN_A = "A_overlap_repairs_but_aggregate_risk_not_uniformly_improved"
PATTERN_B = "B_overlap_and_reward_stratum_mostly_align"
PATTERN_C = "C_overlap_dominates_adverse_reward_stratum_movement"
PATTERN_REST = "mixed_or_unclassified"
LOWER, HIGHER, NEUTRAL = "lower_alpha_favorable", "higher_alpha_favorable", "alpha_neutral_at_v_equals_half"


def unequal_sides(stats: DataFrame) -> DataFrame:
    """Comparisons whose recent and first log do not have the same prompts with the same number of samples."""
    on = ["split", "training_seed", "target_step"]
    old = stats.where("behavior_step = 0 and purpose = 'fixed'").select(*on, "prompt_id", F.col("K").alias("old_K"))
    new = stats.where("purpose = 'rolling'").select(*on, F.col("behavior_step").alias("recent_behavior_step"), "prompt_id", "K")
    both = new.join(old, [*on, "prompt_id"], "left").groupBy(*on, "recent_behavior_step").agg(F.count(F.lit(1)).alias("n_recent"), F.count("old_K").alias("n_both"), F.count_if(F.col("K") != F.col("old_K")).alias("n_other_k"))
    both = both.join(old.groupBy(*on).agg(F.count(F.lit(1)).alias("n_old")), on, "left").withColumn("n_old", F.coalesce("n_old", F.lit(0)))
    return both.where("n_recent <> n_both or n_old <> n_both or n_other_k > 0")


def infinite_gaps(rows: DataFrame) -> DataFrame:
    """Prompts with a second moment of zero on one side only, whose gap is infinite; a mechanism table rejects them."""
    return rows.where(F.col("old_log_m2_proxy").isNull() != F.col("recent_log_m2_proxy").isNull())


def prompt_mechanism(stats: DataFrame, reference: DataFrame, enforce: bool = False) -> DataFrame:
    """One row a prompt of every recent log beside the first log of the same seed and target.

    With ``enforce``, sides of unequal prompts or numbers of samples are an error, and so are prompts with
    a second moment of zero on one side only.
    """
    if enforce:
        found = unequal_sides(stats).limit(3).collect()  # enough to name
        if found:
            raise ValueError("sides differ: " + "; ".join(str(r.asDict()) for r in found))
        made = prompt_mechanism(stats, reference)
        found = infinite_gaps(made).select(*KEY, "prompt_id").limit(3).collect()
        if found:
            raise ValueError("infinite gaps: " + "; ".join(str(r.asDict()) for r in found))
        return made
    on = ["split", "training_seed", "target_step", "prompt_id"]
    side = lambda name: [F.col(c).alias(f"{name}_{n}") for c, n in (("behavior_step", "behavior_step"), ("alpha", "alpha"), ("d2", "log_kappa2"), ("relative_ess", "relative_ess"), ("log_sq_correct", "log_sq_correct"), ("log_sq_incorrect", "log_sq_incorrect"))]
    old = stats.where("behavior_step = 0 and purpose = 'fixed'").select(*on, *side("old"))
    new = stats.where("purpose = 'rolling'").select(*on, "K", *side("recent"))
    rows = new.join(old, on).join(reference.select("split", "training_seed", "target_step", "online_reference"), ["split", "training_seed", "target_step"])
    v = F.col("online_reference")
    factor = lambda name: clamp(v * v + (1 - 2 * v) * F.col(f"{name}_alpha"), 0.0, 1.0)
    rows = rows.withColumns({"old_A_proxy": factor("old"), "recent_A_proxy": factor("recent")})
    log_a = lambda name: F.when(F.col(f"{name}_A_proxy") > 0, F.ln(f"{name}_A_proxy"))
    rows = rows.withColumns({"_old_log_a": log_a("old"), "_recent_log_a": log_a("recent")})
    rows = rows.withColumns({f"{n}_log_m2_proxy": F.col(f"{n}_log_kappa2") + F.col(f"_{n}_log_a") for n in ("old", "recent")})
    gap = lambda c: F.when(F.col(f"recent_{c}").isNull() & F.col(f"old_{c}").isNull(), F.lit(0.0)).otherwise(F.col(f"recent_{c}") - F.col(f"old_{c}"))
    rows = rows.withColumns({
        "delta_alpha_recent_minus_old": F.col("recent_alpha") - F.col("old_alpha"),
        "delta_log_kappa2_recent_minus_old": F.col("recent_log_kappa2") - F.col("old_log_kappa2"),
        "delta_log_m2_proxy_recent_minus_old": gap("log_m2_proxy"),
        "delta_log_A_proxy_recent_minus_old": F.when(F.col("_recent_log_a").isNull() & F.col("_old_log_a").isNull(), F.lit(0.0)).otherwise(F.col("_recent_log_a") - F.col("_old_log_a")),
    })
    moves = F.when(v < 0.5, F.col("recent_alpha") < F.col("old_alpha")).when(v > 0.5, F.col("recent_alpha") > F.col("old_alpha")).otherwise(F.lit(False))
    return rows.withColumns({
        "overlap_channel_favorable": F.col("delta_log_kappa2_recent_minus_old") < 0,
        "reward_proxy_channel_favorable": F.col("recent_A_proxy") < F.col("old_A_proxy"),
        "combined_proxy_favorable": F.coalesce(F.col("delta_log_m2_proxy_recent_minus_old") < 0, F.lit(False)),
        "alpha_moves_favorable": moves,
    }).drop("_old_log_a", "_recent_log_a")


def identity_breaks(rows: DataFrame, tolerance: float = 3e-12) -> DataFrame:
    """Prompts whose second moment from the two reward strata differs from kappa2 * A; empty when all is well."""
    v = F.col("online_reference")

    def direct(name: str):
        a = F.col(f"{name}_log_sq_correct") + 2 * F.log1p(-v)
        b = F.col(f"{name}_log_sq_incorrect") + 2 * F.ln(v)
        top = F.greatest(a, b)  # skips NULL
        return top + F.ln(F.coalesce(F.exp(a - top), F.lit(0.0)) + F.coalesce(F.exp(b - top), F.lit(0.0))) - F.ln(F.col("K").cast("double"))

    bad = None
    for name in ("old", "recent"):
        x, y = F.col(f"{name}_log_m2_proxy"), direct(name)
        off = F.coalesce(F.abs(x - y) > F.greatest(F.lit(tolerance), F.lit(tolerance) * F.greatest(F.abs(x), F.abs(y))), x.isNull() != y.isNull())
        bad = off if bad is None else bad | off
    return rows.where(bad)


def pair_mechanism(rows: DataFrame) -> DataFrame:
    """Means and medians of a comparison's prompts, and ratios of second moments by both kinds of mean."""
    share = lambda c: F.avg(F.col(c).cast("double"))
    out = rows.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_prompts"),
        F.max("K").alias("K"),
        F.max("online_reference").alias("online_reference"),
        F.median("old_relative_ess").alias("old_median_relative_ess"),
        F.median("recent_relative_ess").alias("recent_median_relative_ess"),
        F.avg("old_alpha").alias("old_mean_alpha"),
        F.avg("recent_alpha").alias("recent_mean_alpha"),
        F.median("old_alpha").alias("old_median_alpha"),
        F.median("recent_alpha").alias("recent_median_alpha"),
        F.avg("old_A_proxy").alias("old_mean_A_proxy"),
        F.avg("recent_A_proxy").alias("recent_mean_A_proxy"),
        F.avg("delta_log_kappa2_recent_minus_old").alias("mean_delta_log_kappa2_recent_minus_old"),
        F.avg("delta_log_A_proxy_recent_minus_old").alias("mean_delta_log_A_proxy_recent_minus_old"),
        F.avg("delta_log_m2_proxy_recent_minus_old").alias("mean_delta_log_m2_proxy_recent_minus_old"),
        mean_exp(F.col("old_log_m2_proxy")).alias("log_mean_m2_proxy_old"),
        mean_exp(F.col("recent_log_m2_proxy")).alias("log_mean_m2_proxy_recent"),
        share("overlap_channel_favorable").alias("fraction_prompts_overlap_channel_favorable"),
        share("reward_proxy_channel_favorable").alias("fraction_prompts_reward_proxy_channel_favorable"),
        share("combined_proxy_favorable").alias("fraction_prompts_combined_proxy_favorable"),
        share("alpha_moves_favorable").alias("fraction_prompts_alpha_moves_favorable"),
    )
    v = F.col("online_reference")
    direction = F.when(v < 0.5, F.lit(LOWER)).when(v > 0.5, F.lit(HIGHER)).otherwise(F.lit(NEUTRAL))
    return out.withColumns({
        "alpha_favorable_direction": direction,
        "delta_mean_alpha_recent_minus_old": F.col("recent_mean_alpha") - F.col("old_mean_alpha"),
        "delta_mean_A_proxy_recent_minus_old": F.col("recent_mean_A_proxy") - F.col("old_mean_A_proxy"),
        "geometric_kappa2_ratio_recent_over_old": safe_exp(F.col("mean_delta_log_kappa2_recent_minus_old")),
        "geometric_A_proxy_ratio_recent_over_old": safe_exp(F.col("mean_delta_log_A_proxy_recent_minus_old")),
        "geometric_m2_proxy_ratio_recent_over_old": safe_exp(F.col("mean_delta_log_m2_proxy_recent_minus_old")),
        "aggregate_m2_proxy_ratio_recent_over_old": safe_exp(F.col("log_mean_m2_proxy_recent") - F.col("log_mean_m2_proxy_old")),
    })


def split_mechanism(pairs: DataFrame) -> DataFrame:
    """Counts of favourable pairs, means, and the pattern they make, for each split."""
    v, n = F.col("online_reference"), F.count(F.lit(1))
    alpha = F.when(v < 0.5, F.col("recent_mean_alpha") < F.col("old_mean_alpha")).when(v > 0.5, F.col("recent_mean_alpha") > F.col("old_mean_alpha")).otherwise(F.lit(False))
    out = pairs.groupBy("split").agg(
        n.alias("n_pairs"),
        F.count_distinct("training_seed").alias("n_training_seeds"),
        F.sum("n_prompts").alias("n_prompt_pair_rows"),
        F.count_if(F.col("recent_median_relative_ess") > F.col("old_median_relative_ess")).alias("pairs_ress_improved"),
        F.count_if(F.col("recent_mean_A_proxy") < F.col("old_mean_A_proxy")).alias("pairs_reward_proxy_channel_favorable"),
        F.count_if(F.col("mean_delta_log_m2_proxy_recent_minus_old") < 0).alias("pairs_prompt_geometric_m2_proxy_favorable"),
        F.count_if(F.col("aggregate_m2_proxy_ratio_recent_over_old") < 1).alias("pairs_aggregate_m2_proxy_favorable"),
        F.count_if(alpha).alias("pairs_alpha_mean_moved_favorable"),
        *(F.avg(f"{s}_{c}").alias(f"mean_{s}_{o}") for c, o in (("median_relative_ess", "ress"), ("mean_alpha", "alpha"), ("mean_A_proxy", "A_proxy")) for s in ("old", "recent")),
        *(safe_exp(F.avg(f"mean_delta_log_{c}_recent_minus_old")).alias(f"geometric_mean_{o}_ratio_recent_over_old") for c, o in (("kappa2", "kappa2"), ("A_proxy", "A_proxy"), ("m2_proxy", "promptwise_m2_proxy"))),
        F.avg("aggregate_m2_proxy_ratio_recent_over_old").alias("mean_pair_aggregate_m2_proxy_ratio_recent_over_old"),
        F.median("aggregate_m2_proxy_ratio_recent_over_old").alias("median_pair_aggregate_m2_proxy_ratio_recent_over_old"),
        safe_exp(F.avg(F.col("log_mean_m2_proxy_recent") - F.col("log_mean_m2_proxy_old"))).alias("geometric_mean_pair_aggregate_m2_proxy_ratio_recent_over_old"),
        F.min(v).alias("target_reference_min"),
        F.max(v).alias("target_reference_max"),
    )
    every = F.col("pairs_ress_improved") == F.col("n_pairs")
    risk = every & (F.col("pairs_aggregate_m2_proxy_favorable") == F.col("n_pairs"))
    few = 2 * F.col("pairs_alpha_mean_moved_favorable") < F.col("n_pairs")
    pattern = F.when(risk & few, F.lit(PATTERN_C)).when(risk, F.lit(PATTERN_B)).when(every, F.lit(PATTERN_A)).otherwise(F.lit(PATTERN_REST))
    return out.withColumn("mechanism_pattern", pattern)
