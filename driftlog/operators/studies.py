"""Design studies: how far a smaller grid, fewer samples or fewer prompts would change results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftlog.operators.overlap import PAIR
from driftlog.operators.rescoring import spaced_targets

SCOPES = ("all", "calibration", "validation")


def seed_scopes(spark: SparkSession, calibration: list[int], validation: list[int]) -> DataFrame:
    rows = [(s, "all") for s in {*calibration, *validation}] + [(s, "calibration") for s in calibration] + [(s, "validation") for s in validation]
    return spark.createDataFrame(rows, "training_seed bigint, scope string")


def _grid_summary(cases: DataFrame, thresholds: DataFrame, keys: list[str]) -> DataFrame:
    """Means by part and gate rates by tolerance, a row a candidate, scope and tolerance."""
    fixed, rolling = F.col("purpose") == "fixed", F.col("purpose") == "rolling"
    accept = ~F.col("reject_all") & (F.col("ress") >= F.col("fitted_threshold"))
    rows = cases.crossJoin(F.broadcast(thresholds.select("tolerance", "fitted_threshold", "reject_all"))).withColumn("accept", accept)  # tolerances: a handful
    when = lambda c, x: F.avg(F.when(c, F.col(x)))
    better = F.coalesce(F.col("absolute_error") < F.col("old_absolute_error"), F.lit(False)).cast("double")
    return rows.groupBy(*keys, "tolerance").agg(
        F.count_if(fixed).alias("n_fixed"),
        F.count_if(rolling).alias("n_rolling"),
        when(fixed, "absolute_error").alias("fixed_mean_mae"),
        when(fixed, "ress").alias("fixed_mean_ress"),
        when(rolling, "absolute_error").alias("rolling_mean_recent_mae"),
        when(rolling, "old_absolute_error").alias("rolling_mean_old_mae"),
        F.avg(F.when(rolling, F.col("old_absolute_error") - F.col("absolute_error"))).alias("rolling_mean_error_reduction"),
        F.avg(F.when(rolling, better)).alias("rolling_fraction_recent_better"),
        when(rolling, "ress").alias("rolling_mean_ress"),
        F.avg(F.col("accept").cast("double")).alias("gate_accept_rate"),
        F.avg((F.col("accept") & (F.col("absolute_error") > F.col("tolerance"))).cast("double")).alias("gate_false_accept_fraction_all"),
        when(F.col("accept"), "absolute_error").alias("gate_accepted_mae"),
    )


METRICS = ["fixed_mean_mae", "fixed_mean_ress", "rolling_mean_recent_mae", "rolling_mean_old_mae", "rolling_mean_error_reduction", "rolling_fraction_recent_better", "rolling_mean_ress", "gate_accept_rate", "gate_false_accept_fraction_all", "gate_accepted_mae"]


def members(cases: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every case with each candidate that has its target (fixed cases) or its lag (rolling ones), once.

    Candidates are turned into an index from kind and step to candidate, which cases meet by equality.
    """

    def steps(kind: str, column: str) -> Column:
        return F.transform(F.array_distinct(column), lambda x: F.struct(F.lit(kind).alias("purpose"), x.cast("bigint").alias("_step")))

    index = candidates.select(*(c for c in candidates.columns if c not in ("targets", "lags")), F.inline(F.concat(steps("fixed", "targets"), steps("rolling", "lags"))))
    step = F.when(F.col("purpose") == "fixed", F.col("target_step")).when(F.col("purpose") == "rolling", F.col("target_step") - F.col("behavior_step"))
    return cases.withColumn("_step", step.cast("bigint")).join(index, ["purpose", "_step"]).drop("_step")


def grid_candidates(cases: DataFrame, candidates: DataFrame, scopes: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Distortion of each candidate grid against the full one.

    ``cases``: purpose, training_seed, behavior_step, target_step, absolute_error, old_absolute_error,
    ress. ``candidates``: candidate_id, targets, lags. Differences are 0 where both sides have no
    value and infinite where one has none.
    """
    scoped = cases.join(F.broadcast(scopes), "training_seed")  # scopes, candidates: the design
    full = _grid_summary(scoped, thresholds, ["scope"]).select("scope", "tolerance", *(F.col(m).alias(f"full_{m}") for m in METRICS))
    chosen = members(scoped, candidates)
    out = _grid_summary(chosen, thresholds, ["candidate_id", "scope"]).join(full, ["scope", "tolerance"])
    gap = lambda m: F.when(F.col(m).isNull() & F.col(f"full_{m}").isNull(), F.lit(0.0)).otherwise(F.coalesce(F.abs(F.col(m) - F.col(f"full_{m}")), F.lit(float("inf"))))
    return out.select("candidate_id", "scope", "tolerance", "n_fixed", "n_rolling", *METRICS, *(gap(m).alias(f"absdiff_{m}") for m in METRICS))


# Lags of the candidate grids, the design's identity steps and anchors, and the greatest distortion of each kind.
LAG_PATTERNS = {"mid": (60,), "endpoints": (20, 100), "balanced2": (40, 80), "end_mid": (20, 60, 100)}
IDENTITY_STEPS, ROLLING_ANCHORS = (0, 100, 200, 300), (100, 200, 300)
LIMITS = {"fixed_mean_mae": 0.0025, "fixed_mean_ress": 0.05, "rolling_mean_error_reduction": 0.003, "rolling_fraction_recent_better": 0.1, "gate_accept_rate": 0.08, "gate_false_accept_fraction_all": 0.05, "gate_accepted_mae": 0.004}


def candidate_grids(spark: SparkSession, n_seeds: int, fewest: int, most: int, max_fixed: int = 12) -> DataFrame:
    """Grids of evenly spaced targets and a pattern of lags, with their number of pairs over all seeds: some dozens of rows."""
    patterns = spark.createDataFrame([(i, name, list(lags)) for i, (name, lags) in enumerate(LAG_PATTERNS.items())], "at int, lag_pattern string, lags array<bigint>")
    targets = spark.createDataFrame([(n, list(spaced_targets(n))) for n in range(1, max_fixed + 1)], "n int, targets array<bigint>")
    per_seed = F.col("n") + len(ROLLING_ANCHORS) * F.size("lags") + len(IDENTITY_STEPS)
    rows = patterns.join(F.broadcast(targets)).withColumn("total_pairs", (n_seeds * per_seed).cast("bigint")).where(F.col("total_pairs").between(fewest, most))
    number = F.row_number().over(Window.orderBy("at", "n"))  # dozens of rows
    return rows.select(F.format_string("C%03d", number).alias("candidate_id"), "lag_pattern", "total_pairs", "targets", "lags")


def grid_verdicts(metrics: DataFrame, candidates: DataFrame, limits: dict[str, float] = LIMITS) -> DataFrame:
    """Worst distortion of each candidate over all seeds and the validation ones and over tolerances, its score, and whether all limits hold."""
    worst = metrics.where("scope in ('all', 'validation')").groupBy("candidate_id").agg(*(F.max(f"absdiff_{m}").alias(f"worst_{m}") for m in limits))
    score, passed = F.lit(0.0), F.lit(True)
    for m, most in limits.items():
        score, passed = score + F.col(f"worst_{m}") / F.lit(most), passed & (F.col(f"worst_{m}") <= most)
    return candidates.join(worst, "candidate_id").withColumns({"distortion_score": score, "passed": passed})


def recommended_grid(verdicts: DataFrame) -> DataFrame:
    """The passing grid of fewest pairs; the least score, then the id, decides among equals."""
    return cheapest(verdicts, "passed", "total_pairs", ["distortion_score", "candidate_id"])


def cheapest(scored: DataFrame, passed: str, cost: str, ties: list[str]) -> DataFrame:
    """The cheapest row that passes; ties by the columns given."""
    return scored.where(passed).orderBy(cost, *ties).limit(1)


def common_prefix(samples: DataFrame, keys: list[str], value: str = "correct") -> DataFrame:
    """Number of first samples that every prompt of a key has: the least number of different indices of a prompt.

    ``valid`` is false where a prompt lacks one of these first indices; ``n_conflicts`` counts indices with
    more than one value. Indices below 0 do not count; samples that repeat count once.
    """
    seen = F.collect_set(F.struct(F.col("sample_index").alias("i"), F.col(value).alias("v")))
    per = samples.where("sample_index >= 0").groupBy(*keys, "prompt_id").agg(seen.alias("s"))  # samples of one prompt
    per = per.withColumn("at", F.array_sort(F.array_distinct(F.transform("s", lambda x: x["i"]))))
    per = per.select(*keys, F.size("at").cast("bigint").alias("n"), F.size(F.filter("at", lambda x, i: x == i)).cast("bigint").alias("first"), (F.size("s") - F.size("at")).cast("bigint").alias("conflicts"))
    return per.groupBy(*keys).agg(F.min("n").alias("full_l"), F.count(F.lit(1)).alias("n_prompts"), (F.min("first") >= F.min("n")).alias("valid"), F.sum("conflicts").alias("n_conflicts"))


def reference_sizes(samples: DataFrame, results: DataFrame, sizes: list[int]) -> DataFrame:
    """Effect of a reference from the first L samples on the reference itself and on fixed errors, by L."""
    key = ["split", "training_seed", "target_step"]
    size = F.explode(F.array(*(F.lit(x).cast("bigint") for x in sizes))).alias("L")
    prompts = samples.groupBy(*key, "prompt_id").agg(F.avg("correct").alias("full"), *(F.avg(F.when(F.col("sample_index") < x, F.col("correct"))).alias(f"l{x}") for x in sizes))
    at = lambda pre: F.coalesce(*(F.when(F.col("L") == x, F.col(f"{pre}{x}")) for x in sizes))
    prompts = prompts.select("*", size).withColumn("part", at("l"))
    targets = prompts.groupBy(*key, "L").agg(F.avg("full").alias("full_reference"), F.avg("part").alias("candidate_reference"), F.avg(F.abs(F.col("part") - F.col("full"))).alias("prompt_mae"), F.percentile(F.abs(F.col("part") - F.col("full")), F.lit(0.95)).alias("prompt_p95"))
    effect = results.where("purpose = 'fixed' and estimator = 'prompt_wis' and estimate is not null").select(*key, "estimate").join(targets, key)
    change = F.abs(F.abs(F.col("estimate") - F.col("candidate_reference")) - F.abs(F.col("estimate") - F.col("full_reference")))
    gap = F.abs(F.col("candidate_reference") - F.col("full_reference"))
    return effect.groupBy("split", "L").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(gap).alias("mean_reference_diff"), F.median(gap).alias("median_reference_diff"), F.percentile(gap, F.lit(0.95)).alias("p95_reference_diff"), F.max(gap).alias("max_reference_diff"),
        F.avg("prompt_mae").alias("mean_prompt_mae"), F.max("prompt_p95").alias("max_prompt_p95"),
        F.avg(change).alias("mean_error_change"), F.median(change).alias("median_error_change"), F.percentile(change, F.lit(0.95)).alias("p95_error_change"), F.max(change).alias("max_error_change"),
    )


# Steps that keep more samples, and the greatest changes of a plan of sample sizes.
AUDIT_STEPS = (0, 100, 200, 300, 400)
TOLERATED = {"reference": (0.005, 0.0125), "fixed": (0.005, 0.0125), "rolling": (0.005, 0.0125)}


def sample_plans(samples: DataFrame, fixed: DataFrame, rolling: DataFrame, plans: DataFrame, scopes: DataFrame) -> DataFrame:
    """Effect of references from fewer samples, by plan (``main_l``, ``audit_l``), split and scope.

    A target at an audit step takes its first ``audit_l`` samples, any other its first ``main_l``. Changes are
    those of the reference, of the fixed cases' absolute error and of the rolling cases' difference of errors.
    ``valid`` is false where a target has fewer samples than its plan takes; plans and scopes are designs.
    """
    key = ["split", "training_seed", "target_step"]
    size = F.when(F.col("target_step").isin(*AUDIT_STEPS), F.col("audit_l")).otherwise(F.col("main_l"))
    prompts = samples.groupBy(*key, "prompt_id").agg(F.array_sort(F.collect_set(F.struct("sample_index", "correct"))).alias("s"))  # samples of one prompt
    length = prompts.groupBy(*key).agg(F.min(F.size("s")).alias("full_l"))
    prompts = prompts.join(length, key).withColumn("x", F.transform(F.slice("s", F.lit(1), F.col("full_l")), lambda s: s["correct"]))
    share = lambda n: F.aggregate(F.slice("x", F.lit(1), n), F.lit(0.0), lambda a, x: a + x) / n
    rows = prompts.crossJoin(F.broadcast(plans)).withColumn("l", F.least(size, F.col("full_l")).cast("int"))  # plans: the design
    rows = rows.withColumns({"full": share(F.col("full_l")), "part": share(F.col("l")), "short": size > F.col("full_l")})
    gap = F.abs(F.col("part") - F.col("full"))
    targets = rows.groupBy("main_l", "audit_l", *key).agg(F.avg("full").alias("full"), F.avg("part").alias("part"), F.avg(gap).alias("prompt_mae"), F.max("short").alias("short"))
    base = targets.select("main_l", "audit_l", *key, F.lit("reference").alias("kind"), F.abs(F.col("part") - F.col("full")).alias("change"), "prompt_mae", "short")
    none = F.lit(None).cast("double").alias("prompt_mae")
    error = lambda e, r: F.abs(F.col(e) - F.col(r))
    one = fixed.where("estimate is not null").select(*key, "estimate").join(targets, key)
    one = one.select("main_l", "audit_l", *key, F.lit("fixed").alias("kind"), F.abs(error("estimate", "part") - error("estimate", "full")).alias("change"), none, "short")
    two = rolling.where("old_estimate is not null and recent_estimate is not null").select(*key, "old_estimate", "recent_estimate").join(targets, key)
    delta = lambda r: error("old_estimate", r) - error("recent_estimate", r)
    two = two.select("main_l", "audit_l", *key, F.lit("rolling").alias("kind"), F.abs(delta("part") - delta("full")).alias("change"), none, "short")
    every = base.unionByName(one).unionByName(two).join(F.broadcast(scopes), "training_seed")
    return every.groupBy("main_l", "audit_l", "split", "scope", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.avg("change").alias("mean_change"), F.median("change").alias("median_change"), F.percentile("change", F.lit(0.95)).alias("p95_change"), F.max("change").alias("max_change"),
        F.avg("prompt_mae").alias("mean_prompt_mae"), (~F.max("short")).alias("valid"),
    )


def plan_verdicts(effects: DataFrame, n_main: int, n_audit: int, tolerated: dict[str, tuple[float, float]] = TOLERATED) -> DataFrame:
    """Plans whose mean and 95th percentile of change are tolerated in every split and scope, with the share of cost they take."""
    ok = F.col("valid")
    for kind, (mean, p95) in tolerated.items():
        ok = ok & ((F.col("kind") != kind) | ((F.col("mean_change") <= mean) & (F.col("p95_change") <= p95)))
    frozen = n_main * 8 + n_audit * 32
    cost = (F.col("main_l") * n_main + F.col("audit_l") * n_audit) / F.lit(float(frozen))
    return effects.groupBy("main_l", "audit_l").agg(F.min(ok).alias("passed")).withColumn("cost_fraction", cost)


def cost_fraction(main: int, audit: int, n_main: int, n_audit: int, frozen_main: int = 8, frozen_audit: int = 32) -> float:
    frozen = n_main * frozen_main + n_audit * frozen_audit
    return (n_main * main + n_audit * audit) / frozen if frozen else float("nan")


def prompt_subsets(matched: DataFrame, thresholds: DataFrame, fractions: list[float], reps: int, source: str, salt: str) -> DataFrame:
    """Agreement of gate decisions on random subsets of sources (shards of prompts) with those on all, by fraction and tolerance.

    A replicate takes the sources with the least hashes, ``round(fraction * n)`` of them and one at least.
    """
    full = matched.groupBy(*PAIR).agg(F.avg("pwis").alias("full_estimate"), F.avg("prompt_accuracy").alias("full_reference"), F.median("relative_ess").alias("full_ress"))
    sources = matched.select("split", "training_seed", "behavior_step", F.col(source).alias("source")).distinct()
    key = ["split", "training_seed", "behavior_step", "replicate"]
    sources = sources.select("*", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("replicate"))
    rank = F.sha2(F.concat_ws("|", F.lit(salt), *(F.col(c).cast("string") for c in ("replicate", "training_seed", "behavior_step", "source"))), 256)
    w = Window.partitionBy(*key)
    sources = sources.withColumns({"at": F.row_number().over(w.orderBy(rank, "source")), "n": F.count(F.lit(1)).over(w)})
    sources = sources.select("*", F.explode(F.array(*(F.lit(f) for f in fractions))).alias("fraction"))
    chosen = sources.where(F.col("at") <= F.greatest(F.lit(1), F.least(F.col("n"), F.bround(F.col("fraction") * F.col("n")))))
    rows = matched.withColumn("source", F.col(source)).join(chosen.select(*key, "fraction", "source"), ["split", "training_seed", "behavior_step", "source"])
    part = rows.groupBy(*PAIR, "fraction", "replicate").agg(F.avg("pwis").alias("estimate"), F.avg("prompt_accuracy").alias("reference"), F.median("relative_ess").alias("ress"))
    part = part.join(full, PAIR).crossJoin(F.broadcast(thresholds.select("tolerance", "fitted_threshold", "reject_all")))  # tolerances: a handful
    err, full_err = F.abs(F.col("estimate") - F.col("reference")), F.abs(F.col("full_estimate") - F.col("full_reference"))
    accept = lambda c: ~F.col("reject_all") & (F.col(c) >= F.col("fitted_threshold"))
    part = part.withColumns({"sub": accept("ress"), "whole": accept("full_ress"), "change": F.abs(err - full_err)})
    each = part.groupBy("split", "fraction", "tolerance", "replicate").agg(F.avg((F.col("sub") == F.col("whole")).cast("double")).alias("agreement"), F.abs(F.avg(F.col("sub").cast("double")) - F.avg(F.col("whole").cast("double"))).alias("accept_diff"), F.median("change").alias("median_change"), F.percentile("change", F.lit(0.95)).alias("p95_change"))
    return each.groupBy("split", "fraction", "tolerance").agg(F.avg("agreement").alias("mean_gate_agreement"), F.avg("accept_diff").alias("mean_accept_rate_diff"), F.avg("median_change").alias("mean_median_error_change"), F.percentile("p95_change", F.lit(0.95)).alias("p95_of_p95_error_change"))


def first_passing(summary: DataFrame, agreement: float, accept_diff: float, median_change: float, p95_change: float) -> DataFrame:
    """Least fraction whose every row meets all bounds."""
    ok = (F.col("mean_gate_agreement") >= agreement) & (F.col("mean_accept_rate_diff") <= accept_diff) & (F.col("mean_median_error_change") <= median_change) & (F.col("p95_of_p95_error_change") <= p95_change)
    each = summary.groupBy("fraction").agg(F.min(ok).alias("passed"))
    return each.agg(F.min(F.when(F.col("passed"), F.col("fraction"))).alias("recommended_fraction"))
