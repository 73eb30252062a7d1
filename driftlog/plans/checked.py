"""Queries of the checks, registries and studies, over tables with planted faults where a sound table would give no row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlog.functions import hashing
from driftlog.operators import checks, invariants, mechanism, overlap, registry, report, studies, tables
from driftlog.operators.overlap import PAIR
from driftlog.plans.catalogue import CALIBRATION, VALIDATION, _cases, _decisions, _design, _metrics, _prompts, _results, _stats, query, rounded
from driftlog.plans.fixtures import Fixture


def _counted(breaks: DataFrame, table: str) -> DataFrame:
    return breaks.groupBy("rule").agg(F.count(F.lit(1)).alias("n")).select(F.lit(table).alias("table"), "rule", "n")


@query
def extreme_weights(fx: Fixture) -> DataFrame:
    """Estimates over weights that no double's exponential holds, NaN and both infinities."""
    z = "transform(array('900', '-900', '8000', '-8000', 'NaN', 'Infinity', '-Infinity', '0'), x -> cast(x as double))"
    rows = fx.table("region").where("r_regionkey < 2").selectExpr("r_regionkey as prompt_id", f"posexplode({z}) as (target_step, z)").selectExpr("prompt_id", "cast(target_step as bigint) as target_step", "inline(array(struct(z as log_weight, 1e0 as correctness_reward), struct(0e0 as log_weight, 0e0 as correctness_reward)))")
    rows = rows.selectExpr("'x' as split", "1L as training_seed", "0L as behavior_step", "target_step", "'fixed' as purpose", "prompt_id", "log_weight", "correctness_reward", "5L as completion_length", "false as was_truncated")
    stats = overlap.prompt_stats(rows)
    made = overlap.estimates(stats).unionByName(overlap.pair_summary(stats).select(*PAIR, "estimator", "estimate", "estimate_status").withColumn("estimator", F.concat("estimator", F.lit("_summary"))))
    wis = overlap.global_wis(rows).select("target_step", F.lit("global_wis").alias("estimator"), F.col("global_wis").alias("estimate"), F.lit("-").alias("estimate_status"))
    small = F.when(F.col("estimate") < 1e6, F.round("estimate", 9)).when(F.col("estimate").isNotNull(), F.round(F.ln("estimate"), 6))  # large ones as logarithms
    return made.select("target_step", "estimator", "estimate", "estimate_status").unionByName(wis).withColumn("estimate", small)


@query
def table_invariants(fx: Fixture) -> DataFrame:
    """Broken rules of each result table by number: none of the tables as made, those planted of the spoilt ones."""
    results = _results(fx)
    fixed, rolling = tables.fixed_table(results), tables.rolling_table(results)
    stats = overlap.length_quantile(_stats(fx))
    chosen = _decisions(fx)
    sound = [invariants.fixed_reuse(fixed), invariants.overlap_rows(stats), invariants.rolling(rolling), invariants.decisions(chosen)]
    t = F.col("target_step")
    fixed = fixed.withColumns({"behavior_step": F.when(t == 20, F.lit(100)).otherwise(F.col("behavior_step")), "K": F.when(t == 40, F.lit(0)).otherwise(F.col("K")), "signed_error": F.when(t == 60, F.col("signed_error") + 1).otherwise(F.col("signed_error")), "absolute_error": F.when(t == 80, F.lit(None).cast("double")).when(t == 100, F.col("absolute_error") + 1).otherwise(F.col("absolute_error")), "median_prompt_relative_ess": F.when(t == 120, F.lit(1.5)).when(t == 140, F.lit(float("nan"))).otherwise(F.col("median_prompt_relative_ess"))})
    p = F.col("prompt_id")
    stats = stats.withColumns({"ess": F.when(p % 5 == 0, F.col("K") + 1.0).otherwise(F.col("ess")), "max_normalized_weight": F.when(p % 7 == 0, F.lit(2.0)).otherwise(F.col("max_normalized_weight")), "length_quantile": F.when(p % 11 == 0, F.lit("Q9")).when(p % 13 == 0, F.lit(None).cast("string")).otherwise(F.col("length_quantile"))})
    rolling = rolling.withColumns({"delta_error_old_minus_recent": F.when(t % 120 == 0, F.lit(9.0)).otherwise(F.col("delta_error_old_minus_recent")), "recent_behavior_step": F.when(t % 80 == 0, t).otherwise(F.col("recent_behavior_step"))})
    chosen = chosen.withColumns({"reliable": F.when(t == 100, ~F.col("reliable")).otherwise(F.col("reliable")), "decision": F.when(t == 200, F.lit("wait")).otherwise(F.col("decision"))})
    metrics = _metrics(fx).withColumns({"step": F.when(F.col("step") % 10 == 0, -F.col("step")).otherwise(F.col("step")), "truncation_rate": F.when(F.col("step") % 9 == 0, F.lit(1.5)).otherwise(F.lit(0.5)), "mode": F.when(F.col("step") % 8 == 0, F.lit("trial")).otherwise(F.lit("final"))})
    spoilt = {"training": invariants.training(metrics, "final"), "fixed": invariants.fixed_reuse(fixed), "overlap": invariants.overlap_rows(stats), "rolling": invariants.rolling(rolling), "decisions": invariants.decisions(chosen)}
    return tables.union_all([_counted(checks.all_of(sound), "sound"), *(_counted(b, name) for name, b in spoilt.items())])


@query
def online_check(fx: Fixture) -> DataFrame:
    """Faults planted in samples of a target: ids, indices, rewards, lengths and endings."""
    own = hashing.list_id(F.col("training_seed"), F.col("target_step"), F.col("prompt_id"), F.col("sample_index"))
    rows = fx.online.withColumn("id", F.col("prompt_id") * 100 + F.col("target_step") + F.col("sample_index"))
    i = F.col("id")
    rows = rows.withColumns({"online_id": F.when(i % 97 == 0, F.lit("x")).otherwise(own), "completion_length": F.when(i % 89 == 0, F.lit(0)).otherwise(i % 40 + 1), "terminated_with_eos": i % 3 == 0, "was_truncated": (i % 83 == 0) | (i % 40 == 39), "correct": F.when(i % 79 == 0, F.lit(0.5)).otherwise(F.col("correct"))})
    wrong = checks.online_rows(rows, own, 0, 7, 40)
    gaps = checks.completeness(rows, ["training_seed", "split", "target_step", "prompt_id"], 8).select(F.lit("incomplete").alias("rule"))
    return wrong.select("rule").unionByName(gaps).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query
def registry_check(fx: Fixture) -> DataFrame:
    """Faults planted in a split registry, and its counts beside those expected."""
    rows = registry.split_registry(_prompts(fx), 100, "split-v1")
    i = F.col("source_row_index")
    rows = rows.withColumns({"research_split": F.when((i % 50 == 0) & (F.col("original_split") == "test"), F.lit("training")).when((i % 50 == 1) & (F.col("original_split") == "train"), F.lit("test")).otherwise(F.col("research_split")), "split_assignment_hash": F.when(i % 60 == 0, F.lit("no hash")).otherwise(F.col("split_assignment_hash"))})
    wrong = checks.registry_rows(rows, 100, "split-v1").groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    counts = checks.counts_differ(rows, "original_split", {"train": 1, "validation": 2})
    return wrong.unionByName(counts.select(F.concat(F.lit("count_"), "value").alias("rule"), "n"))


@query
def lock_check(fx: Fixture) -> DataFrame:
    """Hashes of the nations against a lock in which one is changed, one was never locked and one is not there."""
    rows = fx.table("nation").select(F.col("n_name").alias("name"), F.sha2("n_name", 256).alias("sha256"), F.col("n_nationkey").alias("i"))
    lock = rows.where("i <> 3").withColumn("sha256", F.when(F.col("i") == 5, F.lit("0")).otherwise(F.col("sha256"))).select("name", "sha256")
    return checks.lock_breaks(lock, rows.where("i <> 7").select("name", "sha256"))


@query
def pair_prompt_check(fx: Fixture) -> DataFrame:
    """Pairs whose prompts differ from their reference's, after some prompts were taken from either side."""
    accuracy = overlap.online_prompt_accuracy(fx.online).where("not (target_step = 40 and prompt_id % 9 = 0)")
    return checks.pair_prompts(_stats(fx).where("not (target_step = 60 and prompt_id % 10 = 0)"), accuracy, PAIR)


@query
def side_check(fx: Fixture) -> DataFrame:
    """Comparisons of unequal sides, after prompts were taken from some recent logs and samples from others."""
    rows = fx.rescores.where("not (purpose = 'rolling' and target_step = 120 and prompt_id % 9 = 0)").where("not (purpose = 'rolling' and target_step = 140 and sample_index = 3)")
    return mechanism.unequal_sides(overlap.prompt_stats(rows))


@query
def rederivation_check(fx: Fixture) -> DataFrame:
    """Table rows whose overlap or number of prompts does not follow from the prompt statistics."""
    table = _results(fx).where("estimator = 'is'").withColumns({"n_prompts": F.when(F.col("target_step") == 40, F.col("n_prompts") + 1).otherwise(F.col("n_prompts")), "median_prompt_relative_ess": F.when(F.col("target_step") == 60, F.col("median_prompt_relative_ess") + 1e-6).otherwise(F.col("median_prompt_relative_ess")), "behavior_step": F.when(F.col("target_step") == 80, F.lit(7)).otherwise(F.col("behavior_step"))})
    return checks.rederived(_stats(fx), table, PAIR).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query
def identity_difference_check(fx: Fixture) -> DataFrame:
    own = F.col("purpose") == "identity"
    t = F.col("trajectory_id")
    rows = fx.rescores.withColumns({"identity_max_abs_token_logprob_diff": F.when(own & (t % 11 > 0), F.when(t % 13 == 0, F.lit(0.5)).otherwise(F.lit(0.0))), "identity_abs_sequence_logprob_diff": F.when(own | (t % 501 == 0), F.lit(0.0)), "identity_pass": F.when(own, t % 17 > 0)})
    return checks.identity_differences(rows).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query
def kept_pairs(fx: Fixture) -> DataFrame:
    pairs = _design(fx)
    kept = registry.keep_pairs(pairs, "test", [20260826, 20260828], [0, 100, 200, 300], [20, 120, 220, 300, 400], [(100, 160), (200, 260), (300, 360)])
    return registry.with_comparators(kept, pairs).select("split", "training_seed", "behavior_step", "target_step", "purpose")


@query
def selected_pairs(fx: Fixture) -> DataFrame:
    pairs = _design(fx).where("training_seed < 20260828").select("pair_id", "training_seed", "behavior_step", "target_step", "split")
    ids = pairs.where("target_step % 80 = 0").select("pair_id").unionByName(fx.table("region").select(F.col("r_name").alias("pair_id")))
    there, lost = registry.selection(pairs, ids)
    out = there.withColumn("pair_id", F.lit("-")).unionByName(lost.select("pair_id"), allowMissingColumns=True)
    return out.fillna(-1).fillna("-")


@query
def row_lookup(fx: Fixture) -> DataFrame:
    raw = fx.table("customer").where("c_custkey % 40 > 0").selectExpr("c_custkey as source_row_index", "case when c_custkey % 30 = 0 then upper(concat(c_name, 'x')) else c_name end as question")
    own = fx.table("customer").select(F.col("c_custkey").alias("source_row_index"), F.sha2("c_name", 256).alias("question_hash"))
    good, bad = checks.looked_up(own, raw, "source_row_index", "question_hash", F.sha2("question", 256))
    return good.select("source_row_index", F.lit(True).alias("found")).unionByName(bad.select("source_row_index", F.lit(False).alias("found")))


@query
def split_counters(fx: Fixture) -> DataFrame:
    return registry.split_counts(registry.split_registry(_prompts(fx), 100, "split-v1"), ["original_split", "research_split"])


@query
def latest_by_path(fx: Fixture) -> DataFrame:
    return registry.latest(fx.table("orders").selectExpr("o_custkey as path", "o_orderkey", "o_orderstatus as state"), ["path"], "o_orderkey")


@query
def batches(fx: Fixture) -> DataFrame:
    return registry.batched(fx.table("customer").select("c_nationkey", "c_custkey"), ["c_nationkey"], ["c_custkey"], 4).groupBy(F.col("c_nationkey").cast("bigint").alias("c_nationkey"), "batch").agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").cast("bigint").alias("first"))


@query
def first_prompts(fx: Fixture) -> DataFrame:
    return registry.first_prompts(_prompts(fx), 25, ["prompt_id"]).select("source_row_index", "prompt_id")


@query
def step_overlap(fx: Fixture) -> DataFrame:
    return rounded(report.step_overlap(tables.fixed_table(_results(fx))))


@query
def matched_refresh(fx: Fixture) -> DataFrame:
    return rounded(report.matched_refresh(tables.rolling_table(_results(fx))))


@query
def escaped(fx: Fixture) -> DataFrame:
    text = F.concat(F.col("n_name"), F.lit(" 10% of $5 & #1_{x}~^\\ "), F.col("n_nationkey").cast("string"))
    return fx.table("nation").select(F.col("n_nationkey").cast("bigint").alias("i"), report.latex_escape(text).alias("text"), report.macro_name(F.concat(F.lower("n_name"), F.lit("-tau.0"), F.col("n_nationkey").cast("string")), "Value").alias("macro"))


@query
def grid_verdicts(fx: Fixture) -> DataFrame:
    """Every candidate grid's worst distortion, score and verdict, and which is recommended under wide limits."""
    results = _results(fx).where("split = 'development' and estimator = 'prompt_wis'")
    fixed = tables.fixed_table(results).select("training_seed", "behavior_step", "target_step", F.lit("fixed").alias("purpose"), "absolute_error", F.lit(None).cast("double").alias("old_absolute_error"), F.col("median_prompt_relative_ess").alias("ress"))
    rolling = tables.rolling_table(results).select("training_seed", F.col("recent_behavior_step").alias("behavior_step"), "target_step", F.lit("rolling").alias("purpose"), F.col("recent_absolute_error").alias("absolute_error"), "old_absolute_error", F.col("recent_median_relative_ess").alias("ress"))
    candidates = studies.candidate_grids(fx.spark, 3, 30, 60)
    thresholds = fx.spark.createDataFrame([(0.02, 0.4, False), (0.05, 0.2, False)], "tolerance double, fitted_threshold double, reject_all boolean")
    metrics = studies.grid_candidates(fixed.unionByName(rolling), candidates, studies.seed_scopes(fx.spark, CALIBRATION, VALIDATION), thresholds)
    verdicts = studies.grid_verdicts(metrics, candidates, dict.fromkeys(studies.LIMITS, 0.25))
    best = studies.recommended_grid(verdicts).select("candidate_id", F.lit(True).alias("recommended"))
    out = verdicts.join(best, "candidate_id", "left").withColumn("recommended", F.coalesce("recommended", F.lit(False)))
    return rounded(out.select("candidate_id", "total_pairs", "worst_fixed_mean_mae", "worst_rolling_mean_error_reduction", "worst_gate_accept_rate", "distortion_score", "passed", "recommended"))


@query
def sample_plans(fx: Fixture) -> DataFrame:
    """Effect of fewer reference samples on references, fixed errors and rolling differences."""
    results = _results(fx).where("estimator = 'prompt_wis'")
    plans = fx.spark.createDataFrame([(2, 4), (4, 8), (8, 8), (8, 16)], "main_l int, audit_l int")
    out = studies.sample_plans(fx.online, tables.fixed_table(results), tables.rolling_table(results), plans, studies.seed_scopes(fx.spark, CALIBRATION, VALIDATION))
    return rounded(out)


@query
def gate_validation(fx: Fixture) -> DataFrame:
    """One gate's decisions on held-out seeds and on the test split, under the labels of a report."""
    chosen = _decisions(fx)
    role = lambda name: chosen.where(F.col("evaluation_role") == name)
    out = report.gate_validation({"Held-out seed": role("heldout_seed_validation"), "Official test": role("official_test")}, "primary_ress")
    return rounded(out.select("evaluation_role", "tolerance", "n_pair_seed_cases", "accept_rate", "false_accept_count", "overall_mae"))


@query
def error_series(fx: Fixture) -> DataFrame:
    """Absolute error of the fixed cases by target, as the points of a line for each seed."""
    rows = report.series(tables.fixed_table(_results(fx)), ["split", "training_seed", "estimator"], "target_step", "absolute_error")
    point = lambda p: F.concat_ws(":", p["x"].cast("bigint").cast("string"), F.round(p["y"] * 1e4).cast("bigint").cast("string"))
    return rows.select("split", "training_seed", "estimator", F.array_join(F.transform("points", point), " ").alias("points"))


@query
def scope_hash(fx: Fixture) -> DataFrame:
    """Each split's content hash stays as it is when rows of the other split are appended."""
    rows = fx.trajectories.select("prompt_id", "split", "sample_index", "event_id")
    hashes = lambda df, name: hashing.content_hash(df, df.columns, ["split"]).select("split", "n_rows", F.col("content_sha256").alias(name))
    more = rows.unionByName(rows.where("split = 'test' and sample_index < 3").withColumn("event_id", -F.col("event_id") - 1))
    both = hashes(rows, "before").join(hashes(more, "after").drop("n_rows"), "split")
    return both.select("split", "n_rows", (F.col("before") == F.col("after")).alias("unchanged"), "before")


@query
def column_subset(fx: Fixture) -> DataFrame:
    return tables.column_subset(fx.table("nation"), "n_name string, absent string, n_nationkey bigint").withColumn("absent", F.col("absent").isNull())
