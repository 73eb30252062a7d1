"""Every query of the library over the fixtures of a data folder, as ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlog.functions import answers, arrays, coercion, hashing
from driftlog.functions.numeric import safe_exp, safe_exp_status
from driftlog.operators import bootstrap, checks, gate, mechanism, overlap, registry, report, rescoring, robustness, studies, tables
from driftlog.operators.overlap import PAIR
from driftlog.plans.fixtures import Fixture
from driftlog.sources import sinks
from driftlog.sources.scratch import Scratch

Query = Callable[[SparkSession, str], DataFrame]
CALIBRATION, VALIDATION = [20260826, 20260827], [20260828]
REPS, SIZE_REPS = 200, 50  # replicates of the portable bootstrap in queries
QUERIES: dict[str, Query] = {}


def query(f: Callable[[Fixture], DataFrame]) -> Callable[[Fixture], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Fixture(spark, sf_dir))
    return f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as sums in another order differ in their last bits; counts as bigint."""
    cast = {"double": lambda c: F.round(c, digits), "int": lambda c: F.col(c).cast("bigint")}
    return df.select(*(cast[t](c).alias(c) if t in cast else F.col(c) for c, t in df.dtypes))


def _stats(fx: Fixture) -> DataFrame:
    return overlap.prompt_stats(fx.rescores)


def _results(fx: Fixture) -> DataFrame:
    """Results of all pairs: a row a pair of the design and estimator, made once for a query, as several branches of it read them."""
    if "_results" not in fx.__dict__:  # as cached properties keep theirs
        with Scratch(fx.spark, "pair-results") as scratch:
            fx.__dict__["_results"] = scratch.result(tables.pair_results(fx.rescores, fx.online))
    return fx.__dict__["_results"]


def _cases(fx: Fixture) -> DataFrame:
    results = _results(fx)
    return gate.gate_cases(tables.fixed_table(results), tables.rolling_table(results))


def _calibration(fx: Fixture) -> DataFrame:
    return _cases(fx).where("split = 'development'").where(F.col("training_seed").isin(CALIBRATION))


def _decisions(fx: Fixture) -> DataFrame:
    cases = _cases(fx)
    dev = cases.where("split = 'development'")
    fitted = gate.fit(dev.where(F.col("training_seed").isin(CALIBRATION)))
    held = gate.evaluate(dev.where(F.col("training_seed").isin(VALIDATION)), fitted, "heldout_seed_validation")
    return held.unionByName(gate.evaluate(cases.where("split = 'test'"), fitted, "official_test"))


STATS = ["K", "ess", "relative_ess", "d2", "max_normalized_weight", "log_is", "pwis", "mean_log_weight", "sd_log_weight", "mean_abs_log_weight", "tokenwise_kl_proxy", "reward_rate", "mean_completion_length", "median_completion_length", "truncation_rate", "alpha"]


@query
def prompt_stats(fx: Fixture) -> DataFrame:
    return rounded(_stats(fx).select(*PAIR, "prompt_id", *STATS))


@query
def estimate_is(fx: Fixture) -> DataFrame:
    return rounded(overlap.estimates(_stats(fx)).where("estimator = 'is'"))


@query
def estimate_pwis(fx: Fixture) -> DataFrame:
    return rounded(overlap.estimates(_stats(fx)).where("estimator = 'prompt_wis'"))


@query
def global_wis(fx: Fixture) -> DataFrame:
    return rounded(overlap.global_wis(fx.rescores))


@query
def pair_diagnostics(fx: Fixture) -> DataFrame:
    return rounded(overlap.pair_diagnostics(_stats(fx)))


@query
def svamp_diagnostics(fx: Fixture) -> DataFrame:
    return rounded(overlap.prompt_mean_diagnostics(overlap.prompt_stats(fx.rescores, population_sd=True)))


@query
def length_quantile(fx: Fixture) -> DataFrame:
    return overlap.length_quantile(_stats(fx)).select(*PAIR, "prompt_id", "length_quantile")


@query
def online_reference(fx: Fixture) -> DataFrame:
    return rounded(overlap.online_reference(overlap.online_prompt_accuracy(fx.online)))


@query
def online_prompt_accuracy(fx: Fixture) -> DataFrame:
    return rounded(overlap.online_prompt_accuracy(fx.online, 4))


@query
def fixed_table(fx: Fixture) -> DataFrame:
    out = tables.fixed_table(_results(fx))
    return rounded(out.select(*PAIR, "estimator", "estimate", "estimate_status", "online_reference", "signed_error", "absolute_error", "n_prompts", "K", *tables.DIAGNOSTICS))


@query
def overlap_table(fx: Fixture) -> DataFrame:
    out = tables.overlap_table(fx.rescores)
    return rounded(out.select(*PAIR, "prompt_id", "relative_ess", "d2", "pair_abs_mean_log_ratio_per_token", "pair_tokenwise_kl_proxy", "length_quantile"))


ROLLING = ["split", "training_seed", "target_step", "estimator", "recent_behavior_step", "old_behavior_step", "online_reference", "old_estimate", "recent_estimate", "old_absolute_error", "recent_absolute_error", "delta_error_old_minus_recent", "delta_relative_ess_recent_minus_old", "old_mean_d2", "recent_mean_d2"]


@query
def rolling_table(fx: Fixture) -> DataFrame:
    return rounded(tables.rolling_table(_results(fx)).select(*ROLLING))


@query
def sample_size(fx: Fixture) -> DataFrame:
    return rounded(tables.sample_size_table(fx.rescores, fx.online, 16, reps=SIZE_REPS))


@query
def sample_size_summary(fx: Fixture) -> DataFrame:
    return rounded(report.sample_size_summary(tables.sample_size_table(fx.rescores, fx.online, 16, reps=SIZE_REPS)))


def _matched(fx: Fixture) -> DataFrame:
    return overlap.matched(_stats(fx), overlap.online_prompt_accuracy(fx.online))


@query
def bootstrap_ci(fx: Fixture) -> DataFrame:
    return rounded(bootstrap.intervals(bootstrap.portable(_matched(fx), REPS)), 9)


@query
def svamp_bootstrap(fx: Fixture) -> DataFrame:
    return rounded(bootstrap.intervals(bootstrap.portable(_matched(fx), REPS, paired=False)), 9)


@query
def bootstrap_seeded(fx: Fixture) -> DataFrame:
    return rounded(bootstrap.seeded(_matched(fx)))


@query
def gate_cases(fx: Fixture) -> DataFrame:
    return rounded(_cases(fx))


@query
def gate_fit(fx: Fixture) -> DataFrame:
    return rounded(gate.fit(_calibration(fx)))


@query
def gate_calibration(fx: Fixture) -> DataFrame:
    cases = _calibration(fx)
    return rounded(gate.calibration_table(cases, gate.fit(cases)))


@query
def gate_eval(fx: Fixture) -> DataFrame:
    return rounded(_decisions(fx).select("evaluation_role", *PAIR, "gate_kind", "tolerance", "diagnostic_value", "fitted_threshold", "decision", "accepted", "reliable", "false_accept", "false_reject"))


@query
def gate_summary(fx: Fixture) -> DataFrame:
    return rounded(gate.summaries(_decisions(fx)))


@query
def gate_monotonicity(fx: Fixture) -> DataFrame:
    fitted = gate.fit(_calibration(fx))
    return gate.monotonicity_breaks(fitted).agg(F.count(F.lit(1)).alias("n_breaks"))


@query
def gate_table(fx: Fixture) -> DataFrame:
    return rounded(report.gate_table(_decisions(fx)))


@query
def pair_templates(fx: Fixture) -> DataFrame:
    return rounded(robustness.pair_templates(_cases(fx), CALIBRATION))


@query
def registry_bands(fx: Fixture) -> DataFrame:
    return rounded(robustness.registry(robustness.pair_templates(_cases(fx), CALIBRATION), 8))


@query
def robustness_summary(fx: Fixture) -> DataFrame:
    bands = robustness.registry(robustness.pair_templates(_cases(fx), CALIBRATION), 8).select("behavior_step", "target_step", "purpose", "overlap_band")
    results = _results(fx).where("split = 'test'").join(F.broadcast(bands), ["behavior_step", "target_step", "purpose"])  # eight rows
    return rounded(robustness.band_summary(robustness.gated(results, _decisions(fx).where("evaluation_role = 'official_test'"))))


def _mechanism(fx: Fixture) -> DataFrame:
    return mechanism.prompt_mechanism(_stats(fx), overlap.online_reference(overlap.online_prompt_accuracy(fx.online)))


MECHANISM = ["old_alpha", "recent_alpha", "old_A_proxy", "recent_A_proxy", "old_log_kappa2", "recent_log_kappa2", "old_log_m2_proxy", "recent_log_m2_proxy", "delta_log_m2_proxy_recent_minus_old", "overlap_channel_favorable", "alpha_moves_favorable"]


@query
def alpha_prompt(fx: Fixture) -> DataFrame:
    return rounded(_mechanism(fx).select(*mechanism.KEY, "prompt_id", *MECHANISM))


@query
def alpha_pair(fx: Fixture) -> DataFrame:
    return rounded(mechanism.pair_mechanism(_mechanism(fx)))


@query
def alpha_split(fx: Fixture) -> DataFrame:
    return rounded(mechanism.split_mechanism(mechanism.pair_mechanism(_mechanism(fx))))


@query
def alpha_identity(fx: Fixture) -> DataFrame:
    return mechanism.identity_breaks(_mechanism(fx), 1e-9).agg(F.count(F.lit(1)).alias("n_breaks"))


@query
def estimator_table(fx: Fixture) -> DataFrame:
    with Scratch(fx.spark, "estimator-table") as scratch:
        stats, accuracy = scratch(overlap.prompt_stats(tables.fixed_table(fx.rescores)), "stats"), scratch(overlap.online_prompt_accuracy(fx.online), "accuracy")
        results = overlap.with_errors(overlap.pair_summary(stats), overlap.online_reference(accuracy))
        ci = bootstrap.intervals(bootstrap.portable(overlap.matched(stats, accuracy), REPS))
        return scratch.result(rounded(report.estimator_table(tables.fixed_table(results, ci))))


@query
def lag_table(fx: Fixture) -> DataFrame:
    return rounded(report.lag_table(tables.rolling_table(_results(fx))))


@query
def training_summary(fx: Fixture) -> DataFrame:
    return rounded(report.training_summary(_metrics(fx)), 4)


def _metrics(fx: Fixture) -> DataFrame:
    """Training metrics from orders: a seed is a remainder of the order's key, a step its rank's quarter."""
    return fx.table("orders").selectExpr("o_orderkey % 3 + 20260826 as training_seed", "cast(o_orderkey as bigint) as step", "o_totalprice / 1e5 as mean_reward", "cast(o_orderkey % 7 as double) / 7e0 as correctness_reward", "o_totalprice as gpu_memory_peak_bytes", "case when o_orderkey % 5 = 0 then null else cast(o_orderkey % 400 as double) end as tokens_per_second")


@query
def latest_metrics(fx: Fixture) -> DataFrame:
    rows = fx.table("orders").selectExpr("o_custkey % 3 as training_seed", "o_orderkey % 50 as step", "o_orderkey as record_index", "case when o_orderkey % 4 = 0 then null else o_totalprice end as mean_reward", "case when o_orderkey % 8 = 0 then null else 1e0 end as kl_proxy", "o_orderkey * 10 as num_tokens", "cast(o_orderkey % 50 as double) * 2e0 as elapsed_seconds", "case when o_orderkey % 3 = 0 then 5e0 end as tokens_per_second")
    return rounded(registry.latest_metrics(rows, ["mean_reward", "kl_proxy"]), 4)


@query
def heatmap(fx: Fixture) -> DataFrame:
    return rounded(report.heatmap(tables.overlap_table(fx.rescores)))


@query
def spearman(fx: Fixture) -> DataFrame:
    return rounded(report.diagnostic_benchmark(tables.fixed_table(_results(fx)).where("estimator = 'prompt_wis'")))


def _horizon(fx: Fixture, prefix: bool) -> DataFrame:
    out = report.reuse_horizon(tables.fixed_table(_results(fx)), prefix=prefix)
    return rounded(out.withColumns({c: F.col(c).cast("double") for c in ("last_reliable_target_step", "horizon_steps")}))


@query
def horizon(fx: Fixture) -> DataFrame:
    return _horizon(fx, False)


@query
def horizon_prefix(fx: Fixture) -> DataFrame:
    return _horizon(fx, True)


@query
def mc_inclusion(fx: Fixture) -> DataFrame:
    with Scratch(fx.spark, "mc-inclusion") as scratch:
        accuracy = scratch(overlap.online_prompt_accuracy(fx.online), "accuracy")
        matched = scratch(overlap.matched(overlap.prompt_stats(tables.fixed_table(fx.rescores)), accuracy), "matched")
        results = overlap.with_errors(overlap.estimates(matched), overlap.online_reference(accuracy))
        return scratch.result(rounded(report.reference_inclusion(tables.fixed_table(results, bootstrap.intervals(bootstrap.portable(matched, REPS))))))


@query
def pooled_error(fx: Fixture) -> DataFrame:
    return rounded(report.pooled(tables.fixed_table(_results(fx)), "target_step", "absolute_error", ["split", "estimator"]))


@query
def paper_values(fx: Fixture) -> DataFrame:
    table = report.estimator_table(tables.fixed_table(_results(fx)))
    out = report.key_values(table, F.concat_ws(".", "split", "estimator"), ["mean_absolute_error", "rmse"])
    return out.select("key", report.formatted(F.round("value", 8), 4).alias("value"))


def _prompts(fx: Fixture) -> DataFrame:
    return fx.table("customer").selectExpr("c_custkey as source_row_index", "c_name as question", "case when c_nationkey % 4 = 0 then 'test' else 'train' end as original_split").withColumn("prompt_id", hashing.record_id(question=F.col("question"), source_row_index=F.col("source_row_index")))


@query
def prompt_id(fx: Fixture) -> DataFrame:
    return _prompts(fx).select("source_row_index", "prompt_id")


@query
def split_registry(fx: Fixture) -> DataFrame:
    return registry.split_registry(_prompts(fx), 100, "split-v1").select("source_row_index", "original_split", "research_split", "split_assignment_hash")


@query
def duplicate_questions(fx: Fixture) -> DataFrame:
    return registry.duplicate_extras(fx.table("part"), "p_name")


def _answers(fx: Fixture) -> DataFrame:
    forms = "case o_orderkey % 9 when 0 then concat('<answer>', cast(o_custkey as string), '</answer>') when 1 then concat('<ANSWER> 1,', lpad(cast(o_custkey % 1000 as string), 3, '0'), '/2 </ANSWER>') when 2 then '<answer>x</answer>' when 3 then '<answer>1</answer><answer>2</answer>' when 4 then 'none' when 5 then '<answer>1.5/2</answer>' when 6 then '<answer>3/0</answer>' when 7 then concat('<answer>$-', cast(o_custkey as string), '.50</answer>') else '<answer>7' end"
    return fx.table("orders").selectExpr("o_orderkey", "o_custkey", f"{forms} as completion")


@query
def answer_parse(fx: Fixture) -> DataFrame:
    value = answers.parsed(F.col("completion"))
    return _answers(fx).select("o_orderkey", answers.status(F.col("completion")).alias("status"), answers.status(F.col("completion"), True).alias("strict_status"), value["num"].cast("double").alias("num"), value["den"].cast("double").alias("den"))


@query
def answer_canonical(fx: Fixture) -> DataFrame:
    rows = _answers(fx).select("o_orderkey", answers.parsed(F.col("completion")).alias("value"))
    return answers.canonical_answers(rows, "value", "answer").select("o_orderkey", "answer")


@query
def rewards(fx: Fixture) -> DataFrame:
    text, truth = F.col("completion"), answers.rational(F.concat(F.col("o_custkey").cast("string"), F.lit(".0")))
    return _answers(fx).select("o_orderkey", answers.correctness_reward(text, truth).alias("correctness"), answers.format_reward(text).alias("format"))


def _tokens(fx: Fixture) -> DataFrame:
    return fx.table("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_partkey", "l_suppkey", "l_extendedprice"))).alias("t"))


@query
def seq_logprob(fx: Fixture) -> DataFrame:
    rows = _tokens(fx).withColumn("lp", F.transform("t", lambda x: -x["l_extendedprice"] / F.lit(1e5)))
    return rounded(rows.select("l_orderkey", F.size("lp").alias("n_tokens"), arrays.total(F.col("lp")).alias("sequence_logprob")), 8)


@query
def first_eos(fx: Fixture) -> DataFrame:
    rows = _tokens(fx).withColumn("ids", F.transform("t", lambda x: x["l_suppkey"] % 7))
    return rows.select("l_orderkey", arrays.cut_length(F.col("ids"), [0, 3], 5).cast("double").alias("cut"))


@query
def logp_compare(fx: Fixture) -> DataFrame:
    rows = _tokens(fx).select("l_orderkey", F.transform("t", lambda x: (x["l_partkey"] % 11).cast("double") / 7).alias("a"), F.transform("t", lambda x: (x["l_partkey"] % 11).cast("double") / 7 + F.when(x["l_suppkey"] % 5 == 0, F.lit(0.25)).otherwise(F.lit(0.0))).alias("b"))
    d = arrays.differences(F.col("a"), F.col("b"))
    return rounded(rows.select("l_orderkey", F.array_max(d).alias("max_diff"), (arrays.total(d) / F.size(d)).alias("mean_diff"), arrays.first_mismatch(F.col("a"), F.col("b")).cast("double").alias("first_mismatch")))


@query
def shards(fx: Fixture) -> DataFrame:
    prompts = fx.trajectories.select("split", "prompt_id").distinct()
    return registry.sample_shards(prompts, ["split"], 20, 8, 25)


@query
def completeness(fx: Fixture) -> DataFrame:
    return rounded(checks.completeness(fx.trajectories, ["prompt_id"], 50))


@query
def missing_units(fx: Fixture) -> DataFrame:
    wanted = fx.pairs.select("training_seed", "behavior_step", "target_step")
    return registry.missing_units(wanted, fx.rescores.where("target_step % 40 = 0"), ["training_seed", "behavior_step", "target_step"])


@query
def scope_replace(fx: Fixture) -> DataFrame:
    old = fx.trajectories.groupBy("split", "prompt_id").agg(F.count(F.lit(1)).alias("n"))
    new = old.where("split = 'test' and n > 50").withColumn("n", -F.col("n"))
    return sinks.replaced(old, new, F.col("split") == "test")


@query
def content_hash_rows(fx: Fixture) -> DataFrame:
    return hashing.content_hash(fx.pairs, fx.pairs.columns, ["purpose"])


@query
def grid_candidates(fx: Fixture) -> DataFrame:
    spark, results = fx.spark, _results(fx).where("split = 'development'")
    fixed = tables.fixed_table(results).where("estimator = 'prompt_wis'").select("training_seed", "behavior_step", "target_step", F.lit("fixed").alias("purpose"), "absolute_error", F.lit(None).cast("double").alias("old_absolute_error"), F.col("median_prompt_relative_ess").alias("ress"))
    rolling = tables.rolling_table(results).where("estimator = 'prompt_wis'").select("training_seed", F.col("recent_behavior_step").alias("behavior_step"), "target_step", F.lit("rolling").alias("purpose"), F.col("recent_absolute_error").alias("absolute_error"), "old_absolute_error", F.col("recent_median_relative_ess").alias("ress"))
    candidates = spark.createDataFrame([("C1", [100, 200, 300, 400], [20, 100]), ("C2", [200, 400], [40]), ("C3", [20, 40], [20, 40, 60])], "candidate_id string, targets array<bigint>, lags array<bigint>")
    thresholds = spark.createDataFrame([(0.02, 0.4, False), (0.05, 0.2, False)], "tolerance double, fitted_threshold double, reject_all boolean")
    scopes = studies.seed_scopes(spark, CALIBRATION, VALIDATION)
    out = studies.grid_candidates(fixed.unionByName(rolling), candidates, scopes, thresholds)
    return rounded(out.select("candidate_id", "scope", "tolerance", "n_fixed", "n_rolling", "fixed_mean_mae", "rolling_mean_error_reduction", "gate_accept_rate", "absdiff_fixed_mean_mae", "absdiff_gate_accept_rate"))


@query
def ref_sample_size(fx: Fixture) -> DataFrame:
    return rounded(studies.reference_sizes(fx.online, _results(fx), [2, 4, 8]))


@query
def common_prefix(fx: Fixture) -> DataFrame:
    return studies.common_prefix(fx.online, ["split", "training_seed", "target_step"])


def _subsets(fx: Fixture) -> DataFrame:
    rows = fx.rescores.where("purpose = 'fixed'")
    matched = overlap.matched(overlap.prompt_stats(rows), overlap.online_prompt_accuracy(fx.online)).withColumn("source", F.col("prompt_id") % 20)
    thresholds = fx.spark.createDataFrame([(0.02, 0.4, False), (0.05, 0.2, False)], "tolerance double, fitted_threshold double, reject_all boolean")
    return studies.prompt_subsets(matched, thresholds, [0.25, 0.5], 50, "source", "subset-v1")


@query
def subset_benchmark(fx: Fixture) -> DataFrame:
    return rounded(_subsets(fx))


@query
def subset_recommendation(fx: Fixture) -> DataFrame:
    return studies.first_passing(_subsets(fx), 0.5, 0.5, 0.5, 0.5)


@query
def identity_check(fx: Fixture) -> DataFrame:
    bad = checks.all_of([checks.identity_rows(fx.rescores), checks.rescore_rows(fx.rescores)])
    shifted = fx.rescores.where("trajectory_id % 101 = 0").withColumn("log_weight", F.col("log_weight") + 1)
    return bad.unionByName(checks.identity_rows(shifted)).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query
def statistics_check(fx: Fixture) -> DataFrame:
    return checks.statistics_in_range(_stats(fx), [*PAIR, "prompt_id"]).agg(F.count(F.lit(1)).alias("n_breaks"))


@query
def prompt_set_check(fx: Fixture) -> DataFrame:
    return checks.prompt_sets(fx.trajectories.where("sample_index < 16"), fx.trajectories.where("sample_index >= 45"), ["prompt_id"])


@query
def conflict_check(fx: Fixture) -> DataFrame:
    return rounded(checks.conflicts(fx.table("events"), ["user_id"], "event_type"))


@query
def grid_gap_check(fx: Fixture) -> DataFrame:
    grid = fx.seeds.crossJoin(fx.steps).select("training_seed", F.col("step").alias("target_step"))  # the design
    return checks.grid_gaps(fx.pairs.where("purpose = 'fixed'"), grid, ["training_seed", "target_step"])


@query
def reference_check(fx: Fixture) -> DataFrame:
    accuracy = overlap.online_prompt_accuracy(fx.online)
    return checks.references(accuracy, overlap.online_reference(accuracy), 8).agg(F.count(F.lit(1)).alias("n_breaks"))


def _design(fx: Fixture) -> DataFrame:
    """The registry of pairs for the seeds and splits that the tables have."""
    seeds, splits = ([r[0] for r in df.distinct().sort(df.columns[0]).collect()] for df in (fx.seeds.select("training_seed"), fx.trajectories.select("split")))
    return registry.pair_registry(fx.spark, seeds, tuple(splits))


@query
def pair_registry(fx: Fixture) -> DataFrame:
    return _design(fx)


@query
def next_pair(fx: Fixture) -> DataFrame:
    """Units are the shards of a split's prompts; later pairs lack the units of every fifth shard."""
    pairs = _design(fx)
    shards = registry.sample_shards(fx.trajectories.select("split", "prompt_id").distinct(), ["split"], 16, 8, 10).select("split", "shard", "start")
    source = pairs.select("pair_id", "split", "behavior_step").join(shards, "split")
    return registry.next_pair(pairs, source, source.where("shard % 5 > 0 or behavior_step < 200"))


@query
def representable(fx: Fixture) -> DataFrame:
    """Estimates at the ends of what a double holds."""
    z = F.col("z")
    rows = fx.table("nation").selectExpr("cast(n_nationkey as bigint) as i", "case when n_nationkey = 0 then null else (n_nationkey - 12) * 75e0 end as z")
    return rounded(rows.select("i", safe_exp_status(z).alias("status"), F.when(safe_exp(z) < 1e3, safe_exp(z)).alias("value")))


def _scored(fx: Fixture) -> DataFrame:
    """Rescores as target log-probabilities: the trajectory's own less its length, plus the weight."""
    return fx.rescores.withColumn("target_sequence_logprob", -F.col("completion_length").cast("double") + F.col("log_weight"))


@query
def canonical_denominator(fx: Fixture) -> DataFrame:
    out = rescoring.canonical_weights(_scored(fx).drop("log_weight"))
    return rounded(out.where("purpose <> 'identity'").select("training_seed", "trajectory_id", "behavior_step", "target_step", "log_weight", "mean_log_ratio_per_token"), 9)


@query
def rescore_summary(fx: Fixture) -> DataFrame:
    bridge = F.col("log_weight") / F.col("completion_length")
    return rounded(rescoring.rescore_summary(fx.rescores, PAIR, bridge, 0.01))


@query
def source_join(fx: Fixture) -> DataFrame:
    rows = fx.rescores.select("training_seed", "behavior_step", "target_step", "trajectory_id", "log_weight")
    source = fx.trajectories.withColumnRenamed("event_id", "trajectory_id")
    return rounded(rescoring.with_source(rows, source, ["prompt_id", "sample_index"]))


@query
def source_coverage(fx: Fixture) -> DataFrame:
    rows = fx.rescores.where("trajectory_id % 50 <> 0").select("trajectory_id")  # planted gaps
    return checks.covered(rows, fx.trajectories.where("sample_index < 16").select(F.col("event_id").alias("trajectory_id")), "trajectory_id")


@query
def parser_counts(fx: Fixture) -> DataFrame:
    rows = _answers(fx).withColumns({"correctness_reward": (F.col("o_orderkey") % 2).cast("double"), "was_truncated": F.col("o_orderkey") % 5 == 0, "k": F.col("o_custkey") % 3})
    out = rescoring.status_counts(rows, ["k"], answers.status(F.col("completion")))
    return rounded(out.select("k", F.col("status_counts")["ok"].alias("n_ok"), F.col("status_counts")["missing_answer_tag"].alias("n_missing"), "n_rows", "n_truncated", "mean_reward"))


@query
def sample_limit(fx: Fixture) -> DataFrame:
    step = F.col("step")
    return rounded(fx.steps.select("step", rescoring.sample_limit(step, [100, 200, 300, 400], 8, 32).alias("n_samples")))


@query
def generation_call(fx: Fixture) -> DataFrame:
    rows = fx.trajectories.where("sample_index < 16").withColumn("generation_call_id", F.concat(F.lit("c"), (F.col("event_id") % 40).cast("string")))
    return rescoring.generation_call(rows, ["split"], 2).select("split", "generation_call_id", "prompt_id", "sample_index")


@query
def mixed_fields(fx: Fixture) -> DataFrame:
    return rescoring.mixed_fields(fx.table("customer"), ["c_nationkey"], ["c_mktsegment"]).select(F.col("c_nationkey").cast("bigint").alias("c_nationkey"), "field", "n_values")


@query
def formal_failures(fx: Fixture) -> DataFrame:
    rows = fx.rescores.where("purpose = 'identity'").withColumns({"identity_max_abs_token_logprob_diff": F.when(F.col("trajectory_id") % 11 == 0, F.lit(0.5)).when(F.col("trajectory_id") % 7 > 0, F.lit(0.0)), "identity_abs_sequence_logprob_diff": F.lit(0.0), "identity_pass": F.col("trajectory_id") % 22 > 0})
    failed, wrong = rescoring.formal_failures(rows, 1e-3, 1e-3)
    keys = ["training_seed", "target_step", "trajectory_id"]
    return failed.select(*keys, F.lit("failed").alias("kind")).unionByName(wrong.select(*keys, F.lit("wrong_flag").alias("kind")))


@query
def identity_gate(fx: Fixture) -> DataFrame:
    grid = fx.seeds.crossJoin(fx.steps.where("step in (0, 100, 200, 300)")).select("training_seed", F.col("step").alias("anchor"))  # the design
    return rescoring.identity_gate_gaps(fx.pairs.withColumn("passed", F.col("behavior_step") != 200), grid)


@query
def shard_index(fx: Fixture) -> DataFrame:
    shards = fx.table("nation").selectExpr("cast(n_regionkey as bigint) as k", "n_name as unit", "cast(n_nationkey as bigint) as row_count").withColumn("sha256", F.sha2("unit", 256))
    return rescoring.shard_index(shards, ["k"])


@query
def coerced(fx: Fixture) -> DataFrame:
    text = F.when(F.col("n_nationkey") % 5 == 0, F.lit(" Yes ")).when(F.col("n_nationkey") % 5 == 1, F.lit("0")).when(F.col("n_nationkey") % 5 == 2, F.lit("")).when(F.col("n_nationkey") % 5 == 3, F.lit("1.50")).otherwise(F.lit("maybe"))
    rows = fx.table("nation").select(F.col("n_nationkey").cast("bigint").alias("i"), text.alias("t"))
    t = F.col("t")
    return rows.select("i", coercion.as_bool(t).cast("string").alias("flag"), coercion.bad_bool(t).alias("bad_flag"), coercion.as_number(t).alias("number"), coercion.bad_number(t).alias("bad_number"))


@query
def first_metric(fx: Fixture) -> DataFrame:
    i = F.col("n_nationkey")
    some = F.map_filter(F.create_map(F.lit("reward"), F.when(i % 2 == 0, i.cast("double")), F.lit("mean_reward"), i.cast("double") * 10), lambda k, v: (k != "reward") | (i % 3 > 0))
    return fx.table("nation").select(i.cast("bigint").alias("i"), coercion.first_alias(some, ["reward", "mean_reward"]).alias("value"))


@query
def json_values(fx: Fixture) -> DataFrame:
    props = F.concat(F.lit('{"a":'), F.col("props"), F.lit(',"z":null}'))
    message = F.concat(F.lit('[{"content":"k"},{"role":"x"},{"content":'), F.to_json(F.array(F.col("event_type"))).substr(F.lit(2), F.length(F.to_json(F.array(F.col("event_type")))) - 2), F.lit("}]"))
    return fx.table("events").select("event_id", coercion.first_path(props, ["$.z", "$.b", "$.a.k"]).alias("k"), coercion.completion_text(message).alias("text"))
