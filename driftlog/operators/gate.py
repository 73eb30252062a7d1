"""The reuse-or-refresh gate: cases, thresholds without false accepts, decisions and summaries."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftlog.functions.numeric import next_down, next_up, ratio
from driftlog.operators.checks import assert_none, duplicates, seed_coverage

# Gate kind, its diagnostic and the direction of acceptance.
GATES = (("primary_ress", "median_prompt_relative_ess", "ge"), ("kl_baseline", "tokenwise_kl_proxy", "le"))
TOLERANCES = (0.01, 0.02, 0.05)
CASE = ["split", "training_seed", "behavior_step", "target_step", "purpose"]


def gate_cases(fixed: DataFrame, rolling: DataFrame, estimator: str = "prompt_wis") -> DataFrame:
    """Fixed cases and the recent side of rolling ones; the old side is among the fixed cases already. A case that is there twice is an error."""
    f = fixed.where(F.col("estimator") == estimator).select(*CASE, "absolute_error", "median_prompt_relative_ess", "tokenwise_kl_proxy")
    r = rolling.where(F.col("estimator") == estimator).select("split", "training_seed", F.col("recent_behavior_step").alias("behavior_step"), "target_step", F.lit("rolling").alias("purpose"), F.col("recent_absolute_error").alias("absolute_error"), F.col("recent_median_relative_ess").alias("median_prompt_relative_ess"), F.col("recent_tokenwise_kl_proxy").alias("tokenwise_kl_proxy"))
    out = f.unionByName(r)
    ress = F.greatest(F.lit(0.0), F.least(F.lit(1.0), "median_prompt_relative_ess"))
    # one row a case is what the gate is fitted on; a second one is an error, raised where the cases are read
    n = F.count(F.lit(1)).over(Window.partitionBy(*CASE))
    twice = F.raise_error(F.concat(F.lit("a gate case is there twice: "), F.to_json(F.struct(*CASE)))).cast("double")
    return out.withColumn("_n", n).withColumn("median_prompt_relative_ess", F.when(F.col("_n") > 1, twice).otherwise(ress)).drop("_n")


def by_gate(cases: DataFrame) -> DataFrame:
    """A row for every case and gate with the gate's diagnostic."""
    gates = F.array(*(F.struct(F.lit(k).alias("gate_kind"), F.lit(d).alias("diagnostic_name"), F.lit(o).alias("direction"), F.col(d).alias("diagnostic_value")) for k, d, o in GATES))
    return cases.select("*", F.inline(gates))


def with_tolerances(cases: DataFrame, tolerances: tuple[float, ...] = TOLERANCES) -> DataFrame:
    return cases.select("*", F.explode(F.array(*(F.lit(t) for t in tolerances))).alias("tolerance"))


def fit(cases: DataFrame, tolerances: tuple[float, ...] = TOLERANCES) -> DataFrame:
    """Thresholds of the widest acceptance without a false one, for each gate and tolerance.

    Closed form: a "ge" gate accepts from the least value above every unreliable one, and the
    double next above all values rejects everything; "le" mirrors it.
    """
    keys = ["gate_kind", "diagnostic_name", "direction", "tolerance"]
    rows = with_tolerances(by_gate(cases), tolerances)
    v, bad = F.col("diagnostic_value"), F.col("absolute_error") > F.col("tolerance")
    w = Window.partitionBy(*keys)
    rows = rows.withColumns({"_high": F.max(F.when(bad, v)).over(w), "_low": F.min(F.when(bad, v)).over(w)})
    ge = F.min(F.when(F.col("_high").isNull() | (v > F.col("_high")), v))
    le = F.max(F.when(F.col("_low").isNull() | (v < F.col("_low")), v))
    made = rows.groupBy(*keys).agg(ge.alias("_ge"), le.alias("_le"), F.max(v).alias("_max"), F.min(v).alias("_min"), F.count(F.lit(1)).alias("n_pairs"), (F.count_distinct(v) + 1).alias("threshold_candidate_count"))
    up = F.col("direction") == "ge"
    threshold = F.when(up, F.coalesce("_ge", next_up(F.col("_max")))).otherwise(F.coalesce("_le", next_down(F.col("_min"))))
    rejects = F.when(up, F.col("_ge").isNull()).otherwise(F.col("_le").isNull())
    return made.select(*keys, threshold.alias("fitted_threshold"), rejects.alias("reject_all"), "n_pairs", "threshold_candidate_count")


def evaluate(cases: DataFrame, thresholds: DataFrame, role: str) -> DataFrame:
    """Decisions of every gate and tolerance on every case. Thresholds: gates times tolerances, a handful of rows."""
    t = thresholds.select("gate_kind", "direction", "tolerance", "fitted_threshold", "reject_all")
    rows = by_gate(cases).join(F.broadcast(t), ["gate_kind", "direction"])
    accepted = F.when(F.col("direction") == "ge", F.col("diagnostic_value") >= F.col("fitted_threshold")).otherwise(F.col("diagnostic_value") <= F.col("fitted_threshold"))
    reliable = F.col("absolute_error") <= F.col("tolerance")
    rows = rows.withColumns({"evaluation_role": F.lit(role), "accepted": accepted, "reliable": reliable})
    return rows.withColumns({"decision": F.when(F.col("accepted"), F.lit("accept")).otherwise(F.lit("refresh")), "false_accept": F.col("accepted") & ~F.col("reliable"), "false_reject": ~F.col("accepted") & F.col("reliable")})


def _counts() -> list:
    n, acc, rel, fa, fr, err = F.count(F.lit(1)), F.count_if("accepted"), F.count_if("reliable"), F.count_if("false_accept"), F.count_if("false_reject"), F.col("absolute_error")
    return [
        n.alias("n_pairs"),
        acc.alias("accepted_count"),
        (n - acc).alias("rejected_count"),
        ratio(acc, n).alias("accept_rate"),
        rel.alias("reliable_count"),
        (n - rel).alias("unreliable_count"),
        fa.alias("false_accept_count"),
        ratio(fa, acc).alias("false_accept_rate_among_accepted"),
        ratio(fa, n).alias("false_accept_fraction_all"),
        fr.alias("false_reject_count"),
        ratio(fr, rel).alias("false_reject_rate_among_reliable"),
        F.avg(F.when(F.col("accepted"), err)).alias("accepted_mae"),
        F.avg(F.when(~F.col("accepted"), err)).alias("rejected_mae"),
        F.avg(err).alias("overall_mae"),
    ]


def summaries(decisions: DataFrame) -> DataFrame:
    """Summaries of all seeds together and of each, as grouping sets."""
    keys = ["split", "evaluation_role", "gate_kind", "diagnostic_name", "tolerance"]
    both = decisions.select("*", F.explode(F.array(F.lit("all"), F.col("training_seed").cast("string"))).alias("seed_scope"))
    return both.groupBy(*keys, "seed_scope").agg(*_counts())


def calibration_table(cases: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Fitted thresholds with the counts of their decisions on the calibration cases."""
    keys = ["gate_kind", "diagnostic_name", "direction", "tolerance"]
    counts = evaluate(cases, thresholds, "calibration").groupBy("split", *keys).agg(*_counts())
    return counts.drop("n_pairs", "false_reject_count", "false_reject_rate_among_reliable", "overall_mae").join(F.broadcast(thresholds), keys)


def monotonicity_breaks(thresholds: DataFrame, slack: float = 1e-15) -> DataFrame:
    """Gates whose threshold tightens as the tolerance grows; empty when all is well."""
    before = F.lag("fitted_threshold").over(Window.partitionBy("gate_kind").orderBy("tolerance"))
    rows = thresholds.withColumn("previous", before)
    bad = F.when(F.col("direction") == "ge", F.col("previous") + slack < F.col("fitted_threshold")).otherwise(F.col("previous") > F.col("fitted_threshold") + slack)
    return rows.where(bad).select("gate_kind", "tolerance", "previous", "fitted_threshold")


def fingerprint(thresholds: list[dict], policy: str) -> str:
    """Hash of what a gate decides by, whatever else its file says."""
    text = json.dumps({"policy": policy, "thresholds": thresholds}, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()


def frozen(thresholds: DataFrame, policy: str) -> str:
    """The gate as a JSON text with its fingerprint, the same for the same thresholds; sources.sinks.write_once keeps it."""
    rows = [r.asDict() for r in thresholds.orderBy("gate_kind", "tolerance").collect()]  # gates times tolerances
    return json.dumps({"policy": policy, "thresholds": rows, "content_sha256": fingerprint(rows, policy)}, sort_keys=True)


def thawed(spark: SparkSession, text: str, locked_sha256: str | None = None) -> DataFrame:
    """Thresholds of a frozen gate, if its content has the fingerprint it says and the one that is locked, if given."""
    gate = json.loads(text)
    rows, own = gate["thresholds"], fingerprint(gate["thresholds"], gate["policy"])
    if own != gate.get("content_sha256") or locked_sha256 not in (None, own):
        raise ValueError("the frozen gate is not what was frozen")
    return spark.createDataFrame([(r["gate_kind"], r["diagnostic_name"], r["direction"], float(r["tolerance"]), float(r["fitted_threshold"]), bool(r["reject_all"]), int(r["n_pairs"]), int(r["threshold_candidate_count"])) for r in rows], "gate_kind string, diagnostic_name string, direction string, tolerance double, fitted_threshold double, reject_all boolean, n_pairs bigint, threshold_candidate_count bigint")


def apply_frozen(cases: DataFrame, text: str, role: str, seeds: list[int], locked_sha256: str | None = None) -> DataFrame:
    """Decisions by a frozen gate, never fitted again, on cases of exactly the seeds given and each case once."""
    seed_coverage(cases, seeds)
    assert_none(duplicates(cases, CASE).select(F.lit("duplicate_case").alias("rule"), F.to_json(F.struct(*CASE)).alias("row")))
    return evaluate(cases, thawed(cases.sparkSession, text, locked_sha256), role)
