"""Rules of the last two result tables, refused gaps and cases, white space of any kind, candidate grids by index."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from driftlog.functions import answers
from driftlog.operators import checks, gate, invariants, mechanism, studies
from driftlog.operators.rescoring import spaced_targets


def rules(df):
    return sorted(r.rule for r in df.collect())


def test_rules_of_calibration_tables(spark):
    row = lambda split="development", rate=0.5, est="prompt_wis": (split, "primary_ress", 0.02, rate, est)
    df = lambda *rows: spark.createDataFrame(list(rows), "split string, gate_kind string, tolerance double, accept_rate double, estimator string")
    assert rules(invariants.calibration(df(row(), row(rate=0.0), row(rate=1.0)))) == []
    assert rules(invariants.calibration(df(row("test"), row(rate=1.1), row(rate=-0.1), row(est="is")))) == ["accept_rate", "accept_rate", "estimator", "split"]
    assert rules(invariants.calibration(df(row("test")).drop("estimator"))) == ["split"]


def test_rules_of_robustness_tables(spark):
    df = lambda *rows: spark.createDataFrame(list(rows), "dataset string, training_seed long, behavior_step long, target_step long, estimator string, gate_accepted boolean, gate_reliable boolean, gate_false_accept boolean, gate_false_reject boolean")
    good = [("svamp", 1, 0, 20, "prompt_wis", a, r, a and not r, not a and r) for a in (True, False) for r in (True, False)] + [("SVAMP", 1, 0, 20, "is", None, None, None, None)]
    assert rules(invariants.robustness(df(*good), "SVAMP")) == []
    bad = [("gsm", 1, 0, 20, "is", None, None, None, None), ("svamp", 1, 0, 20, "other", None, None, None, None), ("svamp", 1, 0, 20, "prompt_wis", True, True, True, False), ("svamp", 1, 0, 20, "prompt_wis", False, True, False, False)]
    assert rules(invariants.robustness(df(*bad), "SVAMP")) == ["dataset", "estimator", "gate_false_accept", "gate_false_reject"]


def test_disjoint_names_what_both_have(spark):
    a, b = (spark.createDataFrame([(x,) for x in v], "k string") for v in (("x", "y", "y", None), ("y", "z", None)))
    assert sorted((r.k for r in checks.disjoint(a, b, "k").collect()), key=str) == [None, "y"]
    assert checks.disjoint(a, b.where("k = 'z'"), "k").count() == 0


def test_a_case_that_is_there_twice_is_refused(spark):
    fixed = spark.createDataFrame([("test", 1, 0, 20, "fixed", "prompt_wis", 0.1, 1.5, 0.2), ("test", 1, 0, 40, "fixed", "prompt_wis", 0.1, -0.5, 0.2)], "split string, training_seed long, behavior_step long, target_step long, purpose string, estimator string, absolute_error double, median_prompt_relative_ess double, tokenwise_kl_proxy double")
    rolling = spark.createDataFrame([("test", 1, 100, 120, "prompt_wis", 0.1, 0.5, 0.2)], "split string, training_seed long, recent_behavior_step long, target_step long, estimator string, recent_absolute_error double, recent_median_relative_ess double, recent_tokenwise_kl_proxy double")
    assert sorted(r.median_prompt_relative_ess for r in gate.gate_cases(fixed, rolling).collect()) == [0.0, 0.5, 1.0]
    with pytest.raises(Exception, match="there twice"):
        gate.gate_cases(fixed.union(fixed.limit(1)), rolling).collect()


def test_infinite_gaps_are_refused(spark):
    schema = "split string, training_seed long, behavior_step long, target_step long, purpose string, prompt_id long, K long, alpha double, d2 double, relative_ess double, log_sq_correct double, log_sq_incorrect double"
    # the recent side has no reward and the reference is 0, so its second moment is 0
    rows = [("t", 1, 0, 40, "fixed", 1, 2, 0.5, 0.1, 1.0, 0.0, 0.0), ("t", 1, 20, 40, "rolling", 1, 2, 0.0, 0.1, 1.0, None, 0.0)]
    reference = lambda v: spark.createDataFrame([("t", 1, 40, v)], "split string, training_seed long, target_step long, online_reference double")
    stats = spark.createDataFrame(rows, schema)
    assert mechanism.prompt_mechanism(stats, reference(0.3), enforce=True).count() == 1
    with pytest.raises(ValueError, match="infinite gaps"):
        mechanism.prompt_mechanism(stats, reference(0.0), enforce=True)


def test_white_space_around_numbers(spark):
    texts = ["\t5", " 5", "5\n", " \x1c5\x85 ", "5 6", "​5", "", " "]
    got = [r.n for r in spark.createDataFrame([(t,) for t in texts], "t string").select(answers.rational(F.col("t"))["top"].alias("n")).collect()]
    assert got == ["5" if t.strip() == "5" else None for t in texts]


def test_members_are_those_of_the_lists(spark):
    cases = [(p, b, e) for p in ("fixed", "rolling", "identity", None) for b in (0, 100) for e in (20, 40, 120, 160)]
    candidates = [("a", [20, 40, 20], [20, 60]), ("b", [160], [20, 20]), ("none", [], [])]
    got = studies.members(spark.createDataFrame(cases, "purpose string, behavior_step long, target_step long"), spark.createDataFrame(candidates, "candidate_id string, targets array<long>, lags array<long>"))
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    want = [(c, *x) for x in cases for c, t, lags in candidates if x[0] == "fixed" and x[2] in t or x[0] == "rolling" and x[2] - x[1] in lags]
    assert sorted((r.candidate_id, r.purpose, r.behavior_step, r.target_step) for r in got.collect()) == sorted(want)


def test_candidate_grids_are_numbered_by_pattern_and_size(spark):
    rows = studies.candidate_grids(spark, 3, 30, 80, 5).collect()
    want = []
    for name, lags in studies.LAG_PATTERNS.items():
        for n in range(1, 6):
            total = 3 * (len(studies.IDENTITY_STEPS) + n + len(studies.ROLLING_ANCHORS) * len(lags))
            if 30 <= total <= 80:
                want.append((f"C{len(want) + 1:03d}", name, total, list(spaced_targets(n)), list(lags)))
    assert sorted(tuple(r) for r in rows) == want
