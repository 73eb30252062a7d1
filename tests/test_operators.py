"""Operators on small inputs with known answers, and against plain Python."""

from __future__ import annotations

import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftlog.functions import answers, arrays, hashing
from driftlog.functions.numeric import is_close, log_sum_exp, log_sums, mean_exp, next_down, next_up, safe_exp, safe_exp_status
from driftlog.operators import bootstrap, checks, gate, mechanism, overlap, registry, report, robustness, studies
from driftlog.operators.overlap import estimates, global_wis, pair_summary, prompt_stats

# Two logs of two prompts: (log weight, reward) of four samples each.
OLD = {"p1": [(0, 1), (-1, 0), (-2, 0), (-3, 0)], "p2": [(0.2, 0), (0, 1), (-0.2, 0), (-0.4, 1)]}
RECENT = {"p1": [(0, 1), (0, 0), (0, 0), (0, 0)], "p2": [(0, 0), (0, 1), (0, 0), (0, 1)]}


def _rows(spark, logs):
    out = []
    for (b, purpose), log in logs.items():
        for p, samples in log.items():
            out += [("test", 1, b, 120, purpose, p, i, float(z), float(r), 10 + i, i == 3, f"{b}-{p}-{i}") for i, (z, r) in enumerate(samples)]
    return spark.createDataFrame(out, "split string, training_seed bigint, behavior_step bigint, target_step bigint, purpose string, prompt_id string, sample_index bigint, log_weight double, correctness_reward double, completion_length bigint, was_truncated boolean, trajectory_id string")


@pytest.fixture(scope="module")
def golden(spark):
    return _rows(spark, {(0, "fixed"): OLD, (100, "rolling"): RECENT})


def test_prompt_stats_golden(golden):
    got = {(r.behavior_step, r.prompt_id): r for r in overlap.prompt_stats(golden).collect()}
    a, b = got[0, "p1"], got[100, "p1"]
    w = [math.exp(-i) for i in range(4)]
    assert a.ess == pytest.approx(sum(w) ** 2 / sum(x * x for x in w), abs=1e-12)  # 2.0861107728; the fixture notes had a digit wrong
    assert a.d2 == pytest.approx(-1.2412164222, abs=1e-9)
    assert a.pwis == pytest.approx(0.6439142599, abs=1e-9) == a.max_normalized_weight
    assert b.alpha == pytest.approx(0.25) and b.relative_ess == pytest.approx(1.0)


def test_stats_hold_far_from_zero_and_without_reward(spark):
    rows = _rows(spark, {(0, "fixed"): {"p": [(900.0, 0), (-900.0, 1)], "q": [(-900.0, 0), (-901.0, 0)]}})
    got = {r.prompt_id: r for r in overlap.prompt_stats(rows).collect()}
    assert got["p"].log_is == pytest.approx(-900 - math.log(2)) and got["p"].pwis == 0.0
    assert got["q"].log_is is None and got["q"].pwis == 0.0 and got["q"].ess == pytest.approx((1 + math.e**-1) ** 2 / (1 + math.e**-2))
    est = {r.estimator: r for r in overlap.estimates(overlap.prompt_stats(rows)).collect()}
    assert est["is"].estimate == 0.0 and est["is"].estimate_status == "ok_underflow_to_zero"
    high = _rows(spark, {(0, "fixed"): {"p": [(900.0, 1), (0.0, 0)]}})
    est = {r.estimator: r for r in overlap.estimates(overlap.prompt_stats(high)).collect()}
    assert est["is"].estimate is None and est["is"].estimate_status == "nonfinite_estimator"


def test_global_wis_plain(golden):
    got = {r.behavior_step: r.global_wis for r in overlap.global_wis(golden).collect()}
    z = [x for s in OLD.values() for x in s]
    assert got[0] == pytest.approx(sum(math.exp(a) for a, r in z if r) / sum(math.exp(a) for a, _ in z))


def test_safe_exp_edges(spark):
    row = spark.range(1).select(*(safe_exp(F.lit(x).cast("double")).alias(f"v{i}") for i, x in enumerate((None, float("nan"), 710.0, -745.0, 0.0))), *(safe_exp_status(F.lit(x).cast("double")).alias(f"s{i}") for i, x in enumerate((None, float("nan"), 710.0, -745.0, 0.0)))).first()
    assert [row[f"v{i}"] for i in range(5)] == [0.0, None, None, 0.0, 1.0]
    assert [row[f"s{i}"] for i in range(5)] == ["ok", "nonfinite_estimator", "nonfinite_estimator", "ok_underflow_to_zero", "ok"]


def test_log_sum_exp_at_any_height(spark):
    inf, nan = float("inf"), float("nan")
    groups = {"a": [0.0, 1.0, -2.0], "b": [8000.0, 7999.0], "c": [-6900.0, -9901.0, None], "d": [None, -inf], "e": [-800.0, 709.5, 709.4], "f": [1950.0] * 50 + [0.0], "g": [1e300, -1e300, 5.0], "h": [inf, 1.0], "i": [nan, 1.0, inf], "j": [499.9, 500.0, -0.1], "k": [1e16, 1e16 + 2]}
    rows = spark.createDataFrame([(k, z) for k, v in groups.items() for z in v], "k string, z double")
    one = {r.k: r for r in rows.groupBy("k").agg(log_sum_exp(F.col("z")).alias("s"), mean_exp(F.col("z")).alias("m")).collect()}
    two = {r.k: r for r in log_sums(rows, ["k"], F.col("z"), {"s": F.lit(True), "up": F.col("z") > 0}).collect()}
    for k, v in groups.items():
        z = [x for x in v if x is not None and x != -inf]
        if any(math.isnan(x) or x == inf for x in z):
            assert not math.isfinite(one[k].s) and not math.isfinite(two[k].s)
            continue
        want = max(z) + math.log(sum(math.exp(x - max(z)) for x in z)) if z else None
        assert one[k].s == (pytest.approx(want, rel=1e-14) if z else None) == two[k].s
        assert one[k].m == (pytest.approx(want - math.log(len(v)), rel=1e-12) if z else None)
        up = [x for x in z if x > 0]
        assert two[k].n == len(v) and two[k].up == (pytest.approx(max(up) + math.log(sum(math.exp(x - max(up)) for x in up)), rel=1e-14) if up else None)


def test_estimates_over_weights_that_no_double_holds(spark):
    inf, nan = float("inf"), float("nan")
    cases = {0: [8000.0, 7999.0], 1: [nan, 0.0], 2: [inf, 0.0], 3: [-inf, 0.0], 4: [-8000.0, -8000.0], 5: [900.0, -900.0], 6: [0.0, 0.0]}
    rows = [("t", 1, 0, b, "fixed", p, z, 1.0 if i == 0 else 0.0, 5, False) for b, zs in cases.items() for p in (1, 2) for i, z in enumerate(zs)]
    frame = spark.createDataFrame(rows, "split string, training_seed bigint, behavior_step bigint, target_step bigint, purpose string, prompt_id bigint, log_weight double, correctness_reward double, completion_length bigint, was_truncated boolean")
    stats = prompt_stats(frame)
    for made in (estimates(stats), pair_summary(stats)):
        got = {(r.target_step, r.estimator): (r.estimate, r.estimate_status) for r in made.collect()}
        bad, e = (None, "nonfinite_estimator"), math.exp(-1)
        assert got[0, "is"] == got[5, "is"] == bad and got[4, "is"] == (0.0, "ok_underflow_to_zero") and got[3, "is"] == (0.0, "ok") and got[6, "is"] == (0.5, "ok")
        assert all(got[c, k] == bad for c in (1, 2) for k in ("is", "prompt_wis"))
        assert got[0, "prompt_wis"] == (pytest.approx(1 / (1 + e)), "ok") and got[4, "prompt_wis"] == (0.5, "ok") and got[5, "prompt_wis"] == (1.0, "ok")
    wis = {r.target_step: r.global_wis for r in global_wis(frame).collect()}
    assert wis == {0: pytest.approx(1 / (1 + e)), 1: None, 2: None, 3: 0.0, 4: pytest.approx(0.5), 5: 1.0, 6: pytest.approx(0.5)}


def test_next_double(spark):
    for x in (0.1, 1.0, -2.5, 0.12239330421733255):
        r = spark.range(1).select(next_up(F.lit(x)).alias("u"), next_down(F.lit(x)).alias("d"), is_close(F.lit(x), F.lit(x + 1e-12), atol=1e-9).alias("c")).first()
        assert (r.u, r.d, r.c) == (math.nextafter(x, math.inf), math.nextafter(x, -math.inf), True)


def test_length_quarter_is_not_ntile(spark):
    rows = spark.createDataFrame([("a", i, float(i)) for i in range(6)], "split string, prompt_id int, mean_completion_length double")
    got = [r.length_quantile for r in overlap.length_quantile(rows, ["split"]).orderBy("prompt_id").collect()]
    assert got == ["Q1_short", "Q1_short", "Q2", "Q3", "Q3", "Q4_long"]


def _exhaustive(values, errors, tolerance, direction):
    candidates = sorted(set(values))
    candidates += [math.nextafter(candidates[-1], math.inf)] if direction == "ge" else [math.nextafter(candidates[0], -math.inf)]
    best = None
    for t in candidates:
        acc = [v >= t if direction == "ge" else v <= t for v in values]
        if any(a and e > tolerance for a, e in zip(acc, errors)):
            continue
        key = (sum(acc), -t if direction == "ge" else t)
        if best is None or key > best[0]:
            best = (key, t, sum(acc) == 0)
    return best[1:]


def test_gate_fit_is_exhaustive_search(spark):
    rng, rows = random.Random(4), []
    for split in range(40):
        rows += [(f"s{split}", 1, i, 0, "fixed", rng.choice([0.001, 0.015, 0.03, 0.1]), rng.choice([0.1, 0.2, 0.3, rng.random()]), rng.choice([0.0, 0.1, rng.random()])) for i in range(rng.randint(1, 9))]
    schema = "split string, training_seed bigint, behavior_step bigint, target_step bigint, purpose string, absolute_error double, median_prompt_relative_ess double, tokenwise_kl_proxy double"
    for split in sorted({r[0] for r in rows})[:12]:
        mine = [r for r in rows if r[0] == split]
        for f in gate.fit(spark.createDataFrame(mine, schema)).collect():
            column = 6 if f.direction == "ge" else 7
            want = _exhaustive([r[column] for r in mine], [r[5] for r in mine], f.tolerance, f.direction)
            assert (f.fitted_threshold, f.reject_all) == want


def test_frozen_gate_round_trip(spark):
    cases = spark.createDataFrame([("d", 1, 0, 20, "fixed", 0.005, 0.4, 0.1), ("d", 1, 0, 40, "fixed", 0.03, 0.2, 0.3)], "split string, training_seed bigint, behavior_step bigint, target_step bigint, purpose string, absolute_error double, median_prompt_relative_ess double, tokenwise_kl_proxy double")
    fitted = gate.fit(cases)
    text = gate.frozen(fitted, "zero_false_accept")
    assert gate.frozen(gate.thawed(spark, text), "zero_false_accept") == text
    assert gate.monotonicity_breaks(fitted).count() == 0
    decided = gate.evaluate(cases, fitted, "calibration")
    assert decided.where("false_accept").count() == 0


def test_mechanism_identity_and_direction(golden, spark):
    stats = overlap.prompt_stats(golden)
    ref = spark.createDataFrame([("test", 1, 120, 0.25)], "split string, training_seed bigint, target_step bigint, online_reference double")
    rows = mechanism.prompt_mechanism(stats, ref)
    assert mechanism.identity_breaks(rows).count() == 0
    p1 = rows.where("prompt_id = 'p1'").first()
    assert p1.recent_alpha == pytest.approx(0.25) and p1.alpha_moves_favorable and not p1.overlap_channel_favorable
    pair = mechanism.pair_mechanism(rows).first()
    assert pair.n_prompts == 2 and pair.alpha_favorable_direction == "lower_alpha_favorable"


def test_seeded_bootstrap_is_the_plain_loop(golden, spark):
    acc = spark.createDataFrame([("test", 1, 120, "p1", 0.5), ("test", 1, 120, "p2", 0.25)], "split string, training_seed bigint, target_step bigint, prompt_id string, prompt_accuracy double")
    matched = overlap.matched(overlap.prompt_stats(golden), acc)
    got = {(r.behavior_step, r.estimator): r for r in bootstrap.seeded(matched, reps=300, base_seed=9).collect()}
    pwis = {r.prompt_id: r.pwis for r in matched.where("behavior_step = 0").collect()}
    seed = bootstrap.stable_seed(base_seed=9, reps=300, pair_id="test-1-0-120-fixed")
    rng, ope = np.random.default_rng(seed), []
    for k in (256, 44):
        at = rng.integers(0, 2, size=(k, 2), dtype=np.int32)
        ope += list(np.array([pwis["p1"], pwis["p2"]])[at].mean(axis=1))
    assert got[0, "prompt_wis"].ope_ci_low == pytest.approx(np.quantile(ope, 0.025))
    assert got[0, "is"].online_ci_high == got[0, "prompt_wis"].online_ci_high


def test_the_seeded_query_has_the_reference_replicates(spark):
    from driftlog.plans.catalogue import QUERIES

    got = QUERIES["bootstrap_seeded"](spark, "/root/testdata/sf0.001").select("bootstrap_reps").distinct().collect()
    assert [r.bootstrap_reps for r in got] == [2000]


def test_spread_indices_and_bands():
    assert robustness.spread_indices(35, 8) == [0, 5, 10, 15, 19, 24, 29, 34]
    assert robustness.spread_indices(8, 8) == list(range(8)) and robustness.spread_indices(5, 1) == [2]
    with pytest.raises(ValueError):
        robustness.spread_indices(3, 4)


def test_horizon_readings(spark):
    rows = spark.createDataFrame([("t", 1, 0, s, "prompt_wis", e) for s, e in ((20, 0.005), (40, 0.015), (60, 0.03), (80, 0.01))], "split string, training_seed bigint, behavior_step bigint, target_step bigint, estimator string, absolute_error double")
    assert report.reuse_horizon(rows, (0.02,)).first().last_reliable_target_step == 80
    assert report.reuse_horizon(rows, (0.02,), prefix=True).first().last_reliable_target_step == 40


def test_spearman_ties_and_constants(spark):
    rows = spark.createDataFrame([("a", 1.0, 4.0), ("a", 2.0, 2.0), ("a", 2.0, 3.0), ("a", 4.0, 1.0), ("b", 1.0, 1.0), ("b", 1.0, 2.0)], "k string, x double, y double")
    got = {r.k: r.spearman for r in report.spearman(rows, ["k"], "x", "y").collect()}
    a, b = np.array([1, 2.5, 2.5, 4]), np.array([4, 2, 3, 1])
    assert got["a"] == pytest.approx(np.corrcoef(a, b)[0, 1]) and got["b"] is None


ANSWERS = {
    "<answer>1,234/2</answer>": ("ok", Fraction(617)),
    "<ANSWER>\n $-3.50 </ANSWER>": ("ok", Fraction(-7, 2)),
    "no": ("missing_answer_tag", None),
    "<answer>1</answer><answer>2</answer>": ("multiple_answer_tags", None),
    "<answer>1.5/2</answer>": ("invalid_answer_value", None),
    "<answer>3/0</answer>": ("invalid_answer_value", None),
    "<answer></answer>": ("invalid_answer_value", None),
    "<answer>+7/-14</answer>": ("ok", Fraction(-1, 2)),
    "<answer>0.000</answer>": ("ok", Fraction(0)),
}


def test_answers(spark):
    rows = spark.createDataFrame([(t,) for t in ANSWERS], "t string")
    t = F.col("t")
    for r in rows.select("t", answers.status(t).alias("s"), answers.parsed(t).alias("v"), answers.canonical(answers.parsed(t)).alias("c"), answers.format_reward(t).alias("f")).collect():
        status, value = ANSWERS[r.t]
        assert r.s == status, r.t
        assert (Fraction(int(r.v.num), int(r.v.den)) if r.v else None) == value
        assert r.c == (None if value is None else str(value))
        assert r.f == float(status == "ok")
    gold = spark.range(1).select(answers.gold(F.lit("so\n#### 12 ")).alias("g"), answers.gold(F.lit("none")).alias("n")).first()
    assert gold.g == "12" and gold.n is None


def test_sequences(spark):
    rows = spark.createDataFrame([([5, 2, 9], [1.0, 2.0], [1.0, 2.5]), ([5, 6, 7], [1.0], [1.0, 3.0]), ([1], [], [])], "ids array<bigint>, a array<double>, b array<double>")
    out = rows.select(arrays.cut_length(F.col("ids"), [2, 9], 3).alias("c"), F.array_max(arrays.differences(F.col("a"), F.col("b"))).alias("d"), arrays.first_mismatch(F.col("a"), F.col("b")).alias("m")).collect()
    assert [tuple(r) for r in out] == [(2, 0.5, 1), (3, None, 1), (None, None, None)]


def test_record_id_is_sorted_compact_json(spark):
    import hashlib
    import json

    want = hashlib.sha256(json.dumps({"a": 1, "b": "x"}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert spark.range(1).select(hashing.record_id(b=F.lit("x"), a=F.lit(1)).alias("i")).first().i == want


def test_content_hash_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "i int, t string")
    b = spark.createDataFrame([(2, None), (1, "x")], "i int, t string").repartition(3)
    c = spark.createDataFrame([(2, ""), (1, "x")], "i int, t string")
    h = [hashing.content_hash(x, x.columns).first().content_sha256 for x in (a, b, c)]
    assert h[0] == h[1] != h[2]


def test_checks_find_what_is_wrong(golden):
    assert checks.rescore_rows(golden).count() == 0
    bad = golden.withColumn("correctness_reward", F.lit(0.5)).withColumn("completion_length", F.lit(0).cast("bigint"))
    assert {r.rule for r in checks.rescore_rows(bad).collect()} == {"binary_reward", "positive_length"}
    with pytest.raises(ValueError, match="binary_reward"):
        checks.assert_none(checks.rescore_rows(bad))
    assert checks.completeness(golden, ["behavior_step", "prompt_id"], 4).count() == 0
    assert checks.completeness(golden.where("sample_index <> 1"), ["behavior_step", "prompt_id"], 3).count() == 4


def test_registry_and_missing_units(spark):
    pairs = registry.pair_registry(spark, [1, 2, 3])
    assert pairs.count() == 234 and pairs.select("pair_id").distinct().count() == 234
    assert {(r.purpose, r["count"]) for r in pairs.groupBy("purpose").count().collect()} == {("identity", 24), ("fixed", 120), ("rolling", 90)}
    done = pairs.where("purpose = 'identity'")
    assert registry.missing_units(pairs, done, ["pair_id"]).count() == 210


def test_design_choice(spark):
    rows = spark.createDataFrame([("b", 5, True), ("a", 5, True), ("c", 1, False)], "id string, cost int, ok boolean")
    assert studies.cheapest(rows, "ok", "cost", ["id"]).first().id == "a"
    assert studies.cost_fraction(4, 16, 10, 2) == pytest.approx((40 + 32) / (80 + 64))


def _fraction(text: str) -> Fraction | None:
    """The plain reading of an answer's number."""
    t = text.strip().replace(",", "").replace("$", "")
    if not re.fullmatch(r"[-+]?[0-9]+(\.[0-9]+)?(/[-+]?[0-9]+)?", t) or ("/" in t and "." in t) or re.search(r"/[-+]?0+$", t):
        return None
    n, _, d = t.partition("/")
    return Fraction(n) / Fraction(d or 1)


def test_rationals_of_any_length(spark):
    rng = random.Random(6)
    number = lambda n: str(rng.randrange(10 ** (n - 1), 10**n))
    texts = ["1.5/2", "3/0", "3/-000", "0", "-0", "-0.00", "007", "+5", "-7/-14", "7/-14", "1,000", "$2.50", "x", "", "12345678901234567890", "-12345678901234567890.0", "0.00000000000000000000000001", "9" * 19, "9" * 20, "1" + "0" * 700]
    for n in (18, 19, 20, 25, 38, 40, 120):
        a, b, k = number(n), number(rng.choice([1, 5, n])), rng.randrange(2, 10**9)
        texts += [a, f"-{a}", f"{a}/{b}", f"{int(a) * k}/{int(b) * k}", f"{a}.{b}", f"{a}.{b}000", f"-{a}/-{b}", f"{a}/-{b}"]
    pairs = [(x, y) for x in texts for y in rng.sample(texts, 9) + [x]]
    frame = spark.createDataFrame([(x, y, *(k,)) for k, (x, y) in enumerate(pairs)], "x string, y string, k int")
    x, y = answers.rational(F.col("x")), answers.rational(F.col("y"))
    for r in frame.select("x", "y", x.alias("v"), answers.equal(x, y).alias("same")).collect():
        a, b = _fraction(r.x), _fraction(r.y)
        assert (r.v is None) == (a is None) and (a is None or Fraction(int(r.v.top), int(r.v.below)) == a)
        assert r.v is None or r.v.num is None or Fraction(int(r.v.num), int(r.v.den)) == a
        assert r.same == (a is not None and a == b), (r.x, r.y)
    got = {r.x: r.c for r in answers.canonical_answers(frame.select("x").distinct().withColumn("v", answers.rational(F.col("x"))), "v", "c").collect()}
    assert got == {t: None if _fraction(t) is None else str(_fraction(t)) for t in texts}


def test_common_prefix_counts_different_indices(spark):
    groups = {"a": [[0, 1, 2, 5], [0, 1, 2]], "b": [[0, 0, 2]], "c": [[0, 1, 2, 5]], "d": [[0, 1], [1, 0, 0, -1, 2]], "e": [[1, 2]]}
    rows = [(k, p, i, 1.0) for k, ps in groups.items() for p, ids in enumerate(ps) for i in ids] + [("f", 1, 0, 0.0), ("f", 1, 0, 1.0)]
    got = {r.k: (r.full_l, r.n_prompts, r.valid, r.n_conflicts) for r in studies.common_prefix(spark.createDataFrame(rows, "k string, prompt_id int, sample_index int, correct double"), ["k"]).collect()}
    assert got == {"a": (3, 2, True, 0), "b": (2, 1, False, 0), "c": (4, 1, False, 0), "d": (2, 2, True, 0), "e": (2, 1, False, 0), "f": (1, 1, True, 1)}
