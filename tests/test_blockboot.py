"""The bootstrap over blocks: the same for any blocks, the draws of a plain loop, and binomial counts."""

from __future__ import annotations

import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftlog.operators import blockboot
from driftlog.sources.scratch import Scratch

SCHEMA = "split string, prompt_id long, pwis double, log_is double, prompt_accuracy double"


def rows(n: int, name: str = "a", seed: int = 1):
    rng = random.Random(seed)
    return [(name, p, rng.random(), rng.choice([rng.gauss(0, 3), None, rng.gauss(-40, 1)]) if p % 7 else rng.gauss(1, 1), rng.random()) for p in rng.sample(range(10 * n), n)]


def made(spark, data, reps=40, **how):
    with Scratch(spark, "t") as scratch:
        got = blockboot.replicates(spark.createDataFrame(data, SCHEMA).repartition(3), reps, scratch, ["split"], **how).collect()
    return {(r.split, r.estimator, r.replicate): (r.ope_estimate, r.online_reference, r.absolute_error, r.estimator_status) for r in got}


def mixed(h: int) -> int:
    h ^= h >> 16
    h = h * 0x85EBCA6B & 0xFFFFFFFF
    h ^= h >> 13
    h = h * 0xC2B2AE35 & 0xFFFFFFFF
    return h ^ h >> 16


def plain(data, reps: int, leaf: int, stream: str = "") -> dict:
    """Draw by draw, leaf by leaf, sums as fractions."""
    import hashlib

    data = sorted(data, key=lambda r: r[1])
    n, name = len(data), data[0][0]
    seed = int(hashlib.md5(f"{name}|{stream}".encode()).hexdigest()[:8], 16)
    counts = {}

    def walk(lo, hi, c):
        if hi - lo == 1:
            counts[lo] = c
            return
        mid = (lo + hi) // 2
        left, right = (mid - lo) * leaf, min(hi * leaf, n) - mid * leaf
        taken = np.random.Generator(np.random.Philox(key=[seed, lo << 32 | hi])).binomial(c, left / (left + right))
        walk(lo, mid, taken)
        walk(mid, hi, c - taken)

    walk(0, -(-n // leaf), np.full(reps, n, np.int64))
    top = max(r[3] for r in data if r[3] is not None)
    out = {}
    for r in range(reps):
        drawn = []
        for k, c in counts.items():
            size, base = min(leaf, n - k * leaf), mixed((seed + k * 0x9E3779B1) & 0xFFFFFFFF)
            a, b = (mixed((base ^ ((2 * r + j) * 0x9E3779B1 & 0xFFFFFFFF)) & 0xFFFFFFFF) for j in (0, 1))
            drawn += [k * leaf + (mixed((mixed(a ^ i) + b) & 0xFFFFFFFF) * size >> 32) for i in range(int(c[r]))]
        assert len(drawn) == n
        mean = lambda f: float(sum(Fraction(f(data[i])) for i in drawn)) / n  # noqa: B023, E731
        weight = mean(lambda x: 0.0 if x[3] is None else math.exp(x[3] - top)) * n
        out[r] = (math.exp(top + math.log(weight) - math.log(n)) if weight else 0.0, mean(lambda x: x[2]), mean(lambda x: x[4]))
    return out


@pytest.mark.parametrize("n,leaf", [(1, 8), (30, 64), (200, 16), (257, 16)])
def test_is_the_plain_loop(spark, n, leaf):
    data = rows(n, f"p{n}")
    if n == 1:
        data = [(*data[0][:3], 0.25, data[0][4])]
    got, want = made(spark, data, 30, leaf=leaf, leaves=3), plain(data, 30, leaf)
    for r, (linear, pwis, online) in want.items():
        assert got[f"p{n}", "is", r][0] == pytest.approx(linear, rel=1e-13)
        assert got[f"p{n}", "prompt_wis", r][:2] == (pwis, online) and got[f"p{n}", "is", r][1] == online


def test_unpaired_draws_for_each(spark):
    data = rows(100, "u")
    got, a, b = made(spark, data, 20, paired=False, leaf=16, leaves=2), plain(data, 20, 16, "is"), plain(data, 20, 16, "prompt_wis")
    assert all(got["u", "is", r][1] == a[r][2] and got["u", "prompt_wis", r][:2] == b[r][1:] for r in range(20))


def test_blocks_and_partitions_change_nothing(spark):
    data = rows(700, "a") + rows(300, "b", 2) + [("none", 1, 0.5, None, 0.5), ("none", 2, 0.25, None, 0.0)]
    base = made(spark, data, 25, leaf=16, leaves=1)
    assert len(base) == 3 * 2 * 25 and base["none", "is", 3][0] == 0.0
    for leaves in (2, 7, 1000):
        assert made(spark, data, 25, leaf=16, leaves=leaves) == base


def test_what_is_not_finite(spark):
    data = [(x[0], x[1], x[2], float("nan") if i == 0 else x[3], x[4]) for i, x in enumerate(rows(40, "n"))]
    got = made(spark, data, 60)
    bad = [r for r in range(60) if got["n", "is", r][3] == "nonfinite_estimator"]
    assert 20 < len(bad) < 50 and all(got["n", "is", r][0] is None and got["n", "is", r][1] is not None for r in bad)
    assert all(got["n", "prompt_wis", r][0] is not None for r in range(60))
    high = [("h", i, 0.5, 900.0, 0.5) for i in range(5)]
    assert {v[3] for k, v in made(spark, high, 5).items() if k[1] == "is"} == {"nonfinite_estimator"}


def test_draws_spread_as_they_should(spark):
    """Every prompt is drawn once in the mean, with the variance of a multinomial; leaves too."""
    n, reps = 120, 400
    data = [("s", p, float(2 ** (p % 30)), 0.0, float(p < 32)) for p in range(n)]
    got = made(spark, data, reps, leaf=16, leaves=2)
    share = [got["s", "is", r][1] * n for r in range(reps)]  # draws among the first 32 prompts, two leaves
    p = 32 / n
    assert abs(np.mean(share) - 32) < 5 * math.sqrt(n * p * (1 - p) / reps)
    assert 0.75 < np.var(share) / (n * p * (1 - p)) < 1.3
    assert len(Counter(share)) > 10


def test_a_large_pair_is_cut(spark):
    """One pair of 50,000 prompts: no task has more than its leaves."""
    df = spark.range(50_000).selectExpr("'big' as split", "id as prompt_id", "id % 100 / 100e0 as pwis", "sin(id) as log_is", "cast(id % 2 as double) as prompt_accuracy")
    with Scratch(spark, "t") as scratch:
        out = blockboot.replicates(df, 20, scratch, ["split"], leaves=8)
        got = out.groupBy("estimator").agg(F.avg("ope_estimate").alias("m"), F.stddev("ope_estimate").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    m = {r.estimator: r for r in got}
    assert m["prompt_wis"].n == 20 and abs(m["prompt_wis"].m - 0.495) < 0.005 and 0.0006 < m["prompt_wis"].s < 0.0025


@pytest.mark.parametrize("paired", [True, False])
def test_a_pair_of_several_leaves_draws_as_the_sql(spark, paired):
    """More prompts than a leaf, cut into blocks: the draws are those of a pair that is one leaf, as the SQL makes them."""
    data = rows(1500, "w") + rows(40, "v", 3)
    base = made(spark, data, 12, leaf=None, paired=paired)
    for block in (64, 1000):
        assert made(spark, data, 12, leaf=None, block=block, paired=paired) == base
    for name in "wv":
        some = [r for r in data if r[0] == name]
        for k, stream in enumerate(["", ""] if paired else ["is", "prompt_wis"]):
            for r, (linear, pwis, online) in plain(some, 12, len(some), stream).items():
                got = base[name, ("is", "prompt_wis")[k], r]
                assert got[1] == online and got[0] == (pytest.approx(linear, rel=1e-13) if k == 0 else pwis)


@pytest.mark.parametrize("paired", [True, False])
def test_portable_draws_by_digests_in_blocks(spark, monkeypatch, paired):
    """Draw by draw with hashlib; the pair is cut into blocks and is in no row."""
    import hashlib

    from driftlog.operators import bootstrap

    monkeypatch.setattr(blockboot, "BLOCK", 50)
    data = sorted(rows(120, "d"), key=lambda r: r[1])
    got = {(r.estimator, r.replicate): r for r in bootstrap.portable(spark.createDataFrame(data, SCHEMA).repartition(3), 12, ["split"], paired).collect()}
    assert len(got) == 24
    for (estimator, r), x in got.items():
        seed = f"d|{r}|" if paired else f"d|{estimator}|{r}|"
        drawn = [data[int(hashlib.md5(f"{seed}{i}".encode()).hexdigest()[:8], 16) % 120] for i in range(120)]
        value = [y[2] if estimator == "prompt_wis" else 0.0 if y[3] is None else math.exp(y[3]) for y in drawn]
        assert x.ope_estimate == pytest.approx(math.fsum(value) / 120, rel=1e-12) and x.online_reference == pytest.approx(math.fsum(y[4] for y in drawn) / 120, rel=1e-14)


def test_digests_of_long_names():
    import hashlib

    for prefix in (b"x|", b"y" * 50 + b"|", b"z" * 130 + b"|"):
        got = blockboot._digests()(np, prefix, (8, 103), (0, 1003))
        assert all(got[r - 8, i] == int(hashlib.md5(prefix + f"{r}|{i}".encode()).hexdigest()[:8], 16) for r in (8, 10, 99, 102) for i in (0, 9, 10, 1002))


@pytest.mark.parametrize("name", ["estimator_table", "mc_inclusion", "sample_size"])
def test_prompts_are_made_once_a_query(spark, monkeypatch, name):
    """What is bootstrapped comes from a table of prompts, not from the events again."""
    from driftlog.operators import bootstrap
    from driftlog.plans.catalogue import QUERIES

    seen, portable = [], bootstrap.portable
    monkeypatch.setattr(bootstrap, "portable", lambda df, *a: seen.append(df.inputFiles()) or portable(df, *a))
    QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    assert len(seen) == 1 and seen[0] and not any("events.parquet" in f for f in seen[0])


def test_digests_are_those_of_hashlib_wherever_they_begin_to_differ():
    """One and two blocks of a message; the replicate's digits alone, or with others, in the words that change."""
    import hashlib

    digest = blockboot._digests()
    for long in (0, 3, 30, 46, 49, 50, 53, 54, 55, 61, 62, 64, 119, 128):
        prefix = b"p" * long + b"|"
        for reps, draws in (((0, 12), (0, 13)), ((98, 102), (95, 1010)), ((7, 8), (99_990, 100_010)), ((5, 6), (0, 3))):
            got = digest(np, prefix, reps, draws)
            for r in range(*reps):
                for i in (draws[0], draws[0] + 1, sum(draws) // 2, draws[1] - 1):
                    assert got[r - reps[0], i - draws[0]] == int(hashlib.md5(prefix + f"{r}|{i}".encode()).hexdigest()[:8], 16)


def test_prompts_of_pairs_are_sorted_by_number_in_many_partitions(spark):
    """Rows of prompts grow by the pairs after the exchange: they are dealt out for that, and sorted by what tells them apart first."""
    import re

    from driftlog.operators.overlap import prompt_stats
    from driftlog.plans.fixtures import Fixture

    rows = Fixture(spark, "/root/testdata/sf0.001").rescores
    assert rows.rdd.getNumPartitions() == 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = prompt_stats(rows)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Sort \[prompt_id#\d+L ASC NULLS FIRST, split", plan) and "Sort [split" not in plan
