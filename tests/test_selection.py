"""Quantiles, row numbers and ranks of groups against Spark's own, which hold a group in one task."""

from __future__ import annotations

import math
import os
import random
import struct

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from driftlog.operators import selection
from driftlog.sources.scratch import Scratch

SHARES = (0.0, 0.025, 0.1, 1 / 3, 0.5, 0.9, 0.975, 1.0)


def bits(x):
    return None if x is None else "nan" if math.isnan(x) else struct.pack("<d", x + 0.0)


@pytest.fixture(scope="module")
def rows(spark):
    """Groups of one value, of ties, of all magnitudes and signs, of neighbouring doubles, with NULL, NaN, infinities and a NULL key."""
    rng = random.Random(1)
    out = [("one", 3.5, 1.0), ("none", None, None), (None, 1.0, -2.0), (None, None, 4.0), ("nan", float("nan"), float("nan")), ("nan", 1.0, 0.0), ("nan", float("inf"), -0.0), ("nan", float("-inf"), 0.0)]
    out += [("tie", rng.choice([1.0, 1.0, 2.0]), 7.0) for _ in range(200)]
    out += [("wide", rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300), rng.gauss(0, 1)) for _ in range(501)]
    x = 1.0
    for _ in range(100):
        x = math.nextafter(x, 2)
        out.append(("near", x, -x))
    out += [("tiny", rng.choice([0.0, -0.0, 5e-324, -5e-324, 1e-310]), rng.random()) for _ in range(60)]
    rng.shuffle(out)
    return spark.createDataFrame([(i, *r) for i, r in enumerate(out)], "i bigint, g string, x double, y double").repartition(5)


def test_quantiles_are_percentiles_bit_for_bit(spark, rows):
    wanted = {f"{c}{i}": (c, q) for c in "xy" for i, q in enumerate(SHARES)}
    got = {r.g: r for r in selection.exact_quantiles(rows, ["g"], wanted).collect()}
    want = rows.groupBy("g").agg(*(F.percentile(c, F.lit(q)).alias(n) for n, (c, q) in wanted.items())).collect()
    assert set(got) == {r.g for r in want}
    for r in want:
        for n in wanted:
            assert bits(got[r.g][n]) == bits(r[n]), (r.g, n, got[r.g][n], r[n])


def test_quantiles_of_all_rows_and_of_none(spark, rows):
    assert selection.exact_quantiles(rows, [], {"m": ("y", 0.5)}).collect() == rows.where("y is not null").agg(F.median("y").alias("m")).collect()
    assert selection.exact_quantiles(rows.where("false"), ["g"], {"m": ("y", 0.5)}).collect() == []


def test_one_large_group_leaves_few_rows_to_a_task(spark):
    """A group of 200,000 values: no aggregate and no window holds more than its counted steps."""
    df = spark.range(200_000).selectExpr("'a' as g", "sin(id * 0.37) * exp(cos(id)) as x")
    with Scratch(spark, "t") as scratch:
        got = selection.quantiles(df, ["g"], {"p": ("x", 0.1), "m": ("x", 0.5)}, scratch)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "percentile" not in plan and "collect_list" not in plan
        assert got.first()[1:] == df.groupBy("g").agg(F.percentile("x", F.lit(0.1)), F.median("x")).first()[1:]
        left = [spark.read.parquet(f"{scratch.folder}/{d}").count() for d in sorted(os.listdir(scratch.folder.removeprefix("file://"))) if d.endswith(("-counts", "-left"))]
    assert left[0] < 40_000 and left[1] < 2_000


def test_numbers_are_row_numbers(spark, rows):
    w = Window.partitionBy("g")
    want = rows.select("i", (F.row_number().over(w.orderBy("x", "i")) - 1).alias("_rank"), F.count(F.lit(1)).over(w).alias("_n"))
    with Scratch(spark, "t") as scratch:
        got = selection.numbered(rows, ["g"], ["x", "i"], scratch)
        assert got.columns == [*rows.columns, "_rank", "_n"]
        assert sorted(tuple(r) for r in got.select("i", "_rank", "_n").collect()) == sorted(tuple(r) for r in want.collect())
        hot = spark.range(5000).selectExpr("1 as g", "id * 7919 % 5003 as x")  # one group over all ranges
        assert sorted((r.x, r._rank, r._n) for r in selection.numbered(hot, ["g"], ["x"], scratch).collect()) == [(x, i, 5000) for i, x in enumerate(sorted(i * 7919 % 5003 for i in range(5000)))]
        assert selection.numbered(hot.where("false"), ["g"], ["x"], scratch).count() == 0


def test_ranks_share_ties(spark, rows):
    with Scratch(spark, "t") as scratch:
        got = selection.average_ranks(rows, ["g"], ["x", "y"], scratch).collect()
    for v in "xy":
        w = Window.partitionBy("g").orderBy(v)
        mean = F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy("g", v)) - 1) / 2
        want = {r.i: r.m for r in rows.where(f"{v} is not null").select("i", mean.alias("m")).collect()}
        assert {r.i: r[f"rank_{v}"] for r in got if r[v] is not None} == want
        assert all(r[f"rank_{v}"] is None for r in got if r[v] is None)


def test_tables_between_are_removed(spark, rows):
    with Scratch(spark, "gone") as scratch:
        selection.quantiles(rows, ["g"], {"m": ("y", 0.5)}, scratch).count()
    assert not os.path.exists(scratch.folder.removeprefix("file://"))
