"""Versioned tables under several writers, a killed one and a reader between; layouts and kept-up hashes."""

from __future__ import annotations

import os
import random
import re
import threading

import pytest
from pyspark.sql import functions as F

from driftlog.functions import multiset
from driftlog.sources import layout
from driftlog.sources.snapshots import Conflict, Snapshots


@pytest.fixture()
def table(spark, tmp_path):
    return Snapshots(spark, f"file://{tmp_path}/t")


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "k string, n long")


def held(df):
    return sorted(tuple(r) for r in df.collect())


def test_versions_stay_as_they_were(spark, table):
    assert table.version() == 0
    with pytest.raises(FileNotFoundError):
        table.read()
    table.append(frame(spark, ("a", 1), ("b/ =", 2), (None, 3)), ["k"])
    table.append(frame(spark, ("a", 4)), ["k"])
    table.replace(frame(spark, ("a", 5), ("c", 6)), ["k"])
    table.overwrite(frame(spark, ("z", 9)), ["k"])
    assert [held(table.read(v).where("k is not null")) for v in (1, 2, 3, 4)] == [[("a", 1), ("b/ =", 2)], [("a", 1), ("a", 4), ("b/ =", 2)], [("a", 5), ("b/ =", 2), ("c", 6)], [("z", 9)]]
    assert held(table.read(3).where("k is null").select("n")) == [(3,)]
    assert table.read().columns == ["k", "n"] and table.version() == 4
    with pytest.raises(ValueError, match="other columns"):
        table.append(spark.range(2))


def test_many_writers_lose_nothing(spark, table):
    def write(i):
        for j in range(3):
            table.append(frame(spark, (f"w{i}", j)))

    threads = [threading.Thread(target=write, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert held(table.read()) == [(f"w{i}", j) for i in range(4) for j in range(3)]
    assert table.versions() == list(range(1, 13))


def test_a_version_is_claimed_once(spark, table):
    table.append(frame(spark, ("a", 1)))
    wins = []
    threads = [threading.Thread(target=lambda i=i: wins.append((i, table._claim(2, f'{{"by": {i}}}')))) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sum(won for _, won in wins) == 1 and table.state(2) == {"by": next(i for i, won in wins if won)}
    assert not [x for x in os.listdir(table.path.removeprefix("file://") + "/_log") if x.endswith(".tmp")]


def test_a_killed_writer_leaves_no_trace(spark, table, monkeypatch):
    table.append(frame(spark, ("a", 1)))
    with monkeypatch.context() as m:
        m.setattr(Snapshots, "_claim", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            table.overwrite(frame(spark, ("b", 2)))
    assert held(table.read()) == [("a", 1)] and table.version() == 1
    assert len(table.vacuum()) == 1 and held(table.read()) == [("a", 1)]


def test_a_reader_keeps_its_version(spark, table):
    table.append(frame(spark, ("a", 1), ("b", 2)), ["k"])
    pinned = table.read()
    table.overwrite(frame(spark, ("c", 3)), ["k"])
    assert held(pinned) == [("a", 1), ("b", 2)] and held(table.read()) == [("c", 3)]
    assert len(table.vacuum(keep=1)) == 1 and held(table.read()) == [("c", 3)] and table.versions() == [2]


def test_writes_on_a_stale_version_are_refused(spark, table):
    table.append(frame(spark, ("a", 1)))
    table.append(frame(spark, ("b", 2)))
    with pytest.raises(Conflict):
        table.overwrite(frame(spark, ("c", 3)), expect=1)
    assert table.compact() == 3 and held(table.read()) == [("a", 1), ("b", 2)] and len(table.state()["folders"]) == 1


def test_units_are_published_once(spark, table):
    assert table.publish(frame(spark, ("a", 1)), "unit-1", content="x")
    assert not table.publish(frame(spark, ("a", 1)), "unit-1", content="x")
    with pytest.raises(ValueError, match="other rows"):
        table.publish(frame(spark, ("a", 2)), "unit-1", content="y")
    assert held(table.read()) == [("a", 1)]
    empty = frame(spark, ("a", 1)).where("false")
    assert table.publish(empty, "unit-2") and held(table.read()) == [("a", 1)]


def test_buckets_need_no_exchange(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id % 37 as p", "id % 5 as q", "id as v")
    laid = layout.bucketed(rows, ["p"], ["p", "q"], 4, f"file://{tmp_path}/b")
    grouped = laid.groupBy("p", "q").agg(F.sum("v").alias("s"))
    assert "Exchange" not in grouped._jdf.queryExecution().executedPlan().toString()
    other = layout.bucketed(rows.select("p", F.col("v").alias("w")), ["p"], ["p"], 4, f"file://{tmp_path}/c")
    joined = laid.hint("merge").join(other, "p")
    assert not re.search("Exchange", joined._jdf.queryExecution().executedPlan().toString())
    assert held(grouped) == held(rows.groupBy("p", "q").agg(F.sum("v")))


def test_states_add_up(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), rng.randrange(50), rng.choice(["x", None, "é"])) for _ in range(600)]
    df = lambda r: spark.createDataFrame(r, "s string, n long, t string")
    of = lambda r: multiset.state(df(r), ["s", "n", "t"], ["s"])
    text = lambda st: {r.s: (r.n_rows, r.content_hash) for r in multiset.digest(st, ["s"]).collect()}
    whole = text(of(rows))
    assert whole == text(multiset.state(df(rows).repartition(7), ["t", "n", "s"], ["s"]))
    assert whole == text(multiset.combined(of(rows[:200]), of(rows[200:]), ["s"]))
    assert text(of(rows[:200])) == text(multiset.combined(of(rows), of(rows[200:]), ["s"], minus=True))
    changed = [(s, n + (i == 5), t) for i, (s, n, t) in enumerate(rows)]
    assert {k for k, v in text(of(changed)).items() if v != whole[k]} == {rows[5][0]}
    twice = text(of([*rows, rows[0]]))
    assert twice[rows[0][0]] != whole[rows[0][0]]
    alone = multiset.digest(multiset.state(df(rows), ["s", "n", "t"], []), []).collect()
    assert len(alone) == 1 and alone[0].n_rows == 600
