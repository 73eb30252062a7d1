"""Readers, sinks and resumable ingestion."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from driftlog.sources import readers, schemas, sinks
from driftlog.streaming.ingest import follow


def test_csv_types_and_missing(spark, tmp_path):
    (tmp_path / "t.csv").write_text("b,a,extra\n1.5,x,9\n,y,9\n")
    rows = readers.csv(spark, str(tmp_path / "t.csv"), "a string, b double, c bigint", ["a"]).collect()
    assert [tuple(r) for r in rows] == [("x", 1.5, None), ("y", None, None)]
    with pytest.raises(ValueError, match="lacks z"):
        readers.csv(spark, str(tmp_path / "t.csv"), "a string", ["z"])
    assert readers.csv(spark, str(tmp_path / "none.csv"), "a string", missing_ok=True).count() == 0
    with pytest.raises(Exception, match="(?i)path"):
        readers.csv(spark, str(tmp_path / "none.csv"), "a string")


def test_documents_and_protocol(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"a": {"b": [1]}}))
    assert readers.document(spark, str(tmp_path / "d.json")) == {"a": {"b": [1]}}
    text = "seeds:\n  - 1\n  - 2\ngate:\n  tolerance: [0.01, 0.02]\n  name: 'x'\nnone:\n"
    (tmp_path / "p.yaml").write_text(text)
    got = readers.protocol(spark, str(tmp_path / "p.yaml"))
    assert got["seeds"] == [1, 2] and got["gate"] == {"tolerance": [0.01, 0.02], "name": "x"} and len(got["sha256"]) == 64
    assert readers._yaml(text) == {k: v for k, v in got.items() if k != "sha256"}


def test_word_problems(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([{"ID": "1", "Body": "Two.", "Question": "How many?", "Answer": "2.0", "Type": "Add", "Equation": "x"}]))
    r = readers.word_problems(spark, str(tmp_path / "s.json")).first()
    assert r.question == "Two.\nHow many?" and (r.gold.num, r.gold.den) == (2, 1)


def test_pinned_counts(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "p"))
    assert readers.pinned(spark, str(tmp_path / "p"), 3).count() == 3
    with pytest.raises(ValueError):
        readers.pinned(spark, str(tmp_path / "p"), 4)


def test_replace_scope_keeps_other_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.parquet(spark.createDataFrame([("a", 1), ("b", 2)], "split string, n int"), path, ["split"])
    sinks.replace_scope(spark.createDataFrame([("b", 3), ("b", 4)], "split string, n int"), path, ["split"])
    assert sorted((r.split, r.n) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 3), ("b", 4)]


def test_publish_once(spark, tmp_path):
    path, df = str(tmp_path / "u"), spark.createDataFrame([(1, "x")], "i int, t string")
    assert sinks.publish(df, path) and not sinks.publish(df, path)
    with pytest.raises(ValueError):
        sinks.publish(df.withColumn("t", F.lit("y")), path)


def test_csv_sink_orders(spark, tmp_path):
    sinks.csv(spark.createDataFrame([(2, "b"), (1, "a")], "i int, t string"), str(tmp_path / "o"), ["t", "i"], ["i"])
    assert readers.csv(spark, str(tmp_path / "o"), "t string, i int").collect()[0].t == "a"


def test_schemas_are_valid(spark):
    for s in (schemas.SPLIT_REGISTRY, schemas.BEHAVIOR_TRAJECTORY, schemas.PAIR_REGISTRY, schemas.TARGET_RESCORE, schemas.ONLINE_PROMPT_SUMMARY):
        assert spark.createDataFrame([], s).count() == 0


def test_follow_adds_each_key_once(spark, tmp_path):
    src, dst, ck = (str(tmp_path / x) for x in ("src", "dst", "ck"))
    part = lambda rows: spark.createDataFrame(rows, "trajectory_id string, split string, n int").write.mode("append").parquet(src)
    part([("a", "dev", 1), ("b", "test", 2)])
    follow(spark, src, "trajectory_id string, split string, n int", dst, ck, ["split"], "trajectory_id").awaitTermination()
    part([("b", "test", 2), ("c", "dev", 3)])
    follow(spark, src, "trajectory_id string, split string, n int", dst, ck, ["split"], "trajectory_id").awaitTermination()
    assert sorted(r.trajectory_id for r in spark.read.parquet(dst).collect()) == ["a", "b", "c"]
