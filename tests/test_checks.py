"""Checks that raise, registries that refuse, and readers and sinks that hold files against what is said of them."""

from __future__ import annotations

import hashlib
import json
import threading

import pytest
from pyspark.sql import functions as F

from driftlog.operators import checks, gate, invariants, overlap, registry, rescoring, studies, tables
from driftlog.sources import readers, sinks
from driftlog.streaming import ingest

PAIR_ROWS = "split string, training_seed bigint, behavior_step bigint, target_step bigint, purpose string"


def _stats(spark, prompts):
    return spark.createDataFrame([("test", 1, 0, 20, "fixed", p) for p in prompts], PAIR_ROWS + ", prompt_id bigint")


def _accuracy(spark, prompts):
    return spark.createDataFrame([("test", 1, 20, p, 0.5, 4) for p in prompts], "split string, training_seed bigint, target_step bigint, prompt_id bigint, prompt_accuracy double, n_samples bigint")


def test_unequal_prompt_sets_are_refused(spark):
    assert overlap.matched(_stats(spark, [1, 2]), _accuracy(spark, [1, 2]), enforce=True).count() == 2
    for left, right in (([1, 2], [1]), ([1], [1, 2]), ([1, 3], [1, 2])):
        with pytest.raises(ValueError, match="prompt sets differ"):
            overlap.matched(_stats(spark, left), _accuracy(spark, right), enforce=True)


def test_an_analysis_gives_all_tables_of_all_pairs(spark):
    pairs = [(0, 20, "fixed"), (0, 120, "fixed"), (100, 120, "rolling")]
    rows = [("test", 1, b, e, p, q, i, 0.1 * i - 0.01 * q, float((i + q) % 2), 3, False) for b, e, p in pairs for q in range(6) for i in range(4)]
    frame = spark.createDataFrame(rows, PAIR_ROWS + ", prompt_id bigint, sample_index bigint, log_weight double, correctness_reward double, completion_length bigint, was_truncated boolean")
    online = spark.createDataFrame([("test", 1, e, q, i, float(i % 2)) for e in (20, 120) for q in range(6) for i in range(4)], "split string, training_seed bigint, target_step bigint, prompt_id bigint, sample_index bigint, correct double")
    got = tables.analysis(frame, online, reps=10)
    assert {k: v.count() for k, v in got.items()} == {"fixed": 4, "overlap": 18, "rolling": 2, "replicates": 60}
    assert all(r.ope_ci_low <= r.ope_ci_high and r.bootstrap_reps == 10 for r in got["fixed"].collect())
    with pytest.raises(ValueError, match="prompt sets differ"):
        tables.analysis(frame, online.where("prompt_id > 0"), reps=10)


def test_prompts_need_exactly_their_samples(spark):
    rows = spark.createDataFrame([("t", 1, 20, p, i, 1.0) for p, n in ((1, 4), (2, 3)) for i in range(n)], "split string, training_seed bigint, target_step bigint, prompt_id bigint, sample_index bigint, correct double")
    assert overlap.online_prompt_accuracy(rows, 3, exact=True).select("n_samples").distinct().collect()[0][0] == 3
    with pytest.raises(Exception, match="not the samples wanted"):
        overlap.online_prompt_accuracy(rows, 4, exact=True).collect()


def test_comparators_and_outputs_are_held_against_the_registry(spark):
    pairs = spark.createDataFrame([("a", "test", 1, 100, 160, "rolling"), ("b", "test", 1, 0, 160, "fixed"), ("c", "test", 2, 100, 160, "rolling")], "pair_id string, split string, training_seed bigint, behavior_step bigint, target_step bigint, purpose string")
    got = registry.with_comparators(pairs.where("pair_id = 'a'"), pairs)
    assert sorted(r.pair_id for r in got.collect()) == ["a", "b"]
    assert registry.with_comparators(got, pairs).count() == 2
    with pytest.raises(Exception, match="no comparator"):
        registry.with_comparators(pairs, pairs).collect()
    units = lambda n: spark.createDataFrame([("a", i) for i in range(n)], "pair_id string, unit int")
    assert registry.next_pair(pairs, units(2), units(1)).count() == 1 and registry.next_pair(pairs, units(2), units(2)).count() == 0
    with pytest.raises(Exception, match="more outputs than sources"):
        registry.next_pair(pairs, units(2), units(3)).collect()


def test_small_registries(spark):
    trial = registry.engineering_registry(spark, [1]).collect()
    assert sorted((r.behavior_step, r.target_step, r.purpose) for r in trial) == [(0, 0, "identity"), (0, 400, "fixed"), (400, 400, "identity")]
    both = registry.union_registry(spark.createDataFrame([(1,)], "i int"), spark.createDataFrame([(2,)], "i int"))
    assert sorted(map(tuple, both.collect())) == [(1, "train"), (2, "test")]
    shards = spark.createDataFrame([(0, 8), (8, 16), (16, 24)], "start int, stop int")
    assert registry.shards_within(shards, 9).count() == 2
    assert rescoring.spaced_targets(2) == (20, 400) and len(rescoring.spaced_targets(7)) == 7 and rescoring.spaced_targets(20) == tuple(range(20, 401, 20))
    with pytest.raises(ValueError):
        rescoring.spaced_targets(21)


def test_plans_are_judged(spark):
    effects = spark.createDataFrame([(2, 4, "t", "all", "reference", 0.02, 0.03, True), (8, 8, "t", "all", "reference", 0.001, 0.002, True), (8, 32, "t", "all", "fixed", 0.0, 0.0, False)], "main_l int, audit_l int, split string, scope string, kind string, mean_change double, p95_change double, valid boolean")
    got = {(r.main_l, r.audit_l): (r.passed, r.cost_fraction) for r in studies.plan_verdicts(effects, 6, 2).collect()}
    assert got[2, 4] == (False, pytest.approx(20 / 112)) and got[8, 8] == (True, pytest.approx(64 / 112)) and got[8, 32] == (False, 1.0)


def test_the_test_split_is_closed_until_the_gate_is_locked():
    checks.open_test("development", None, None)
    checks.open_test("test", "a", "a")
    for own, locked in ((None, "a"), ("a", None), ("a", "b")):
        with pytest.raises(PermissionError):
            checks.open_test("test", own, locked)


def _gate(spark):
    rows = [(s, 1, b, "fixed", e, r, k) for s, b, e, r, k in (("t", 0, 0.001, 0.9, 0.1), ("t", 1, 0.03, 0.2, 0.5))]
    cases = spark.createDataFrame([("t", s, 0, 20 + b, p, e, r, k) for _, s, b, p, e, r, k in rows], PAIR_ROWS + ", absolute_error double, median_prompt_relative_ess double, tokenwise_kl_proxy double")
    return cases, gate.frozen(gate.fit(cases), "none false")


def test_frozen_gates_are_applied_as_they_were_frozen(spark):
    cases, text = _gate(spark)
    own = json.loads(text)["content_sha256"]
    assert gate.apply_frozen(cases, text, "official_test", [1], own).count() == 12
    with pytest.raises(ValueError, match="not what was frozen"):
        gate.thawed(spark, text.replace('"policy": "none false"', '"policy": "some"'))
    with pytest.raises(ValueError, match="not what was frozen"):
        gate.thawed(spark, text, "0" * 64)
    with pytest.raises(ValueError, match="seeds"):
        gate.apply_frozen(cases, text, "official_test", [1, 2])
    with pytest.raises(ValueError, match="duplicate_case"):
        gate.apply_frozen(cases.union(cases), text, "official_test", [1])


def test_splits_and_seeds_are_there(spark):
    table = spark.createDataFrame([("development", 1), ("test", 2)], "split string, training_seed int")
    assert checks.choose_split(table, "test", final=True) == "test" and checks.choose_split(table, "development") == "development"
    for wanted, final in (("other", False), ("development", True)):
        with pytest.raises(ValueError):
            checks.choose_split(table, wanted, final)
    assert [r[0] for r in invariants.missing_seeds(table, [1, 2, 3]).collect()] == [3]


def test_trees_are_hashed_by_paths_sizes_and_contents(spark, tmp_path):
    files = {"a.txt": b"one", "sub/b.bin": b"\x00two", "sub/deep/c": b""}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    records = [{"path": n, "size_bytes": len(d), "sha256": hashlib.sha256(d).hexdigest()} for n, d in sorted(files.items())]
    got = readers.tree_hash(spark, str(tmp_path))
    assert got["files"] == records and got["total_bytes"] == 7 and got["file_count"] == 3
    assert got["tree_sha256"] == hashlib.sha256(json.dumps(records, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    (tmp_path / "t.csv").write_text("a,b\n1,x\n")
    frame, own = readers.table(spark, str(tmp_path / "t.csv"), "a int, b string", ["a"])
    assert frame.collect()[0] == (1, "x") and own == hashlib.sha256(b"a,b\n1,x\n").hexdigest()


def test_shards_are_held_against_their_manifests(spark, tmp_path):
    schema, folder, notes = "i bigint", tmp_path / "data", tmp_path / "notes"
    notes.mkdir()
    for k in range(2):
        spark.range(k * 3, k * 3 + 3).toDF("i").coalesce(1).write.parquet(f"{folder}/shard={k}")
    files = sorted(folder.rglob("part-*.parquet"))

    def note(k, file, **other):
        said = {"data_file": f"x/{file.name}", "sha256": hashlib.sha256(file.read_bytes()).hexdigest(), "row_count": 3, "unit": f"u{k}"} | other
        (notes / f"{k}.json").write_text(json.dumps(said))

    for k, f in enumerate(files):
        note(k, f)
    assert readers.verified_shards(spark, f"{notes}/*.json", str(folder), schema).count() == 6
    for other, rule in (({"sha256": "0"}, "sha256"), ({"row_count": 4}, "row_count"), ({"data_file": "x/gone.parquet"}, "missing"), ({"unit": "u0"}, "duplicate_unit"), ({"data_file": f"x/{files[0].name}"}, "duplicate_data_file")):
        note(1, files[1], **other)
        found = {r.rule for r in readers.shard_breaks(spark, readers.shard_manifests(spark, f"{notes}/*.json"), str(folder), schema).collect()}
        assert rule in found
        with pytest.raises(ValueError, match=rule if rule != "duplicate_data_file" else "."):
            readers.verified_shards(spark, f"{notes}/*.json", str(folder), schema)


def test_rescores_are_complete_and_pruned(spark, tmp_path):
    rows = [("test", 1, 0, 20, "fixed", p, i, f"{p}-{i}", 0.5, 1.0, 3) for p in (1, 2) for i in range(5)]
    schema = PAIR_ROWS + ", prompt_id bigint, sample_index bigint, trajectory_id string, log_weight double, correctness_reward double, completion_length bigint"
    spark.createDataFrame(rows, schema).write.partitionBy("target_step").parquet(f"{tmp_path}/r")
    where = "target_step = 20"
    assert readers.rescores(spark, f"{tmp_path}/r", schema, where, 4).count() == 8
    with pytest.raises(ValueError, match="samples"):
        readers.rescores(spark, f"{tmp_path}/r", schema, where, 6)
    plan = spark.read.schema(schema).parquet(f"{tmp_path}/r").where(where)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(target_step" in plan
    with pytest.raises(ValueError, match="finite_weight"):
        spark.createDataFrame(rows, schema).withColumn("log_weight", F.lit(float("nan"))).write.partitionBy("target_step").parquet(f"{tmp_path}/n")
        readers.rescores(spark, f"{tmp_path}/n", schema, where, 4)


def test_of_two_writers_one_publishes(spark, tmp_path):
    path, made = f"{tmp_path}/unit", []
    frame = spark.range(50).toDF("i")
    threads = [threading.Thread(target=lambda: made.append(sinks.publish(frame, path))) for _ in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(made) == [False, False, True] and spark.read.parquet(path).count() == 50
    assert not [x for x in tmp_path.iterdir() if x.name.endswith(".tmp")]
    with pytest.raises(ValueError, match="other rows"):
        sinks.publish(spark.range(5).toDF("i"), path)


def test_merged_metrics_stand_in_order(spark):
    one = spark.createDataFrame([("2", "10", 0.1), ("x", "1", 0.2)], "training_seed string, step string, loss double")
    two = spark.createDataFrame([("1", "20.0"), ("1", "3")], "training_seed string, step string")
    assert [(r.training_seed, r.step) for r in sinks.merged_metrics([one, two]).collect()] == [("x", "1"), ("1", "3"), ("1", "20.0"), ("2", "10")]


def test_missing_csv_is_no_rows_and_broken_ones_are_errors(spark, tmp_path):
    assert readers.csv(spark, f"{tmp_path}/none.csv", "a int", missing_ok=True).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.csv(spark, f"{tmp_path}/none.csv", "a int")
    (tmp_path / "t.csv").write_text("a\n1\n")
    with pytest.raises(ValueError, match="lacks"):
        readers.csv(spark, f"{tmp_path}/t.csv", "a int, b int", ["b"], missing_ok=True)


def test_pinned_and_summaries(spark, tmp_path):
    spark.range(4).write.parquet(f"{tmp_path}/p")
    assert readers.pinned(spark, f"{tmp_path}/p", 4).count() == 4
    with pytest.raises(ValueError, match="4 rows"):
        readers.pinned(spark, f"{tmp_path}/p", 5)
    for k in range(3):
        (tmp_path / f"s{k}.json").write_text(json.dumps({"a": k}))
    got = readers.summaries(spark, f"{tmp_path}/s*.json", "a int").collect()
    assert sorted(r.a for r in got) == [0, 1, 2] and all(r.file.endswith(f"s{r.a}.json") for r in got)


def test_ingestion_reads_only_the_batch_s_partitions(spark, tmp_path):
    schema, names = "k bigint, part int", (f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check")
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(names[0])
    for rows in ([(1, 0), (2, 1)], [(2, 1), (3, 0), (4, 2)], [(1, 0)]):
        put(rows)
        ingest.follow(spark, names[0], schema, names[1], names[2], ["part"], "k").awaitTermination()
    assert sorted((r.k, r.part) for r in spark.read.parquet(names[1]).collect()) == [(1, 0), (2, 1), (3, 0), (4, 2)]
