"""Ingestion that crashes between any two steps, shards in folders of their own, and files of any size."""

from __future__ import annotations

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from driftlog.sources import readers
from driftlog.sources.snapshots import Snapshots
from driftlog.streaming.ingest import ingest, publish_batch

SCHEMA = "k string, part string, n int"


def shard(spark, src, *rows):
    spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(src)


class Crash(RuntimeError):
    pass


@pytest.mark.parametrize("step", ["before rows", "after rows", "before keys", "before claim", "after claim"])
def test_a_crash_anywhere_leaves_one_copy(spark, tmp_path, monkeypatch, step):
    src, dst, ck = (f"file://{tmp_path}/{x}" for x in ("src", "dst", "ck"))
    run = lambda: ingest(spark, src, SCHEMA, dst, ck, ["part"], "k").awaitTermination()
    shard(spark, src, ("a", "x", 1), ("b", "y", 2), ("b", "y", 2))
    run()
    shard(spark, src, ("c", "x", 3), ("a", "z", 9))  # a comes again under another part
    with monkeypatch.context() as m:
        def crash(f, after):
            def g(*args, **how):
                if after:
                    f(*args, **how)
                raise Crash

            return g

        name, after = {"before rows": ("written", False), "after rows": ("written", True), "before keys": ("folder", False), "before claim": ("_claim", False), "after claim": ("_claim", True)}[step]
        if step == "before keys":
            real = Snapshots.folder
            m.setattr(Snapshots, "folder", lambda self, kind="data": (_ for _ in ()).throw(Crash()) if kind == "keys" else real(self, kind))
        else:
            m.setattr(Snapshots, name, crash(getattr(Snapshots, name), after))
        with pytest.raises(Exception):  # noqa: B017
            run()
    before = Snapshots(spark, dst).read()
    assert sorted(r.k for r in before.collect()) == (["a", "b", "c"] if step == "after claim" else ["a", "b"])
    run()
    run()
    table = Snapshots(spark, dst)
    assert sorted(tuple(r) for r in table.read().collect()) == [("a", "x", 1), ("b", "y", 2), ("c", "x", 3)]
    state = table.state()
    assert [(u["batch"], u["n_rows"]) for u in state["units"]] == [(0, 2), (1, 1)] and state["marks"] == {"ingest": 1}
    keys = spark.read.parquet(*(f"{table.path}/{f}" for f in state["keys"]))
    assert sorted(r[0] for r in keys.collect()) == ["a", "b", "c"]
    table.vacuum(keep=1)
    assert table.read().count() == 3


def test_two_streams_share_their_keys(spark, tmp_path):
    """A batch whose version was taken by another stream is made again, without the keys that came meanwhile."""
    table = Snapshots(spark, f"file://{tmp_path}/t")
    df = lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    assert publish_batch(table, df(("a", "x", 1), (None, "x", 0)), 0, "one", ["part"], "k")
    real, done = Snapshots.commit, []

    def commit(self, change, expect=None, tries=100):
        if not done:
            done.append(1)
            publish_batch(Snapshots(spark, self.path), df(("b", "y", 7), ("c", "y", 8)), 0, "two", ["part"], "k")
        return real(self, change, expect, tries)

    Snapshots.commit = commit
    try:
        assert publish_batch(table, df(("b", "x", 2), ("d", "x", 3), (None, "z", 5)), 1, "one", ["part"], "k")
    finally:
        Snapshots.commit = real
    assert sorted((tuple(r) for r in table.read().collect()), key=repr) == sorted([("a", "x", 1), (None, "x", 0), ("b", "y", 7), ("c", "y", 8), ("d", "x", 3)], key=repr)
    assert not publish_batch(table, df(("z", "x", 2)), 1, "one", ["part"], "k")
    assert publish_batch(table, df(("a", "q", 2)), 2, "one", ["part"], "k") and table.read().count() == 5


@pytest.fixture()
def units(spark, tmp_path):
    """Shards as "split=.../shard=00000/rows.parquet" with a manifest beside each, all files named alike."""
    root = tmp_path / "root dir"
    for split in ("dev", "test"):
        for i in range(2):
            folder = root / f"split={split}" / f"shard={i:05d}"
            spark.range(i * 10, i * 10 + 5 + i).coalesce(1).write.parquet(str(folder / "tmp"))
            made = next(p for p in os.listdir(folder / "tmp") if p.endswith(".parquet"))
            os.rename(folder / "tmp" / made, folder / "rows.parquet")
            for p in os.listdir(folder / "tmp"):
                os.remove(folder / "tmp" / p)
            os.rmdir(folder / "tmp")
            data = (folder / "rows.parquet").read_bytes()
            (folder / "manifest.json").write_text(json.dumps({"manifest_type": "x", "sample_start": 0, "sample_end_exclusive": 8, "shard_index": i, "parquet": {"local_path": f"split={split}/shard={i:05d}/rows.parquet", "file_sha256": hashlib.sha256(data).hexdigest(), "row_count": 5 + i}}, indent=1))
    (root / "manifest.json").write_text("{}")
    return root


def test_shards_by_their_own_paths(spark, units):
    root = f"file://{units}"
    rows = readers.verified_shards(spark, root, root, "id long", recursive=True)
    assert rows.count() == 22
    manifests = readers.shard_manifests(spark, root, recursive=True)
    assert sorted(r.unit for r in manifests.collect()) == [f"split={s}/0/8/{i}" for s in ("dev", "test") for i in range(2)]
    os.replace(units / "split=dev/shard=00001/rows.parquet", units / "split=dev/shard=00000/rows.parquet")
    wrong = sorted((r.rule, json.loads(r.row)["data_file"]) for r in readers.shard_breaks(spark, manifests, root, "id long").collect())
    assert wrong == [("missing", "split=dev/shard=00001/rows.parquet"), ("row_count", "split=dev/shard=00000/rows.parquet"), ("sha256", "split=dev/shard=00000/rows.parquet")]
    twice = manifests.unionByName(manifests.where("unit = 'split=test/0/8/0'").withColumn("data_file", F.lit(f"{root}/split=test/shard=00000/rows.parquet")))
    assert {"duplicate_data_file", "duplicate_unit"} <= {r.rule for r in readers.shard_breaks(spark, twice, root, "id long").collect()}


def test_files_of_any_size(spark, tmp_path):
    for name, size in (("a b+c", 0), ("small", 10), ("large", 100_000)):
        (tmp_path / name).write_bytes(os.urandom(size))
    want = {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in tmp_path.iterdir() if p.stat().st_size}
    for most in (1 << 30, 50, 0):
        got = {os.path.basename(r.path): r.sha256 for r in readers.file_hashes(spark, f"file://{tmp_path}", most).collect()}
        assert {k: v for k, v in got.items() if v != hashlib.sha256(b"").hexdigest()} == want


def test_a_file_beyond_two_gigabytes(spark, tmp_path):
    """Three gigabytes, of which the disk holds one piece: more than a row can."""
    path, size = tmp_path / "big", 3 << 30
    with open(path, "wb") as f:
        f.truncate(size)
        f.seek(size // 2)
        f.write(b"middle")
    whole, left = hashlib.sha256(), size
    with open(path, "rb") as f:
        while block := f.read(1 << 24):
            whole.update(block)
            left -= len(block)
    got = readers.file_hashes(spark, f"file://{path}").first()
    assert not left and (got.size_bytes, got.sha256) == (size, whole.hexdigest())
