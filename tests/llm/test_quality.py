"""Quality rules and classifier."""

from __future__ import annotations

import collections
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from driftlog.llm import quality_classifier as qc
from driftlog.llm import quality_rules as qr
from driftlog.llm.textblocks import flat
from tests.llm.conftest import doublings, words

DATA = "/root/testdata/sf0.01"


def plain(text: str) -> tuple:
    """The base statistics, counted one by one."""
    w = words(text)
    triples = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + j for i in range(len(w) - 2) if triples[tuple(w[i : i + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_statistics_are_the_plain_ones(spark, odd):
    texts = ["", "\n\n", "a b c a b c", "x\n\nx\n x\nx ", "é é é é", " \n", "a\x0bb\x0cc", "ÀÉ × Z", None, *(r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(150).collect())]
    got = qr.statistics(*flat(pa.array(texts)))
    assert [tuple(int(got[c][i]) for c in qr.BASE) for i in range(len(texts))] == [plain(t) for t in texts]
    assert int(got["n_upper"][7]) == 3


def test_statistics_tell_complementary_doublings_apart():
    """Lines and words on which polynomial hashes modulo 2^64 collide."""
    texts = []
    for n in (1024, 2048):
        a, b = doublings("a", "q", n)
        texts += [f"{a}\n{b}\n{a}", f"x {a} y x {b} y", f"x {a} y x {a} y", f"{a} {b} {a} {b}"]
    got = qr.statistics(*flat(pa.array(texts)))
    assert [tuple(int(got[c][i]) for c in qr.BASE) for i in range(len(texts))] == [plain(t) for t in texts]


def test_rules_learn_thresholds():
    rng = np.random.default_rng(0)
    x = {"a": rng.random(900), "b": rng.random(900)}
    bad = (x["a"] > 0.8) | ((x["b"] < 0.3) & (x["a"] < 0.2))
    rules = qr.learn(x, bad)
    hit = np.zeros(900, bool)
    for rule in rules:
        m = np.ones(900, bool)
        for c in rule:
            m &= c.holds(x[c.feature])
        hit |= m
    assert (hit & bad).sum() > 0.95 * bad.sum() and (hit & ~bad).sum() < 0.02 * (~bad).sum()
    assert qr.learn(x, np.zeros(900, bool)) == [] and qr.learn({"a": np.zeros(9)}, np.arange(9) % 2 == 0) == []


def test_rules_on_documents(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    rules = qr.fit(docs, labels)
    rows = qr.judge(docs, rules).join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()
    share = {r.quality: r.kept for r in rows}
    assert share[1] > 0.97 and share[0] < 0.2
    kept = qr.keep(docs, rules)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in qr.judge(docs, rules).where("kept").collect()}


def test_rules_of_odd_frames(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert qr.fit(odd, none) == []
    rules = [[qr.Condition("repeat_share", True, 0.99)]]
    rows = {r.doc_id: r for r in qr.judge(odd, rules).collect()}
    for r in odd.collect():
        want = plain(r.text)
        assert tuple(rows[r.doc_id][c] for c in qr.BASE) == want
        assert rows[r.doc_id].base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    kept = qr.keep(odd, [])
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == sorted(d for d, r in rows.items() if not r.base_failed)
    assert qr.judge(empty, rules).count() == 0 == qr.keep(empty, rules).count()


def test_classifier_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = qc.fit(docs, labels.where(fold != 1))
    rows = qc.score(docs, model).join(labels.where(fold == 1), "doc_id").toPandas()
    for label in (0, 1):
        mine = rows[rows.quality == label]
        assert (mine.predicted == label).mean() > 0.9
    assert rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= 0.5)).all()


def test_classifier_finds_what_divides():
    rng = np.random.default_rng(1)
    rows, y = [], []
    for i in range(400):
        label = int(rng.random() < 0.7)
        rows.append(np.unique(np.concatenate([rng.integers(0, 500, 30), [600 if label else 601]])))
        y.append(label)
    model = qc.train(rows, np.array(y))
    p = model.scores(np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])]))
    assert ((p >= 0.5) == np.array(y)).all()


def test_classifier_of_odd_frames(spark, odd, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id bigint, quality int, toxic int")
    rows = {r.doc_id: r.score for r in qc.score(odd, qc.fit(odd, labels)).collect()}
    assert len(rows) == 12 and all(0 <= s <= 1 for s in rows.values())
    assert rows[0] == rows[1] and rows[3] == rows[4] and rows[7] == rows[8]
    none = qc.fit(odd, labels.where("false"))
    assert {r.predicted for r in qc.score(odd, none).collect()} == {1}
    assert qc.score(empty, none).count() == 0


def _indicators(text: str) -> set[int]:
    """Features of a text, one by one."""
    raw, out = (text or "").encode(), set()
    for a, b, c in zip(raw, raw[1:], raw[2:], strict=False):
        out.add(((a << 16 | b << 8 | c) * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - qc.BITS))
    w, shapes = re.findall(rb"[^\x20\x09-\x0d]+", raw), []
    for i, x in enumerate(w):
        size = sum(len(x) >= n for n in (3, 6, 10, 16))
        upper, digit = min(sum(65 <= c <= 90 for c in x), 2), any(48 <= c <= 57 for c in x)
        tail = next((k for k, s in ((1, b"#*$%&"), (2, b"|"), (3, b"!"), (4, b".,;:?")) if x[-1] in s), 0)
        again = 1 if i and w[i - 1] == x else 2 if i > 1 and w[i - 2] == x else 0
        shapes.append((((size * 3 + upper) * 2 + digit) * 5 + tail) * 3 + again)
    for k in (1, 2, 3):
        for i in range(len(shapes) - k + 1):
            gram = 0
            for s in shapes[i : i + k]:
                gram = gram * 1009 + s + 1
            out.add(int(qc.mix(np.array([gram + (k << 40)], np.uint64))[0]) & ((1 << qc.BITS) - 1))
    return out


def test_scores_are_the_plain_ones(spark, odd):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = qc.fit(docs, labels)
    rows = [(r.doc_id, r.text) for r in odd.where("length(text) < 9000 or text is null").collect()] + [(1000 + r.doc_id, r.text) for r in docs.limit(80).collect()]
    got = {r.doc_id: (r.score, r.predicted) for r in qc.score(spark.createDataFrame(rows, "doc_id bigint, text string"), model).collect()}
    for d, text in rows:
        f = sorted(_indicators(text))
        margin = (float(model.weights[f].astype(float).sum()) + model.bias) / np.sqrt(1 + float(model.squares[f].astype(float).sum()))
        want = 1 / (1 + np.exp(-(model.slope * margin + model.shift)))
        assert abs(got[d][0] - want) < 1e-6 and got[d][1] == int(got[d][0] >= 0.5)


def test_training_samples_are_bounded_and_take_an_id_once(spark):
    """A repeated doc_id is one document, and fewer rows are used where their indicators pass the bound."""
    text = lambda i: ("good plain words " if i % 2 else "BAD !!! ### ") * (3 + i % 5)
    docs = [(i, text(i)) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id bigint, quality int")
    once, more = (spark.createDataFrame(x, "doc_id bigint, text string") for x in (docs, docs + docs[:1] * 50 + [(None, "x")]))
    a, b = qc.fit(once, labels), qc.fit(more, labels)
    assert (a.weights == b.weights).all() and a.bias == b.bias
    assert qr.fit(once, labels) == qr.fit(more, labels)
    assert not (qc.fit(once, labels, max_features=300).weights == a.weights).all()
