"""The Jaccard join, components and decontamination, against comparing everything."""

from __future__ import annotations

import os
import random
import re

import numpy as np
import pytest

from driftlog.llm import decontamination, staging
from driftlog.llm.components import components
from driftlog.llm.decontamination import clean, contained
from driftlog.llm.jaccard_join import SIZE, _survival, children, jaccard_join
from driftlog.llm.staging import shared_folder
from tests.llm.conftest import classes, doublings

DATA = "/root/testdata/sf0.001"


def _texts(seed: int) -> dict[int, str]:
    """Unlike texts, one passage in many, a group of near copies and one of copies."""
    rng = random.Random(seed)
    text = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    out, passage, base, copy = [], text(40), text(80), text(70)
    for _ in range(60):
        out.append(text(rng.randint(1, 90)) + passage * (rng.random() < 0.4))
    for _ in range(70):
        t = list(base)
        for _ in range(rng.randint(0, 2)):
            t[rng.randrange(len(t))] = f"n{rng.randrange(9)}"
        out.append(t)
    out += [copy] * 30 + [[], ["one"], ["one"], ["one", "two"]]
    rng.shuffle(out)
    return {i: " ".join(t) for i, t in enumerate(out)}


@pytest.mark.parametrize("sizes", [{}, {"block": 16}, {"depth": 1, "block": 7}])
def test_join_is_all_pairs(spark, sizes):
    texts = _texts(1)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), **sizes).collect()}
    want = classes(texts)
    wrong = [d for d in want if got[d] != want[d]]
    assert len(got) == len(texts) and len(wrong) <= 1, [(d, got[d], want[d]) for d in wrong]  # recall is 0.999 a pair


def test_pairs_share_leaves_as_often_as_promised():
    """Pairs of token rows that agree in a share of places, each from a root of its own, against the chance that runs are counted by."""
    rng = np.random.default_rng(5)
    for agreement, depth in ((0.8, 3), (0.7, 2), (0.9, 1)):
        a = rng.integers(0, 2**32, (4000, SIZE), dtype=np.uint32)
        b = np.where(rng.random(a.shape) < agreement, a, rng.integers(0, 2**32, a.shape, dtype=np.uint32))
        leaves = []
        for tokens in (a, b):
            rows, node = np.arange(len(tokens)), np.arange(1, len(tokens) + 1, dtype=np.uint64)
            for _ in range(depth):
                at, node = children(node, tokens[rows], 0.8)
                rows = rows[at]
            leaves.append(set(zip(rows.tolist(), node.tolist(), strict=True)))
        assert abs(len(leaves[0]) / len(a) - 1.25**depth) < 0.1
        shared = len({r for r, _ in leaves[0] & leaves[1]}) / len(a)
        assert abs(shared - _survival(depth, 0.8, agreement)) < 0.03


def test_join_of_odd_frames(spark, odd, empty):
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join(odd).collect()}
    assert got == classes({r.doc_id: r.text or "" for r in odd.collect()})
    assert jaccard_join(empty).count() == 0


def test_rows_of_one_id_or_none_are_documents_of_their_own(spark):
    """Two texts under one id, whose like ones stand under others; null ids; rows repeated as they are."""
    text = lambda s: " ".join(f"{s}{i}" for i in range(120))
    rows = [(1, text("a")), (1, text("b")), (2, text("a") + " x"), (3, text("b") + " x"), (None, text("c")), (None, text("c")), (None, text("c") + " y"), (9, text("d")), (9, text("d")), (None, text("d")), (7, None), (None, ""), (None, "one")]
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard_join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=repr)
    want = [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (9, 9, 2), (9, 9, 2), (None, 9, 2), (None, None, 2), (None, None, 2), (None, None, 2), (7, 7, 0), (None, None, 0), (None, None, 0)]
    assert got == sorted(want, key=repr)


def test_words_that_collide_in_polynomials_are_told_apart(spark):
    a, b = doublings("a", "q", 1024)
    texts = {1: f"{a} x {a} y {a} z {a}", 2: f"{b} x {b} y {b} z {b}", 3: f"{a} x {a} y {a} z {a}"}
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()}
    assert got == {1: (1, 1), 2: (2, 0), 3: (1, 1)}


def test_intermediate_tables_are_removed(spark, odd):
    folder = shared_folder(spark, "x").rpartition("/")[0].removeprefix("file://")
    jaccard_join(odd).count()
    assert not [x for x in os.listdir(folder) if x.startswith("jaccard")]


def test_components_are_union_find(spark):
    rng = random.Random(2)
    edges = [(a, a + 1) for a in range(0, 60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)] + [(500, x) for x in range(501, 560)]
    root: dict[int, int] = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def _brute(docs: dict[int, str], items: dict[int, str], least: float = 0.8):
    norm = lambda t: [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
    out = set()
    for i, t in items.items():
        w = norm(t)
        k = min(5, len(w))
        s = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if k else set()
        for d, text in docs.items():
            v = norm(text)
            n = len(s & {tuple(v[j : j + k]) for j in range(len(v) - k + 1)}) if k else 0
            if s and n * 1000 >= len(s) * least * 1000:
                out.add((d, i, n, len(s)))
    return out


def test_contained_is_all_pairs(spark):
    rng = random.Random(7)
    text = lambda n: " ".join(f"w{rng.randrange(800)}" for _ in range(n))
    items = {i: text(n) for i, n in enumerate([1, 2, 3, 4, 5, 6, 12, 14, 20, 30, 33, 47, 60, 100, 180])}
    items |= {90: "", 91: None, 92: " .,; "}
    docs = {}
    for d in range(120):
        body = [text(rng.choice([0, 3, 200, 2000]))]
        if d % 2:
            w = (items[rng.choice(range(15))] or "").split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = "other"
            body += [" ".join(w).upper() if d % 3 else ", ".join(w), text(rng.choice([0, 500]))]
        docs[d] = " ".join(body)
    docs |= {500: None, 501: "", 502: "!!", 503: docs[1]}
    got = contained(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"), spark.createDataFrame(list(items.items()), "item_id bigint, text string"))
    assert {(r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in got.collect()} == _brute(docs, items)


def test_item_beside_repeated_lines_is_found(spark):
    """Copies of a line's hashes must not fill the signatures of the windows that hold the item."""
    items = {i: " ".join(f"i{i}w{j}" for j in range(40)) for i in range(20)}
    docs = {i: " ".join([f"r{i}\n"] * 100 + [items[i % 20]] + [f"r{i}\n"] * 100) for i in range(400)}
    got = contained(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"), spark.createDataFrame(list(items.items()), "item_id bigint, text string"))
    assert {(r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in got.collect()} == _brute(docs, items)


def test_contained_without_broadcast_and_of_odd_frames(spark, odd, empty):
    items = spark.createDataFrame([(1, "a b c d e f g"), (2, "one two"), (2, "one two"), (3, None)], "item_id bigint, text string")
    want = {(5, 1), (3, 2), (4, 2)}
    assert {(r.doc_id, r.item_id) for r in contained(odd, items).collect()} == want
    assert {(r.doc_id, r.item_id) for r in contained(odd, items, limit=0).collect()} == want
    left = clean(odd, items)
    assert left.columns == odd.columns and {r.doc_id for r in left.collect()} == {r.doc_id for r in odd.collect()} - {3, 4, 5}
    assert contained(empty, items).count() == 0 and contained(odd, empty.selectExpr("doc_id as item_id", "text")).count() == 0


def test_rows_of_one_id_are_one_document(spark):
    """An item in two rows of a document; items of one id, of like and unlike lengths; rows without ids."""
    item = [f"i{j}" for j in range(14)]
    half = " ".join(item[:9]), " ".join(item[5:])
    docs = [(1, "x y " + half[0]), (1, half[1] + " z"), (2, half[0]), (3, " ".join(item)), (None, " ".join(item)), (4, "p q r s t u v"), (4, "one two three"), (5, "p q r s t u v")]
    items = [(7, " ".join(item)), (8, "p q r s t u v"), (8, "one two three"), (None, "x y")]
    got = contained(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {(r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in got.collect()} == {(1, 7, 10, 10), (3, 7, 10, 10), (4, 8, 4, 4)}


def test_search_has_no_python(spark, monkeypatch):
    """Neither in the result nor in the tables between."""
    plans = []
    monkeypatch.setattr(staging, "staged", lambda df, *a, f=staging.staged: (plans.append(df._jdf.queryExecution().executedPlan().toString()), f(df, *a))[1])
    monkeypatch.setattr(decontamination, "staged", staging.staged)
    docs, items = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    plans.append(contained(docs, items)._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 3 and not re.search("Python|Pandas|Arrow", "".join(plans))
