"""Near duplicates by registers against comparing everything, and the registers against their own theory."""

from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pytest

from driftlog.llm import setsketch as ss
from driftlog.llm.queries import ORACLES
from tests.llm.conftest import classes, shingles

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(texts: dict[int, str]) -> set:
    low = {d: (t or "").translate(LOWER) for d, t in texts.items()}
    found = classes(low, 850)
    return {(d, len(shingles(low[d])), found[d][0], found[d][0] == d) for d in texts}


def corpus(seed: int) -> dict[int, str]:
    """Unlike texts with a common passage, a tight group, a loose one of chains, copies, and a bridge between two groups."""
    rng = random.Random(seed)
    text = lambda n: [f"w{rng.randrange(9000)}" for _ in range(n)]
    out, passage, base, copy, loose = [], text(40), text(90), text(70), text(150)
    out += [text(rng.randint(1, 90)) + passage * (rng.random() < 0.4) for _ in range(60)]
    for _ in range(70):
        t = list(base)
        for _ in range(rng.randint(0, 2)):
            t[rng.randrange(len(t))] = f"n{rng.randrange(9)}"
        out.append(t)
    for i in range(60):  # each alike to its neighbours, the ends unlike
        loose = loose[2:] + text(2)
        out.append(loose)
        if i == 30:
            loose = loose[40:] + text(40)
    for _ in range(40):  # about 0.7 to each other
        t = list(base[::-1])
        for _ in range(4):
            t[rng.randrange(len(t))] = f"n{rng.randrange(900)}"
        out.append(t)
    out += [copy] * 30 + [[x.upper() for x in copy]] + [[], ["one"], ["ONE"], ["one", "two"], ["É"], ["é"]]
    rng.shuffle(out)
    return {i: " ".join(t) for i, t in enumerate(out)}


@pytest.mark.parametrize("seed,sizes", [(1, {}), (2, {"block": 3})])
def test_is_all_pairs(spark, seed, sizes):
    texts = corpus(seed)
    got = ss.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), **sizes)
    assert {tuple(r) for r in got.collect()} == expected(texts)
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]


def test_sql_is_all_pairs():
    texts = corpus(3)
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(texts.items()))
    assert set(con.sql(ORACLES["op11_near_duplicates"]).fetchall()) == expected(texts)


def _pair(rng, n: int, shared: float) -> tuple[np.ndarray, np.ndarray]:
    x = rng.integers(0, 2**64, 2 * n, dtype=np.uint64)
    k = round(2 * n / (1 + 1 / shared)) if shared else 0
    return ss.mix(x[:n]), ss.mix(np.concatenate([x[n - k : n], x[n : 2 * n - k]]))


def test_registers_agree_as_often_as_they_should():
    rng = np.random.default_rng(4)
    for similarity in (0.0, 0.5, 0.85):
        agree, total = 0, 0
        for _ in range(60):
            a, b = _pair(rng, 400, similarity)
            agree += int((ss.registers(a) == ss.registers(b)).sum())
            total += ss.SIZE
        p = 2 * float(ss._above(np.array(0.5 - 0.5 * similarity)))
        assert abs(agree / total - (1 - p)) < 5 * math.sqrt(p * (1 - p) / total) + 0.01


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(5)
    for n, similarity in ((300, 0.3), (1000, 0.7), (5000, 0.9), (40, 0.85)):
        a, b = _pair(rng, n, similarity)
        x, y = ss.registers(a), ss.registers(b)
        assert np.array_equal(ss.merged(x, y), ss.registers(np.union1d(a, b)))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        got = ss.estimate(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([0.5]))[0]
        assert abs(got - true) < 5 * math.sqrt(true * (1 - true) / ss.SIZE) + 0.02
        grid = np.linspace(0, 1, 2001)
        best = grid[np.argmax([ss.log_likelihood(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([0.5]), g)[0] for g in grid])]
        assert abs(best - got) < 2e-3
    assert ss.registers(np.zeros(0, np.uint64)).tolist() == [0] * ss.SIZE


def test_pairs_at_the_limit_are_not_missed():
    """By the bands with less than one in 10^5, and by the likelihood in none of a thousand, of equal and of nested sets."""
    assert ss.miss(0.85) < 1e-5
    rng = np.random.default_rng(6)
    band, likely, n = 0, 0, 1000
    for i in range(n):
        if i % 2:
            a, b = _pair(rng, 200, 0.85)
        else:
            b = ss.mix(rng.integers(0, 2**64, 200, dtype=np.uint64))
            a = b[:170]
        x, y = ss.registers(a), ss.registers(b)
        band += bool((ss.band_hashes(x[None]) == ss.band_hashes(y[None])).any())
        likely += bool(ss.open_pairs(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([len(a)]), np.array([len(b)]), 0.85)[0])
    assert band == n and likely == n


def test_odd_frames_and_ids(spark, odd, empty):
    got = {tuple(r) for r in ss.near_duplicates(odd).collect()}
    assert got == expected({r.doc_id: r.text for r in odd.collect()})
    assert ss.near_duplicates(empty).count() == 0
    text = lambda s: " ".join(f"{s}{i}" for i in range(120))
    rows = [(1, text("a")), (1, text("b")), (2, text("a") + " x"), (3, text("b") + " x"), (None, text("c")), (None, text("c") + " y"), (9, text("d")), (9, text("d")), (None, text("d")), (7, None), (None, "")]
    got = sorted((tuple(r) for r in ss.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=repr)
    want = [(1, 116, 1, True)] * 2 + [(2, 117, 1, False), (3, 117, 1, False), (None, 116, None, False), (None, 117, None, False), (9, 116, 9, True), (9, 116, 9, True), (None, 116, 9, False), (7, 0, 7, True), (None, 0, None, False)]
    assert got == sorted(want, key=repr)
