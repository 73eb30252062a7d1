"""Runs by Lyndon words against trying every period."""

from __future__ import annotations

import hashlib
import random
from fractions import Fraction
from zlib import crc32

import numpy as np
import pytest

from driftlog.llm import periodic_runs as pr
from tests.llm.conftest import doublings, words


def brute(w: list, least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """For each period, the longest stretches of equal words at that distance, but those that have a smaller period."""
    n, found = len(w), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(least, times * q) and not any(s0 <= s and s0 + n0 >= i + q for s0, n0, p0 in found.values() if q % p0 == 0):
                found[s, i + q - s] = (s, i + q - s, q)
    return sorted(found.values(), key=lambda r: (r[0], r[2]))


def expected(doc_id, text, change=None) -> tuple:
    w = words(text)
    if change is not None:
        w = change(doc_id, w)
    found = brute(w)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    drop = {i for s, n, p in found for i in range(s + p, s + n)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *top, sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def plant(doc_id, w: list) -> list:
    if doc_id is None or not w or crc32(str(doc_id).encode()) % 10:
        return w
    g, n = crc32(str(doc_id).encode()) // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def samples(seed: int):
    """Words of few letters, periods within periods, broken periods, Fibonacci words, one word alone."""
    rng = random.Random(seed)
    for size in (2, 3, 5):
        for _ in range(30):
            w: list = []
            while len(w) < rng.randint(1, 250):
                p = [rng.randrange(size) for _ in range(rng.randint(1, 12))]
                w += p * rng.randint(1, 9)
                if rng.random() < 0.3:
                    w += w[-rng.randint(1, 40) :] * rng.randint(1, 4)
            yield w
    a, b = [0], [0, 1]
    while len(b) < 300:
        a, b = b, b + a
    yield from (b, [7] * 400, [7] * 23, [7] * 24, [1] + [7] * 30 + [2], [], [1, 2, 3] * 8, [1, 2, 3] * 8 + [1], list(range(100)) * 3, list(range(100)) * 2)


@pytest.mark.parametrize("limits", [(24, 3), (1, 3), (1, 4)])
def test_runs_are_those_of_every_period(limits):
    for w in samples(3):
        codes = np.array(w, np.int64)
        assert pr.runs(codes, *limits) == brute(w, *limits), w


def test_wrong_hashes_are_found_out(monkeypatch):
    """With hashes that collide often, the words themselves decide."""
    monkeypatch.setattr(pr, "PRIME", 5)
    monkeypatch.setattr(pr, "BASE", 2)
    for w in samples(4):
        assert pr.runs(np.array(w, np.int64)) == brute(w), w


def test_hashes_are_polynomials():
    codes = np.random.default_rng(1).integers(0, 2**31 - 3, 1000)
    sums, powers = pr.prefix_hashes(codes)
    total = 0
    for i, c in enumerate(codes.tolist()):
        assert int(sums[i]) == total and int(powers[i]) == pow(pr.BASE, i, pr.PRIME)
        total = (total + (c + 1) * pow(pr.BASE, i, pr.PRIME)) % pr.PRIME


def test_long_texts_take_no_square_time():
    n = 300_000
    for w in (np.zeros(n, np.int64), np.arange(n) % 1000, np.array([c == "a" for c in doublings("a", "q", 1 << 17)[0]], np.int64), np.arange(n) // 2 % 2):
        found = pr.runs(w)
        assert len(found) == (0 if len(w) != n else 1)
        if found:
            assert found[0][:2] == (0, n)


def test_query_rows(spark, odd, empty):
    rng = random.Random(9)
    texts = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(200)))) for i in range(200)]
    texts += [(i, " ".join([f"a{i}", "b", "c d"] * rng.randint(1, 20)) + "\n" + "x\t" * rng.randint(0, 40)) for i in range(200, 260)]
    texts += [(5, "one two " * 30), (5, "one two " * 30), (None, "z " * 50), (None, None)]
    got = pr.periodic_runs(spark.createDataFrame(texts, "doc_id bigint, text string"), change=pr.planted)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(expected(d, t, plant)) for d, t in texts)
    assert sum(crc32(str(d).encode()) % 10 == 0 for d, _ in texts) > 10
    rows = {r.doc_id: tuple(r) for r in pr.periodic_runs(odd).collect()}
    for r in odd.where("doc_id not in (7, 8)").collect():  # those are long, and have a period of their own
        assert rows[r.doc_id] == expected(r.doc_id, r.text)
    assert rows[7][1:] == rows[8][1:] and pr.periodic_runs(empty).count() == 0


def test_table_and_collapse(spark, odd):
    docs = spark.createDataFrame([(1, "a  b " * 20 + "end", 3), (None, "x\ny z", 4), (2, None, 5), (3, "go " * 30, None)], "doc_id bigint, text string, leaf int")
    assert sorted(tuple(r) for r in pr.runs_table(docs).collect()) == [(1, 0, 40, 2), (3, 0, 30, 1)]
    assert [tuple(r) for r in pr.collapse(docs).collect()] == [(1, "a b end", 3), (None, "x\ny z", 4), (2, None, 5), (3, "go", None)]
    assert pr.collapse(odd).columns == odd.columns and pr.collapse(odd).count() == odd.count()
