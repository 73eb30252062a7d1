"""The divergence of sources against counting everything."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from driftlog.llm import divergence
from driftlog.llm.divergence import source_divergence
from driftlog.llm.queries import ORACLES

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows: list[tuple], least: int = 10, most: int = 10) -> set:
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = TERM.findall((text or "").translate(LOWER))
        counts[lang, source].update(terms)
        df[lang].update(set(terms))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= least]
        v, whole = len(kept), Counter()
        for s in sources:
            whole.update(counts[lang, s])
        p = lambda c, v=v, kept=kept: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * v) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        of, q = {s: p(counts[lang, s]) for s in sources}, p(whole)
        for a in sources:
            ranked = sorted(((-sum(f(of[a][t], of[b][t]) for t in kept), b.encode()) for b in sources - {a}))
            out |= {(lang, a, "pair", b.decode(), -x, i) for i, (x, b) in enumerate(ranked, 1)}
            ranked = sorted((-f(of[a][t], q[t]), t.encode()) for t in kept if counts[lang, a][t] and of[a][t] > q[t])[:most]
            out |= {(lang, a, "term", t.decode(), -x, i) for i, (x, t) in enumerate(ranked, 1)}
    return out


def corpus(seed: int) -> list[tuple]:
    """Languages of unlike sizes, a source with a third of all rows, one frequent term, capitals and other letters."""
    rng = random.Random(seed)
    out = []
    for _ in range(400):
        lang = rng.choice(["en", "en", "en", "fr", None, "", "xx"])
        source = rng.choice(["hot"] * 3 + [f"s{i}" for i in range(5)] + [None, "é"])
        words = ["the"] * rng.randint(0, 9) + [rng.choice("ABab") + f"{rng.choice('éüß漢字')}x{rng.choice('kKK')}" + rng.choice("abcdef") * rng.randint(0, 2) + rng.choice(["", "1z", "\x7f", "-q", "\n"]) for _ in range(rng.randint(0, 30))]
        out.append((" ".join(words), lang, source))
    return out + [(None, "en", "s0"), ("", "de", "s1"), (None, None, None), ("only here", "one", "s1"), ("only here", "one", "s2")] + [("Same Same row", "rep", "a")] * 10


def test_is_counting_everything(spark):
    rows = corpus(1)
    got = source_divergence(spark.createDataFrame([(i, *r, i) for i, r in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n bigint").repartition(3))
    assert [f.dataType.simpleString() for f in got.schema] == ["string"] * 4 + ["bigint", "int"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == brute(rows)


@pytest.mark.parametrize("ranges", [1, 40])
def test_cut_runs_and_small_chunks(spark, monkeypatch, ranges):
    """A run over many ranges, blocks of single texts and chunks of three terms change nothing."""
    rows = corpus(2)
    monkeypatch.setattr(divergence, "BLOCK", 1)
    monkeypatch.setattr(divergence, "CHUNK", 3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    try:
        got = {tuple(r) for r in source_divergence(spark.createDataFrame(rows, "text string, lang string, source string"), least=3, most=4).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute(rows, 3, 4)


def test_sql_is_counting_everything():
    rows = corpus(3)
    con = duckdb.connect()
    con.execute("create table documents (text varchar, lang varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", rows)
    got = con.sql("select lang, source, part, item, value, rank from (" + ORACLES["op13_source_divergence"] + ")").fetchall()
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_great_counts_stay_exact():
    c, total = np.array([0, 5, 3 * 10**10, 7 * 10**12]), np.array([10**13 + 7] * 4)
    assert divergence.share(c, total, 11).tolist() == [1 + 10**9 * (x + 2) // (10**13 + 7 + 22) for x in c.tolist()]


def test_odd_frames(spark, odd, empty):
    assert {tuple(r) for r in source_divergence(odd, least=1).collect()} == brute([(r.text, r.lang, r.source) for r in odd.collect()], 1)
    assert source_divergence(empty).count() == 0
