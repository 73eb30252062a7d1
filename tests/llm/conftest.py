"""Frames of odd documents, and plain versions of what the operators compute."""

from __future__ import annotations

import collections
import re

import pytest

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, label string, h int, n_words string, leaf int"
LONG = " ".join(f"w{i % 997}x{i % 61}" for i in range(60_000))


def words(text: str) -> list[str]:
    return WORD.findall(text or "")


def doublings(a: str, b: str, n: int) -> tuple[str, str]:
    """A Thue-Morse string of n letters and its complement."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


def shingles(text: str, k: int = 5) -> set:
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def classes(texts: dict[int, str], least: int = 800) -> dict[int, tuple[int, int]]:
    """Class and number of links of every document, by comparing all pairs that share a shingle."""
    sets, held = {d: shingles(t) for d, t in texts.items()}, collections.defaultdict(list)
    for d, s in sets.items():
        for x in s:
            held[x].append(d)
    shared = collections.Counter((a, b) for docs in held.values() for a in docs for b in docs if a != b)
    links = collections.defaultdict(set)
    for (a, b), c in shared.items():
        if c * 1000 >= least * (len(sets[a]) + len(sets[b]) - c):
            links[a].add(b)
    out = {}
    for d in sorted(texts):
        if d not in out:
            todo, seen = [d], {d}
            while todo:
                new = links[todo.pop()] - seen
                seen |= new
                todo += new
            out.update({x: min(seen) for x in seen})
    return {d: (c, len(links[d])) for d, c in out.items()}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, blank, repeated, tied and very long texts, with columns whose names operators use themselves."""
    texts = [None, "", " \n\t", "one two", "one two", "a b c d e f g h", "A\nA\nb\nA\n", LONG, LONG, "mail a.b@c.com or +1 (743) 555-3824 at 10.0.0.1", "é漢字 ▁ \U0001f600 <|endoftext|> it's", "x" * 5000]
    return spark.createDataFrame([(i, t, None if i % 3 else "en", "s", None, "z", i, "q", i) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
