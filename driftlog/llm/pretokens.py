"""Pre-token boundaries of byte-level BPE tokenizers, found on whole blocks by array operations.

``byte_level`` follows the pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``;
``word_level`` follows ``'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+`` with the rest dropped.
"""

from __future__ import annotations

import numpy as np

from driftlog.llm.textblocks import CharClasses

_ONE = np.array([ord(c) for c in "stmd"], np.uint32)
_TWO = [tuple(map(ord, p)) for p in ("re", "ve", "ll")]


def _contractions(points: np.ndarray, last: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the apostrophes at ``heads``: those with a contraction after them, and its length. ``last``: end of each head's text."""
    n = len(points)
    a = np.where(heads + 1 < last, points[np.minimum(heads + 1, n - 1)], 0)
    b = np.where(heads + 2 < last, points[np.minimum(heads + 2, n - 1)], 0)
    one = np.isin(a, _ONE)
    two = np.zeros(len(heads), bool)
    for x, y in _TWO:
        two |= (a == x) & (b == y)
    hit = one | two
    return heads[hit], np.where(one[hit], 2, 3)


def byte_level(points: np.ndarray, offsets: np.ndarray, classes: CharClasses) -> np.ndarray:
    """Start of every pre-token; each ends where the next starts, or with its text."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes.of(points)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = np.ones(n, bool)
    start[1:] = (kind[1:] != kind[:-1]) | edge[1:n]
    # The last white space of a run before other text stands alone, or goes to that text if it is a blank.
    ws = kind == CharClasses.SPACE
    before_text = np.zeros(n, bool)
    before_text[:-1] = ws[:-1] & ~ws[1:] & ~edge[1:n]
    start |= before_text
    joined = np.zeros(n, bool)
    joined[1:] = before_text[:-1] & (points[:-1] == 32)
    start &= ~joined
    quote = np.flatnonzero(start & (points == 39))
    if len(quote):
        last = offsets[np.searchsorted(offsets, quote, "right")]
        at, length = _contractions(points, last, quote)
        start[at + 1] = False
        ends = at + length
        ends = ends[ends < n]
        start[at[length == 3] + 2] = False
        # What follows a contraction starts anew, but for a blank's text, which starts at the blank anyhow.
        start[ends] |= ~joined[ends]
    return np.flatnonzero(start)


def word_level(points: np.ndarray, offsets: np.ndarray, classes: CharClasses) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every pre-token."""
    n = len(points)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e
    kind = classes.of(points)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = np.ones(n, bool)
    start[1:] = (kind[1:] != kind[:-1]) | edge[1:n] | (kind[1:] == CharClasses.NUMBER)
    quote = np.flatnonzero(start & (points == 39))
    if len(quote):
        last = offsets[np.searchsorted(offsets, quote, "right")]
        at, length = _contractions(points, last, quote)
        start[at + 1] = False
        start[at[length == 3] + 2] = False
        ends = at + length
        start[ends[ends < n]] = True
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], n)
    keep = kind[starts] != CharClasses.SPACE
    return starts[keep], ends[keep]
