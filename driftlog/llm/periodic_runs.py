"""Runs of a repeated period in word sequences, by Lyndon words.

A run is a stretch of words that repeats with its smallest period, and that no neighbouring word
extends. Every run has a Lyndon word of its period's length under one of two opposite orders of the
words, and that word is the longest Lyndon word where it starts. So the text is scanned from right to
left with a stack of suffixes that ascend, once under each order; the length of the longest Lyndon word
at a place is the distance to the next smaller suffix. Places whose Lyndon word comes twice are extended
to both sides. Suffixes are compared, and runs extended, by the length of their common part: binary search
over rolling hashes (modulo 2^31 - 1), then the words themselves. What a distance is verified for is
kept, so the scan reads each stretch once. Any order of the words serves; codes by first occurrence do.
A run of 24 words and three periods says some 16 words twice, and is covered by the 16 words in a row that
occur twice; only the stretches that those cover are scanned, each as a text of its own.

Words are longest runs without space, tab, LF, VT, FF, CR. Null, empty and blank texts have no words and
no runs. Every row is a text of its own: rows that repeat, or lack a doc_id, have rows of their own.
Other columns are ignored. Texts are read whole; a task holds one block of texts, or one long text.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from driftlog.llm.textblocks import U64, blocks, flat, release, ship, span_codes, words

PRIME = (1 << 31) - 1
BASE = 1_103_515_245


def prefix_hashes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``code * BASE**place`` before each place, and the powers, modulo ``PRIME``."""
    n, prime = len(codes), U64(PRIME)
    powers = np.ones(n + 1, U64)
    have, step = 1, BASE
    while have < n + 1:
        more = min(have, n + 1 - have)
        powers[have : have + more] = powers[:more] * U64(step) % prime
        have, step = have + more, step * step % PRIME
    sums = np.zeros(n + 1, U64)
    np.cumsum((codes.astype(U64) + U64(1)) % prime * powers[:n] % prime, out=sums[1:])
    return sums % prime, powers


class Text:
    """A sequence of codes with its hashes, and what is known of equal words at each distance."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes, self.n = codes.astype(np.int32), len(codes)
        self.sums, self.powers = prefix_hashes(codes)
        # lists are fast to index; of a long text, arrays take a fifth of the memory
        small = self.n < 1 << 20
        self.w = self.codes.tolist() if small else array("i", self.codes.tobytes())
        self.h, self.b = (x.tolist() if small else array("Q", x.tobytes()) for x in (self.sums, self.powers))
        self.known: dict[int, tuple[int, int]] = {}  # by distance: the stretch verified last

    def same(self, i: int, j: int, size: int) -> bool:
        """Whether the hashes of the words from i and from j, i < j, are the same."""
        h = self.h
        return ((h[i + size] - h[i]) * self.b[j - i] - h[j + size] + h[j]) % PRIME == 0

    def common(self, i: int, j: int) -> int:
        """Number of words that are the same from i and from j on, i < j."""
        w, n, distance = self.w, self.n, j - i
        size, most = 0, n - j
        while size < most and size < 8:  # most suffixes differ soon
            if w[i + size] != w[j + size]:
                return size
            size += 1
        if size == most:
            return size
        start, end = self.known.get(distance, (0, 0))
        if start <= i < end:
            return end - i
        if i < start and (start - i <= size or self.same(i, j, start - i) and np.array_equal(self.codes[i:start], self.codes[j : start + distance])):
            self.known[distance] = (i, end)
            return end - i
        low, high = size, size + 1
        while high <= most and self.same(i, j, high):
            low, high = high, 2 * high
        high = min(high, most + 1)
        while high - low > 1:
            middle = (low + high) // 2
            if self.same(i, j, middle):
                low = middle
            else:
                high = middle
        differ = np.flatnonzero(self.codes[i : i + low] != self.codes[j : j + low])
        if len(differ):  # the hashes were wrong
            stop = i + int(differ[0])
        else:
            stop = i + low
            while stop + distance < n and w[stop] == w[stop + distance]:
                stop += 1
        self.known[distance] = (i, stop)
        return stop - i

    def common_back(self, i: int, j: int) -> int:
        """Number of words that are the same before i and before j, i < j."""
        w, distance = self.w, j - i
        low, high = 0, 1
        while high <= i and self.same(i - high, j - high, high):
            low, high = high, 2 * high
        high = min(high, i + 1)
        while high - low > 1:
            middle = (low + high) // 2
            if self.same(i - middle, j - middle, middle):
                low = middle
            else:
                high = middle
        differ = np.flatnonzero(self.codes[i - low : i] != self.codes[i - low + distance : i + distance])
        if len(differ):
            return low - int(differ[-1]) - 1
        while low < i and w[i - low - 1] == w[j - low - 1]:
            low += 1
        return low

    def lyndon_ends(self, up: bool) -> list | array:
        """The end of the longest Lyndon word at every place: where the next smaller suffix starts."""
        w, n = self.w, self.n
        ends = [0] * n if n < 1 << 20 else array("i", bytes(4 * n))
        self.known.clear()
        for i in range(n - 1, -1, -1):
            here, j = w[i], i + 1
            while j < n:
                there = w[j]
                if here == there:
                    size = 1 if j + 1 < n and w[i + 1] != w[j + 1] else self.common(i, j)
                    if j + size == n:  # the suffix that ends first is the smaller one
                        break
                    if (w[i + size] > w[j + size]) == up:
                        break
                elif (here > there) == up:
                    break
                j = ends[j]
            ends[i] = j
        return ends


def repeated(codes: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Stretches, from and to, that are covered by ``size`` codes in a row which occur twice or more."""
    n, prime = len(codes), U64(PRIME)
    if n < size + 1:
        return []
    sums, powers = prefix_hashes(codes)
    m = n - size + 1
    values = (sums[size:] + prime - sums[:m]) % prime * powers[m - 1 :: -1][:m] % prime
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return []
    edge = np.zeros(n + 1, np.int64)
    twice = np.zeros(m, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge[:m] += twice
    edge[size:] -= twice
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = np.cumsum(edge[:-1]) > 0
    bounds = np.flatnonzero(inside[1:] != inside[:-1])
    return list(zip(bounds[::2].tolist(), bounds[1::2].tolist(), strict=True))


def runs(codes: np.ndarray, least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs of at least ``max(least, times * period)`` words, ``times`` at least 3, by start and period."""
    # A run of period q has max(least, times * q) - q words or more that come again q words later.
    size = min(max(least, times * q) - q for q in range(1, least // times + 2))
    return [(lo + s, n, p) for lo, hi in repeated(codes, size) if hi - lo >= least for s, n, p in _runs(codes[lo:hi], least, times)]


def _runs(codes: np.ndarray, least: int, times: int) -> list[tuple[int, int, int]]:
    text, found = Text(codes), set()
    n, prime = text.n, U64(PRIME)
    for up in (True, False):
        ends = np.array(text.lyndon_ends(up), np.int64)
        at = np.flatnonzero(2 * ends - np.arange(n) <= n)  # the word, and its length once more, lie in the text
        j = ends[at]
        period = j - at
        # the Lyndon word comes twice in a row: the first of a run's three times does
        twice = (text.sums[j] + prime - text.sums[at]) % prime * text.powers[period] % prime == (text.sums[j + period] + prime - text.sums[j]) % prime
        seen: dict[int, int] = {}  # by period: end of the last run
        for i, p in zip(at[twice].tolist(), period[twice].tolist(), strict=True):
            if i < seen.get(p, 0) - p:  # within a run that is known
                continue
            text.known.clear()
            length = p + text.common(i, i + p)
            back = text.common_back(i, i + p)
            if length < 2 * p:  # not twice after all
                continue
            seen[p] = i + length
            if back + length >= max(least, times * p):
                found.add((i - back, back + length, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def digest(codes: np.ndarray, names: np.ndarray, found: list[tuple[int, int, int]]) -> tuple:
    """Number of runs, the run that repeats most, its exponent in thousandths, and hashes of all runs and of the words kept."""
    drop = np.zeros(len(codes) + 1, np.int64)
    best = None
    for start, length, period in found:
        drop[start + period] += 1
        drop[start + length] -= 1
        # ties: the smaller start, then the smaller period, as runs are ordered by them
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    kept = codes[np.cumsum(drop[:-1]) == 0] if found else codes
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(found), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(names[kept].tolist())).hexdigest()


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The words, by number, that a tenth of the documents have instead of their own: a period from some word on."""
    if doc_id is None or not n:
        return None
    h = crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return at


COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3, change: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """``(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256)`` of every row.

    The four between are those of the run with the greatest length in periods (ties: smallest start,
    then period), null without runs. ``collapsed_sha256`` is of the words, joined by blanks, without those
    that stand after the first period of a run. ``change`` may give numbers of words to take instead of
    0 to n - 1, from doc_id and n.
    """
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                raw, offsets = flat(part.column("text"))
                starts, ends, rows = words(raw, offsets)
                codes, names = span_codes(raw, starts, ends)
                bounds = np.searchsorted(rows, np.arange(part.num_rows + 1))
                out = []
                for doc_id, a, b in zip(part.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    own = codes[a:b]
                    at = change(doc_id, b - a) if change else None
                    own = own if at is None else own[at]
                    out.append(digest(own, names, runs(own, least, times)))
                arrays = [pa.array(x, pa.int64() if i < 5 else pa.string()) for i, x in enumerate(zip(*out, strict=True))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays], ["doc_id", *COLUMNS])
        release()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} {'long' if i < 5 else 'string'}" for i, c in enumerate(COLUMNS)))


def runs_table(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """``(doc_id, start, length, period)``: every run of every row, a row each."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                raw, offsets = flat(part.column("text"))
                starts, ends, rows = words(raw, offsets)
                codes, _ = span_codes(raw, starts, ends)
                bounds = np.searchsorted(rows, np.arange(part.num_rows + 1))
                row, out = [], []
                for r in range(part.num_rows):
                    found = runs(codes[bounds[r] : bounds[r + 1]], least, times)
                    row += [r] * len(found)
                    out += found
                if out:
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), *(pa.array(x, pa.int64()) for x in zip(*out, strict=True))], ["doc_id", "start", "length", "period"])
        release()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, period long")


def collapse(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """The documents, the repeats of every run left out of their texts; a text without runs stays as it is, one with runs has single blanks."""
    ship(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                raw, offsets = flat(part.column("text"))
                starts, ends, rows = words(raw, offsets)
                codes, names = span_codes(raw, starts, ends)
                bounds = np.searchsorted(rows, np.arange(part.num_rows + 1))
                texts = part.column("text").to_pylist()
                for r in range(part.num_rows):
                    own = codes[bounds[r] : bounds[r + 1]]
                    if found := runs(own, least, times):
                        drop = np.zeros(len(own) + 1, np.int64)
                        for s, n, p in found:
                            drop[s + p] += 1
                            drop[s + n] -= 1
                        texts[r] = b" ".join(names[own[np.cumsum(drop[:-1]) == 0]].tolist()).decode()
                yield part.set_column(at, "text", pa.array(texts, part.schema.field("text").type))
        release()

    return docs.mapInArrow(run, docs.schema)
