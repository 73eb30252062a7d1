"""Texts as flat byte and code-point arrays, so that NumPy works on many documents at once.

Every helper takes whole texts. A block is a run of rows whose texts hold at most
``MAX_BLOCK`` bytes together (a longer text is a block of its own), which bounds the
memory of a task whatever the size of the Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from xxhash import xxh3_64_intdigest

MAX_BLOCK = 1 << 20
U64 = np.uint64

#: For Python workers: Arrow's memory comes from the C library, which hands large pieces back when they are freed.
WORKERS = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(16 << 20)}


def ship(spark) -> None:
    """Let Python workers import this package from where the driver has it.

    A cluster without a shared code folder gets the package by ``--py-files`` instead.
    """
    import os

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    env.update(WORKERS)
    have = env.get("PYTHONPATH", "")
    if root not in have.split(":"):
        env["PYTHONPATH"] = f"{root}:{have}" if have else root


def release() -> None:
    """Give freed memory back to the system: Python workers live on after a task, beside those of later stages."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def blocks(batch: pa.RecordBatch, text: str = "text", most: int = MAX_BLOCK) -> Iterator[pa.RecordBatch]:
    """Slices of a record batch, each with at most ``most`` text bytes (or one row)."""
    n = batch.num_rows
    if not n:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    lo = 0
    while lo < n:
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and where each row starts (one more at the end); null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def rows_of(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row that each position lies in."""
    return np.searchsorted(offsets, positions, "right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def span_codes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A code for each span of a byte or code-point array, and the distinct spans' bytes by code (an array of objects).

    Spans are ordered and do not overlap. Spans share a code if, and only if, their bytes are the same.
    """
    sizes = ends - starts
    if len(starts) and int(sizes.sum()) != len(symbols):  # what lies between spans goes
        step = np.zeros(len(symbols) + 1, np.int8)
        step[starts] += 1
        step[ends] -= 1
        symbols = symbols[np.cumsum(step[:-1], dtype=np.int8).view(bool)]
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(sizes * symbols.itemsize, out=offsets[1:])
    spans = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(symbols))])
    found = spans.dictionary_encode()
    return np.asarray(found.indices), found.dictionary.to_numpy(zero_copy_only=False)


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash (XXH3) of each span's bytes, made once for each distinct span; for what is compared across tasks."""
    codes, distinct = span_codes(symbols, starts, ends)
    return np.fromiter(map(xxh3_64_intdigest, distinct.tolist()), U64, len(distinct))[codes]


def ranks(values: np.ndarray) -> tuple[np.ndarray, int]:
    """A number for each integer, the same for equal ones alone, and how many numbers there are."""
    found = pa.array(values).dictionary_encode()
    return np.asarray(found.indices).astype(np.int64), len(found.dictionary)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word: a longest run without space, tab, LF, VT, FF or CR."""
    if not len(raw):
        e = np.zeros(0, np.int64)
        return e, e, e
    solid = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | edge[1:-1]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return starts, ends, rows_of(starts, offsets)


def shingles(word_hash: np.ndarray, rows: np.ndarray, n_rows: int, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every k-word shingle; a text of 1 to k - 1 words has one shingle, all its words."""
    counts = np.bincount(rows, minlength=n_rows)
    n = len(word_hash)
    short_rows = np.flatnonzero((counts > 0) & (counts < k))
    first = np.cumsum(counts) - counts
    extra = np.zeros(len(short_rows), U64)
    for i, r in enumerate(short_rows):
        h = np.zeros(1, U64)
        for j in range(first[r], first[r] + counts[r]):
            h = mix(h * U64(0x100000001B3) + word_hash[j : j + 1])
        extra[i] = h[0]
    if n >= k:
        m = n - k + 1
        h = np.zeros(m, U64)
        for j in range(k):
            h = h * U64(0x9E3779B97F4A7C15) + word_hash[j : j + m]
        same = rows[:m] == rows[k - 1 :]
        h, at = mix(h[same]), rows[:m][same]
    else:
        h, at = np.zeros(0, U64), np.zeros(0, np.int64)
    if len(short_rows):
        h, at = np.concatenate([h, extra]), np.concatenate([at, short_rows])
        order = np.argsort(at, kind="stable")
        h, at = h[order], at[order]
    return h, at


class CharClasses:
    """Class of code points as the tokenizers library's own regex engine sees them.

    Unknown code points are looked up once, in three calls for all that a block adds.
    """

    SPACE, LETTER, NUMBER, OTHER, UNKNOWN = 0, 1, 2, 3, 255

    def __init__(self) -> None:
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        self.finders = [(k, Split(Regex(p), "removed", invert=True)) for k, p in ((self.LETTER, r"\p{L}+"), (self.NUMBER, r"\p{N}+"), (self.SPACE, r"\s+"))]
        self.table = np.full(0x110000, self.UNKNOWN, np.uint8)

    def of(self, points: np.ndarray) -> np.ndarray:
        kinds = self.table[points]
        unknown = kinds == self.UNKNOWN
        if unknown.any():
            new = np.unique(points[unknown])
            text = "".join(map(chr, new))
            self.table[new] = self.OTHER
            for kind, finder in self.finders:
                for _, (a, b) in finder.pre_tokenize_str(text):
                    self.table[new[a:b]] = kind
            kinds = self.table[points]
        return kinds


def points_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts and where each text starts (one more at the end)."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32), offsets


def segments(text: str, most: int = MAX_BLOCK) -> list[str]:
    """A text in parts that no pre-token crosses: cuts lie before a blank between two characters that aren't blank."""
    if len(text) <= most:
        return [text]
    out, lo = [], 0
    while len(text) - lo > most:
        cut = lo + most
        while True:
            cut = text.find(" ", cut)
            if cut < 0 or cut + 1 >= len(text):
                cut = -1
                break
            if not text[cut - 1].isspace() and not text[cut + 1].isspace() and ord(text[cut - 1]) > 32 and ord(text[cut + 1]) > 32:
                break
            cut += 1
        if cut < 0:
            break
        out.append(text[lo:cut])
        lo = cut
    out.append(text[lo:])
    return out
