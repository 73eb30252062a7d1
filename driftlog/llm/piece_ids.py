"""A worker's dictionary from pre-token to token ids, and whole texts from it."""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate, chain, pairwise, repeat

import numpy as np

#: Bytes that an entry takes besides its key and its ids.
ENTRY = 160


class IdDictionary:
    """Ids of distinct pre-tokens, by the pre-tokens' own bytes, each asked for once.

    A dictionary of more than ``most`` bytes keeps what most blocks used, in half of that, and forgets the rest.
    """

    def __init__(self, most: int = 96 << 20, flags: int = 0, coding: str = "utf-32-le") -> None:
        self.most, self.coding, self.n_flags = most, coding, flags
        self.index: dict[bytes, int] = {}
        self.held = 0
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)
        self.flags = np.zeros((0, self.n_flags), bool)
        self.filled = 0  # of ids; the arrays have room to grow
        self.bytes = np.zeros(0, np.int32)  # of each entry
        self.used = np.zeros(0, np.uint16)  # blocks that asked for it

    def _forget(self) -> None:
        n, least = len(self.index), 2
        while self.bytes[:n][self.used[:n] >= least].sum(dtype=np.int64) > self.most // 2:
            least *= 2
        kept = np.flatnonzero(self.used[:n] >= least)
        take = _ranges(self.at[kept], self.size[kept].astype(np.int64))
        keys = list(self.index)  # in the order of the entries
        self.index = {keys[i]: k for k, i in enumerate(kept.tolist())}
        self.ids, self.size, self.flags, self.bytes, self.used = self.ids[take], self.size[kept], self.flags[kept], self.bytes[kept], self.used[kept] // 2
        self.at = np.cumsum(self.size, dtype=np.int64) - self.size
        self.filled, self.held = len(self.ids), int(self.bytes.sum(dtype=np.int64))

    def _add(self, keys: list[bytes], lists: list[list[int]], flags: np.ndarray | None) -> None:
        n = len(self.index)
        sizes = np.fromiter(map(len, lists), np.int32, len(lists))
        total = int(sizes.sum())
        self.at, self.size, self.flags, self.bytes, self.used = (_room(x, n + len(keys)) for x in (self.at, self.size, self.flags, self.bytes, self.used))
        self.ids = _room(self.ids, self.filled + total)
        self.size[n : n + len(keys)] = sizes
        self.at[n : n + len(keys)] = self.filled + np.cumsum(sizes, dtype=np.int64) - sizes
        self.ids[self.filled : self.filled + total] = np.fromiter(chain.from_iterable(lists), np.uint32, total)
        if flags is not None:
            self.flags[n : n + len(keys)] = flags
        self.index.update(zip(keys, range(n, n + len(keys)), strict=True))
        self.filled += total
        own = np.fromiter(map(len, keys), np.int64, len(keys)) + 4 * sizes + ENTRY
        self.bytes[n : n + len(keys)] = np.minimum(own, 2**31 - 1)
        self.used[n : n + len(keys)] = 0
        self.held += int(own.sum())

    def gather(self, codes: np.ndarray, distinct: np.ndarray, encode: Callable[[list[str]], tuple[list[list[int]], np.ndarray | None]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all pre-tokens one after the other, how many each has, and where each is in the dictionary."""
        keys = distinct.tolist()
        if self.held > self.most:
            self._forget()
        where = self._find(keys)
        new = np.flatnonzero(where < 0)
        if len(new):
            where[new] = np.arange(len(self.index), len(self.index) + len(new))
            missing = [keys[i] for i in new.tolist()]
            self._add(missing, *encode(decoded(missing, self.coding)))
        self.used[where] += self.used[where] < 60_000
        slot = where[codes]
        sizes = self.size[slot].astype(np.int64)
        return self.ids[_ranges(self.at[slot], sizes)], sizes, slot

    def _find(self, keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.index.get, keys, repeat(-1)), np.int64, len(keys))


def decoded(keys: list[bytes], coding: str) -> list[str]:
    """Keys as texts; where all characters are of one width, by one call."""
    width = {"utf-32-le": 4}.get(coding)
    if not width:
        return [k.decode(coding) for k in keys]
    text = b"".join(keys).decode(coding)
    return [text[a:b] for a, b in pairwise(accumulate((len(k) // width for k in keys), initial=0))]


def _room(x: np.ndarray, n: int) -> np.ndarray:
    """The array, or a longer copy of it, with room for n entries."""
    if n <= len(x):
        return x
    out = np.zeros((n + n // 4, *x.shape[1:]), x.dtype)
    out[: len(x)] = x
    return out


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of the ranges, one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def sums_by(bounds: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of the values of each row, rows being given by bounds in the values."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
