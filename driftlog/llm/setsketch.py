"""Near-duplicate documents by SetSketch registers.

A document's set are its distinct 5-word shingles, A to Z in lower case. Each of ``SIZE`` registers holds the
least of the set's exponential variates (one for each element and register, of rate ``RATE`` a
element), written as the integer steps of a scale with base ``BASE`` and cut off at 0 and ``TOP``: a
register of a union is the greater of the registers. Registers of two sets agree, or one lies above, with
chances that follow from the similarity and both sizes, so that counts of the three cases give it by maximum
likelihood.

Sets that are the same are one. Bands of ``WIDTH`` registers put sets into buckets. First every set of a
bucket is compared with the bucket's least set, and where a bucket still holds unlike components with ``DRAWN``
sets drawn by hashes, which settles groups that hang together with a few comparisons a set; then, in buckets that
hold unlike components even so, sets of unlike components are compared, those outside the largest
component with all others, in blocks of bounded size. A pair is put up for
verification by its first common band alone, unless its likelihood says that it is too unlike; all pairs that
are put up are verified on the whole sets, where both blocks are; only a spanning forest leaves the task. As links between sets of one component do not change the components, none is lost.

Words are longest runs without space, tab, LF, VT, FF, CR. With fewer words than ``k`` the whole sequence is the one
shingle. Null texts and texts without words have empty sets and are linked with nothing. Every row is a
document of its own: rows that repeat a doc_id, or lack one, are linked by their texts as all others. Other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlog.llm.components import components
from driftlog.llm.jaccard_join import _groups, _shared
from driftlog.llm.staging import Tables, semi_join, staged
from driftlog.llm.textblocks import U64, blocks, flat, mix, release, shingles, ship, span_hashes, words

SIZE, BASE, RATE, TOP = 256, 1.1, 20.0, 255
WIDTH = 7
BANDS = SIZE // WIDTH
#: A pair is dropped unseen if the best likelihood is so many times, as a logarithm, that of the least similarity.
MARGIN = 10.0

DRAWN = 6

_FACTORS = np.random.default_rng(29).integers(1, 2**63, SIZE, dtype=U64) * U64(2) + U64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def sets_of(raw: np.ndarray, offsets: np.ndarray, k: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a block, A to Z in lower case."""
    raw, n = np.take(_LOWER, raw), len(offsets) - 1
    starts, ends, rows = words(raw, offsets)
    h, at = shingles(span_hashes(raw, starts, ends), rows, n, k)
    bounds = np.searchsorted(at, np.arange(n + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        yield np.unique(h[a:b])


def registers(hashes: np.ndarray) -> np.ndarray:
    """The registers (uint8) of a set; zeros of the empty set."""
    if not len(hashes):
        return np.zeros(SIZE, np.uint8)
    low = np.full(SIZE, 2**64 - 1, U64)
    for lo in range(0, len(hashes), 4096):
        np.minimum(low, (hashes[None, lo : lo + 4096] * _FACTORS[:, None]).min(axis=1), out=low)
    # the least of uniform variates, as an exponential one of the same rank
    least = -np.log1p(-(low.astype(np.float64) + 1) / 2.0**64 * (1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(least) / math.log(BASE)), 0, TOP).astype(np.uint8)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def _above(x: np.ndarray) -> np.ndarray:
    """Chance that a register lies above the other's, of a set that has this share of both sizes outside the other."""
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)


def log_likelihood(above: np.ndarray, below: np.ndarray, share: np.ndarray, similarity: np.ndarray | float, size: int = SIZE) -> np.ndarray:
    """Of a similarity, from how many registers of the first set lie above and below; ``share``: the first's size over both."""
    p, q = _above(share - (1 - share) * similarity), _above(1 - share - share * similarity)
    tiny = 1e-300
    return above * np.log(np.maximum(p, tiny)) + below * np.log(np.maximum(q, tiny)) + (size - above - below) * np.log(np.maximum(1 - p - q, tiny))


def estimate(above: np.ndarray, below: np.ndarray, share: np.ndarray, steps: int = 24) -> np.ndarray:
    """Similarity of greatest likelihood. The logarithm is concave, so thirds of the range close in on it."""
    least = np.minimum(share, 1 - share)
    low, high = np.zeros(len(share)), least / np.maximum(1 - least, 1e-300)
    for _ in range(steps):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        up = log_likelihood(above, below, share, a) < log_likelihood(above, below, share, b)
        low, high = np.where(up, a, low), np.where(up, high, b)
    return (low + high) / 2


def open_pairs(above: np.ndarray, below: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, similarity: float) -> np.ndarray:
    """Pairs that may be as alike as ``similarity``, by their sizes and the likelihood of their registers."""
    share = n_a / np.maximum(n_a + n_b, 1)
    best = estimate(above, below, share)
    may = np.minimum(n_a, n_b) * 1000 >= round(similarity * 1000) * np.maximum(n_a, n_b)
    gap = log_likelihood(above, below, share, best) - log_likelihood(above, below, share, np.maximum(best, similarity))
    return may & (gap <= MARGIN)


def miss(similarity: float) -> float:
    """Chance that two sets of one size and this similarity share no band."""
    p = float(_above(np.array(0.5 - 0.5 * similarity)))
    return (1 - (1 - 2 * p) ** WIDTH) ** BANDS


def describe(rows: DataFrame, k: int) -> DataFrame:
    """``(doc_id, row, lo, hi, n, registers)``: two hashes of the set, its size and registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text", 1 << 19):
                lo, hi, n, reg = [], [], [], []
                for s in sets_of(*flat(part.column("text")), k):
                    lo.append(int(mix(s).sum()))
                    hi.append(int(mix(s ^ U64(0x5851F42D4C957F2D)).sum()))
                    n.append(len(s))
                    reg.append(registers(s).tobytes() if len(s) else None)
                hashes = [pa.array(np.array(x, U64).view(np.int64)) for x in (lo, hi)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), *hashes, pa.array(n, pa.int64()), pa.array(reg, pa.binary())], ["doc_id", "row", "lo", "hi", "n", "registers"])
        release()

    return rows.mapInArrow(run, "doc_id long, row long, lo long, hi long, n long, registers binary")


def band_hashes(reg: np.ndarray) -> np.ndarray:
    """(sets, BANDS) hashes of the bands' registers; the band is part of the hash."""
    h = np.tile(np.arange(1, BANDS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15), (len(reg), 1))
    for j in range(WIDTH):
        h = mix(h * U64(0x100000001B3) + reg[:, j : BANDS * WIDTH : WIDTH].astype(U64))
    return h


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SIZE)


def _bands(sets: DataFrame) -> DataFrame:
    """``(key, band, set_id)``: the buckets of every set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                keys = band_hashes(_matrix(part.column("registers")))
                ids = np.repeat(np.asarray(part.column("set_id")), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), part.num_rows)), pa.array(ids)], ["key", "band", "set_id"])
        release()

    return sets.select("set_id", "registers").mapInArrow(run, "key long, band int, set_id long")


def _likely(similarity: float):
    """Pairs of rows with both registers and sizes that are not too unlike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                x, y = _matrix(part.column("registers_a")), _matrix(part.column("registers_b"))
                keep = open_pairs((x > y).sum(axis=1), (x < y).sum(axis=1), np.asarray(part.column("n_a")), np.asarray(part.column("n_b")), similarity)
                yield part.select(["a", "b"]).filter(pa.array(keep))
        release()

    return run


BUCKET = ["key", "block_a", "block_b"]


def _owned(batch: pa.RecordBatch, a: int, b: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows from a to b, a bucket's block pair, of unlike components that share no lower band and are not too unlike."""
    block, lower, upper, band, ids, parts, n = (np.asarray(batch.column(c))[a:b] for c in ("block", "block_a", "block_b", "band", "set_id", "component", "n"))
    reg = _matrix(batch.column("registers").slice(a, b - a))
    one, two = np.flatnonzero(block == lower[0]), np.flatnonzero(block == upper[0])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for lo in range(0, len(one), 64):
        x, y = np.nonzero(parts[one[lo : lo + 64], None] != parts[two])
        x, y = one[lo : lo + 64][x], two[y]
        if lower[0] == upper[0]:  # a block meets itself
            x, y = x[ids[x] < ids[y]], y[ids[x] < ids[y]]
        for at in range(0, len(x), 16384):
            i, j = x[at : at + 16384], y[at : at + 16384]
            same = (reg[i, : BANDS * WIDTH] == reg[j, : BANDS * WIDTH]).reshape(len(i), BANDS, WIDTH).all(axis=2)
            first = same.argmax(axis=1) == band[0]
            i, j = i[first], j[first]
            if len(i):
                keep = open_pairs((reg[i] > reg[j]).sum(axis=1), (reg[i] < reg[j]).sum(axis=1), n[i], n[j], similarity)
                found.append((i[keep], j[keep]))
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate(z) for z in zip(*found, strict=True)) if found else (empty, empty)


def _across(similarity: float):
    """The rows that are in a pair to be verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in _groups(batches, BUCKET):
            keep = np.zeros(batch.num_rows, bool)
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                x, y = _owned(batch, a, b, similarity)
                keep[a + x] = keep[a + y] = True
            if keep.any():
                yield batch.filter(pa.array(keep))
        release()

    return run


def _linked(similarity: float):
    """A spanning forest of the links of each bucket's block pair, pairs verified on whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in _groups(batches, BUCKET):
            ids, raw = np.asarray(batch.column("set_id")), batch.column("shingles")
            out: list[tuple[int, int]] = []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                x, y = _owned(batch, a, b, similarity)
                if not len(x):
                    continue
                sets = [np.frombuffer(raw[i].as_buffer(), U64) for i in range(a, b)]
                sizes, shared = np.array([len(s) for s in sets]), _shared(sets, x, y)
                # shared / union >= similarity, in integers
                hit = shared * 1000 >= round(similarity * 1000) * (sizes[x] + sizes[y] - shared)
                root = list(range(b - a))
                for i, j in zip(x[hit].tolist(), y[hit].tolist(), strict=True):
                    u, v = i, j
                    while root[u] != u:
                        root[u] = u = root[root[u]]
                    while root[v] != v:
                        root[v] = v = root[root[v]]
                    if u != v:  # a link that joins two trees
                        root[max(u, v)] = min(u, v)
                        out.append((int(ids[a + i]), int(ids[a + j])))
            yield pa.RecordBatch.from_arrays([pa.array([min(e) for e in out], pa.int64()), pa.array([max(e) for e in out], pa.int64())], ["a", "b"])
        release()

    return run


def _verified(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            left, right = batch.column("set_a"), batch.column("set_b")
            for i in range(batch.num_rows):
                x, y = np.frombuffer(left[i].as_buffer(), U64), np.frombuffer(right[i].as_buffer(), U64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                # shared / union >= similarity, in integers
                keep[i] = shared * 1000 >= round(similarity * 1000) * (len(x) + len(y) - shared)
            yield batch.select(["a", "b"]).filter(pa.array(keep))
        release()

    return run


def near_duplicates(docs: DataFrame, k: int = 5, similarity: float = 0.85, block: int = 512) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every row.

    ``component_id``: the least doc_id that links lead to; null if no row of the component has one, and its rows
    are not ``kept`` then. Rows that repeat a doc_id that is kept are kept all. ``block`` is a size of work, not a limit.
    """
    spark = docs.sparkSession
    ship(spark)
    with Tables(spark, "setsketch") as table:
        return staged(_join(docs, table, k, similarity, block), "near-duplicates")


def _join(docs: DataFrame, table: Tables, k: int, similarity: float, block: int) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row"), "text")
    rows = table(describe(texts, k), "rows")
    sets = rows.where("n > 0").groupBy("lo", "hi").agg(F.min("doc_id").alias("least"), F.min("row").alias("row"), F.first("n").alias("n"), F.first("registers").alias("registers"))
    sets = table(sets.withColumn("set_id", F.monotonically_increasing_id()), "sets")
    bands = _bands(sets)
    sizes = bands.groupBy("key").agg(F.count("*").alias("size"), F.min("set_id").alias("first")).where("size > 1")
    bands = table(bands.join(sizes.select("key", "first"), "key"), "bands")

    def shingles_of(ids: DataFrame, name: str) -> DataFrame:
        """``(set_id, shingles)`` of some sets."""
        need = table(ids.distinct().join(sets.select("set_id", "row", "lo", "hi"), "set_id"), name + "-sets")
        found = semi_join(texts, need.select("row"), "row").select("text").mapInArrow(_hashes(k), "lo long, hi long, shingles binary")
        # rows may be alike in id and text
        return table(need.join(found, ["lo", "hi"]).groupBy("set_id").agg(F.first("shingles").alias("shingles")), name + "-shingles")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        pairs = table(pairs, name)
        whole = shingles_of(pairs.select(F.col("a").alias("set_id")).union(pairs.select(F.col("b").alias("set_id"))), name)
        both = pairs.join(whole.select(F.col("set_id").alias("b"), F.col("shingles").alias("set_b")), "b")
        both = both.join(whole.select(F.col("set_id").alias("a"), F.col("shingles").alias("set_a")), "a")
        return table(both.select("a", "b", "set_a", "set_b").mapInArrow(_verified(similarity), "a long, b long"), name + "-links")

    side = lambda s: sets.select(F.col("set_id").alias(s), F.col("registers").alias(f"registers_{s}"), F.col("n").alias(f"n_{s}"))

    def likely(pairs: DataFrame, name: str) -> DataFrame:
        pairs = table(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
        both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "registers_a", "registers_b", "n_a", "n_b")
        return both.mapInArrow(_likely(similarity), "a long, b long")

    def unsettled(links: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """Buckets of unlike components, and what they hold."""
        known = table(components(links, table=table).select(F.col("node").alias("set_id"), "component"), name + "-known")
        placed = bands.select("key", "band", "set_id").join(known, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
        placed = table(placed, name + "-placed")
        by = placed.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most")
        return by.select("key"), placed

    # Every set of a bucket beside the bucket's first, then beside some drawn ones of other components.
    links = verified(likely(bands.where("set_id != first").select(F.col("first").alias("a"), F.col("set_id").alias("b")), "stars"), "near")
    keys, placed = unsettled(links, "first")
    left = placed.join(keys, "key")
    drawn = F.array(*(F.min(F.struct(F.xxhash64("set_id", F.lit(j)).alias("h"), F.col("set_id").alias("a"), F.col("component").alias("other"))) for j in range(DRAWN)))
    drawn = left.groupBy("key").agg(drawn.alias("x")).select("key", F.inline("x")).select("key", "a", "other").distinct()
    again = left.join(drawn, (left["key"] == drawn["key"]) & (F.col("component") != F.col("other"))).select("a", F.col("set_id").alias("b"))
    links = table(links.union(verified(likely(again, "drawn"), "drawn")), "links")

    # Sets of unlike components that still share a bucket.
    keys, placed = unsettled(links, "second")
    by = placed.join(keys, "key").groupBy("key", "component").agg(F.count("*").alias("size"))
    by = by.groupBy("key").agg(F.sum("size").alias("size"), F.max(F.struct("size", "component")).alias("top"))
    n_rest = F.ceil((F.col("size") - F.col("top.size")) / F.lit(block)).cast("int")  # blocks of the sets outside the largest component
    by = by.select("key", F.col("top.component").alias("top"), n_rest.alias("n_rest"), F.ceil(F.col("top.size") / F.lit(block)).cast("int").alias("n_top"))
    placed = placed.join(by, "key")
    rest = F.col("component") != F.col("top")
    place = F.when(rest, F.pmod(F.xxhash64("set_id"), "n_rest")).otherwise(F.col("n_rest") + F.pmod(F.xxhash64("set_id"), "n_top"))
    placed = placed.withColumn("block", place.cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("block") < F.col("n_rest"), F.col("n_rest") + F.col("n_top")).otherwise(F.col("n_rest")) - 1)))
    placed = placed.withColumns({"block_a": F.least("block", "other"), "block_b": F.greatest("block", "other")})
    placed = placed.join(sets.select("set_id", "n", "registers"), "set_id").select(*BUCKET, "block", "band", "set_id", "component", "n", "registers")
    near = table(placed.repartition(*BUCKET).sortWithinPartitions(*BUCKET).mapInArrow(_across(similarity), placed.schema), "across")
    exact = near.join(shingles_of(near.select("set_id"), "across"), "set_id")
    more = table(exact.repartition(*BUCKET).sortWithinPartitions(*BUCKET).mapInArrow(_linked(similarity), "a long, b long"), "across-links")

    classes = components(links.union(more), table=table)
    sets = sets.select("set_id", "lo", "hi", "least").join(classes.select(F.col("node").alias("set_id"), "component"), "set_id", "left")
    sets = table(sets.withColumn("component", F.coalesce("component", "set_id")), "named")
    first = sets.groupBy("component").agg(F.min("least").alias("component_id"))
    named = sets.join(first, "component").select("lo", "hi", "component_id")
    out = rows.select("doc_id", "lo", "hi", "n").join(named, ["lo", "hi"], "left")
    out = out.withColumn("component_id", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _hashes(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text", 1 << 19):
                lo, hi, raw = [], [], []
                for s in sets_of(*flat(part.column("text")), k):
                    lo.append(int(mix(s).sum()))
                    hi.append(int(mix(s ^ U64(0x5851F42D4C957F2D)).sum()))
                    raw.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([*(pa.array(np.array(x, U64).view(np.int64)) for x in (lo, hi)), pa.array(raw, pa.binary())], ["lo", "hi", "shingles"])
        release()

    return run
