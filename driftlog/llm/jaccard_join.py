"""Self-join of documents on the Jaccard similarity of their word shingles, by chosen paths.

Documents with the same shingle set form one set with a weight. Each set has ``SIZE`` minhash
tokens, one a place. A run splits the sets recursively: at a node, ``1 / similarity`` places in the mean
(one or two for 0.8) are drawn by a hash of the node, and the sets that hold the same token there go to
the same child. A node depends on its path alone, so a set finds its leaves, the nodes at ``depth``, by
itself, whatever other sets there are. Runs are repeated until the chance that a pair shares a leaf
reaches ``recall``, for a pair of the least similarity whose minhashes agree two deviations less than
they should. In a leaf all pairs are compared:
those with like one-bit sketches, and for which no leaf of a lower number has them both, are
verified on the exact shingle sets. So each pair is verified once, and only counts of links and a
spanning forest leave a task. Leaves of more than ``block`` sets are compared block by block, each
pair of blocks a task's group of its own.

Shingles are ``k`` words (longest runs without space, tab, LF, VT, FF, CR); a text of 1 to k - 1
words has one shingle. Every row is a document of its own: rows that repeat a doc_id, with one text
or several, and rows without a doc_id have links as all others have. Null texts and texts without a
word have no links and are classes of their own. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlog.llm.components import components
from driftlog.llm.staging import Tables, semi_join, staged
from driftlog.llm.textblocks import U64, blocks, flat, mix, release, shingles, ship, span_hashes, words

SIZE = 128
_FACTORS = np.random.default_rng(11).integers(1, 2**63, SIZE, dtype=U64) * U64(2) + U64(1)
_PLACE = np.arange(1, SIZE + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a block."""
    n = len(offsets) - 1
    starts, ends, rows = words(raw, offsets)
    h, at = shingles(span_hashes(raw, starts, ends), rows, n, k)
    bounds = np.searchsorted(at, np.arange(n + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        yield np.unique(h[a:b])


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minhash values (uint32) of a set."""
    low = np.full(SIZE, 2**64 - 1, U64)
    for lo in range(0, len(hashes), 8192):
        np.minimum(low, (hashes[None, lo : lo + 8192] * _FACTORS[:, None]).min(axis=1), out=low)
    return (low >> U64(32)).astype(np.uint32)


def describe(rows: DataFrame, k: int) -> DataFrame:
    """``(doc_id, row, lo, hi, n, signature, sketch)`` of every row: two hashes of the set, its size, minhashes, one bit of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text", 1 << 19):
                lo, hi, n, sig, sketch = [], [], [], [], []
                for s in shingle_sets(*flat(part.column("text")), k):
                    lo.append(int(mix(s).sum()))
                    hi.append(int(mix(s ^ U64(0x5851F42D4C957F2D)).sum()))
                    n.append(len(s))
                    v = signature(s) if len(s) else None
                    sig.append(v.tobytes() if len(s) else None)
                    sketch.append(np.packbits(mix(v.astype(U64) + _PLACE) & U64(1)).tobytes() if len(s) else None)
                hashes = [pa.array(np.array(x, U64).view(np.int64)) for x in (lo, hi)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), *hashes, pa.array(n, pa.int32()), pa.array(sig, pa.binary()), pa.array(sketch, pa.binary())], ["doc_id", "row", "lo", "hi", "n", "signature", "sketch"])
        release()

    return rows.mapInArrow(run, "doc_id long, row long, lo long, hi long, n int, signature binary, sketch binary")


def children(parents: np.ndarray, tokens: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and child node of every drawn place; parents: node of each row, tokens: (rows, SIZE) minhashes."""
    drawn = mix(parents ^ U64(0x2545F4914F6CDD1D))
    least, rest = divmod(1 / similarity, 1)
    counts = int(least) + ((drawn >> U64(32)) < U64(int(rest * 2**32)))
    first, step = drawn % U64(SIZE), (drawn >> U64(7)) % U64(SIZE // 2) * U64(2) + U64(1)  # SIZE is a power of two
    rows, nodes, own = [], [], mix(parents)
    for k in range(int(counts.max(initial=0))):
        row = np.flatnonzero(counts > k)
        place = ((first[row] + step[row] * U64(k)) % U64(SIZE)).astype(np.int64)
        rows.append(row)
        nodes.append(mix(own[row] + _PLACE[place] + tokens[row, place].astype(U64) * U64(0xD6E8FEB86659FD93)))
    return (np.concatenate(rows), np.concatenate(nodes)) if rows else (np.zeros(0, np.int64), np.zeros(0, U64))


def paths(tokens: np.ndarray, runs: int, depth: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and leaf of every set of a batch in every run; tokens: (rows, SIZE) minhashes."""
    found = []
    for r in range(runs):
        rows = np.arange(len(tokens))
        node = np.full(len(tokens), r + 1, U64)
        for _ in range(depth):
            at, node = children(node, tokens[rows], similarity)
            rows = rows[at]
        found.append((rows, node))
    rows, leaves = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((leaves, rows))
    rows, leaves = rows[order], leaves[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (leaves[1:] != leaves[:-1])
    return rows[new], leaves[new]


def _leaves(sets: DataFrame, runs: int, depth: int, similarity: float) -> DataFrame:
    """``(leaf, set_id)`` of every set, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                tokens = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint32).reshape(-1, SIZE)
                rows, leaves = paths(tokens, runs, depth, similarity)
                yield pa.RecordBatch.from_arrays([pa.array(leaves.view(np.int64)), pa.array(np.asarray(part.column("set_id"))[rows])], ["leaf", "set_id"])
        release()

    return sets.select("set_id", "signature").mapInArrow(run, "leaf long, set_id long")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of whole groups of sorted rows, and the bounds of the groups."""
    left = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if left is None else [left, batch]).combine_chunks()
        batch = table.to_batches()[0] if table.num_rows else None
        if batch is None:
            continue
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for k in keys:
            v = np.asarray(batch.column(k))
            new[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(new)
        left = batch.slice(starts[-1])
        if len(starts) > 1:
            yield batch.slice(0, starts[-1]), starts
    if left is not None and left.num_rows:
        yield left, np.array([0, left.num_rows])


def _alike(sketches: np.ndarray, sides: np.ndarray, leaves: list[np.ndarray], leaf: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows to compare in a leaf: sketches that differ in at most ``most`` bits, and no lower leaf in common."""
    n, split = len(sketches), sides.min() != sides.max()
    left = np.flatnonzero(sides == sides.min()) if split else np.arange(n)
    right = np.flatnonzero(sides != sides.min()) if split else left
    found = []
    for lo in range(0, len(left), 256):
        a = left[lo : lo + 256]
        near = np.bitwise_count(sketches[a][:, None, :] ^ sketches[right][None, :, :]).sum(axis=2, dtype=np.int32) <= most
        if not split:
            near &= a[:, None] < right[None, :]
        x, y = np.nonzero(near)
        found.append((a[x], right[y]))
    x, y = (np.concatenate(z) for z in zip(*found, strict=True))
    if len(x) > 64:
        # Lower leaves of each row as bits; a leaf that one row alone has cannot be common.
        values = np.concatenate(leaves)
        rows = np.repeat(np.arange(n), [len(v) for v in leaves])
        rows, values = rows[values < leaf], values[values < leaf]
        names, inverse, counts = np.unique(values, return_inverse=True, return_counts=True)
        common = counts > 1
        rows, bit = rows[common[inverse]], (np.cumsum(common) - 1)[inverse[common[inverse]]]
        held = np.zeros((n, int(common.sum()) // 64 + 1), U64)
        np.bitwise_or.at(held, (rows, bit // 64), U64(1) << (bit % 64).astype(U64))
        keep = np.zeros(len(x), bool)
        step = max(1, (1 << 20) // held.shape[1])
        for lo in range(0, len(x), step):
            keep[lo : lo + step] = ~(held[x[lo : lo + step]] & held[y[lo : lo + step]]).any(axis=1)
    else:
        sets = [set(v[v < leaf].tolist()) for v in leaves]
        keep = np.array([sets[i].isdisjoint(sets[j]) for i, j in zip(x.tolist(), y.tolist(), strict=True)], bool)
    return x[keep], y[keep]


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sketches = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), U64).reshape(batch.num_rows, -1)
    lists = batch.column("leaves")
    bounds = np.asarray(lists.offsets)
    return np.asarray(batch.column("leaf")), np.asarray(batch.column("side")), np.asarray(batch.column("set_id")), sketches, bounds - bounds[0], np.asarray(lists.flatten())


def _candidates(most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in _groups(batches, ["leaf", "block_a", "block_b"]):
            leaf, side, _, sketches, bounds, values = _columns(batch)
            keep = np.zeros(batch.num_rows, bool)
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if b - a > 1:
                    x, y = _alike(sketches[a:b], side[a:b], [values[bounds[i] : bounds[i + 1]] for i in range(a, b)], int(leaf[a]), most)
                    keep[a + x] = keep[a + y] = True
            if keep.any():
                yield batch.filter(pa.array(keep))
        release()

    return run


def _shared(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sorted sets."""
    if len(x) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(x.tolist(), y.tolist(), strict=True)], np.int64)
    names, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(inverse, kind="stable")
    rows, inverse = rows[order], inverse[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, len(names), 4096):  # counts stay exact in float32 below 2 ** 24
        a, b = np.searchsorted(inverse, [lo, lo + 4096])
        part = np.zeros((len(sets), min(4096, len(names) - lo)), np.float32)
        part[rows[a:b], inverse[a:b] - lo] = 1
        total += part @ part.T
    return total[x, y].astype(np.int64)


def _verified(most: int, similarity: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in _groups(batches, ["leaf", "block_a", "block_b"]):
            leaf, side, ids, sketches, bounds, values = _columns(batch)
            weights, raw = np.asarray(batch.column("weight")), batch.column("shingles")
            out: list[list] = [[], [], []]
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                x, y = _alike(sketches[a:b], side[a:b], [values[bounds[i] : bounds[i + 1]] for i in range(a, b)], int(leaf[a]), most)
                if not len(x):
                    continue
                sets = [np.frombuffer(raw[i].as_py(), U64) for i in range(a, b)]
                sizes = np.array([len(s) for s in sets])
                shared = _shared(sets, x, y)
                # shared / union >= similarity, in integers
                hit = shared * 1000 >= round(similarity * 1000) * (sizes[x] + sizes[y] - shared)
                x, y = x[hit], y[hit]
                links = np.zeros(b - a, np.int64)
                np.add.at(links, x, weights[a + y])
                np.add.at(links, y, weights[a + x])
                root = list(range(b - a))

                def find(i: int) -> int:
                    while root[i] != i:
                        root[i] = root[root[i]]
                        i = root[i]
                    return i

                for i, j in zip(x.tolist(), y.tolist(), strict=True):
                    i, j = find(i), find(j)
                    root[max(i, j)] = min(i, j)
                for i in np.flatnonzero(links).tolist():
                    out[0].append(int(ids[a + i]))
                    out[1].append(int(ids[a + find(i)]))
                    out[2].append(int(links[i]))
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], ["set_id", "other", "links"])
        release()

    return run


def _survival(depth: int, similarity: float, agreement: float) -> float:
    """Chance that a pair whose tokens agree with that probability still shares a node at a depth."""
    least, rest = divmod(1 / similarity, 1)
    gone = 0.0
    for _ in range(depth):
        one = 1 - agreement + agreement * gone  # of a drawn place: no node below it is shared
        gone = one**least * (1 - rest + rest * one)
    return 1 - gone


def jaccard_join(docs: DataFrame, k: int = 5, similarity: float = 0.8, recall: float = 0.9999, depth: int = 3, block: int = 512) -> DataFrame:
    """``(doc_id, class_id, n_links)`` of every row.

    ``n_links``: other rows with similarity of at least ``similarity``; ``class_id``: the least
    doc_id that links lead to, null if none of them has one. ``block`` is a size of work, not a
    limit: larger leaves are compared whole, in blocks.
    """
    spark = docs.sparkSession
    ship(spark)
    with Tables(spark, "jaccard") as table:
        return staged(_join(docs, table, k, similarity, recall, depth, block), "classes")


def _join(docs: DataFrame, table: Tables, k: int, similarity: float, recall: float, depth: int, block: int) -> DataFrame:
    # A row's hash finds the text of a set again; rows that share one are told apart by their sets.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row"), "text")
    rows = table(describe(texts, k), "rows")
    sets = rows.where("n > 0").groupBy("lo", "hi").agg(F.min("doc_id").alias("least"), F.count("*").alias("weight"), F.min("row").alias("row"), F.first("signature").alias("signature"), F.first("sketch").alias("sketch"))
    sets = table(sets.withColumn("set_id", F.monotonically_increasing_id()), "sets")

    agreement = similarity - 2 * math.sqrt(similarity * (1 - similarity) / SIZE)
    runs = math.ceil(math.log(1 - recall) / math.log(1 - _survival(depth, similarity, agreement)))
    leaves = table(_leaves(sets, runs, depth, similarity), "leaves")
    sizes = leaves.groupBy("leaf").agg(F.count("*").alias("size")).where("size > 1")
    leaves = table(leaves.join(sizes, "leaf"), "shared")
    lists = leaves.groupBy("set_id").agg(F.collect_list(F.struct("leaf", "size")).alias("at"))
    placed = lists.join(sets.select("set_id", "lo", "hi", "weight", "sketch"), "set_id").select("set_id", "lo", "hi", "weight", "sketch", F.col("at.leaf").alias("leaves"), F.explode("at").alias("at"))
    n_blocks = F.ceil(F.col("at.size") / F.lit(block)).cast("int")
    placed = placed.select("set_id", "lo", "hi", "weight", "sketch", "leaves", F.col("at.leaf").alias("leaf"), F.pmod(F.xxhash64("set_id"), n_blocks).cast("int").alias("side"), F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("other"))
    placed = placed.withColumns({"block_a": F.least("side", "other"), "block_b": F.greatest("side", "other")}).drop("other")
    keys = ["leaf", "block_a", "block_b"]
    most = SIZE - math.floor(SIZE * ((1 + similarity) / 2) - 4.5 * math.sqrt(SIZE * (1 - similarity**2) / 4))
    placed = placed.repartition(*keys).sortWithinPartitions(*keys)
    near = table(placed.mapInArrow(_candidates(most), placed.schema), "candidates")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text", 1 << 19):
                lo, hi, raw = [], [], []
                for s in shingle_sets(*flat(part.column("text")), k):
                    lo.append(int(mix(s).sum()))
                    hi.append(int(mix(s ^ U64(0x5851F42D4C957F2D)).sum()))
                    raw.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([*(pa.array(np.array(x, U64).view(np.int64)) for x in (lo, hi)), pa.array(raw, pa.binary())], ["lo", "hi", "shingles"])
        release()

    need = table(near.select("lo", "hi").distinct().join(sets.select("lo", "hi", "row"), ["lo", "hi"]).select("row"), "need")
    found = semi_join(texts, need, "row").select("text").mapInArrow(hashes, "lo long, hi long, shingles binary")
    found = found.groupBy("lo", "hi").agg(F.first("shingles").alias("shingles"))  # rows alike in id and text
    exact = near.join(found, ["lo", "hi"])
    exact = exact.repartition(*keys).sortWithinPartitions(*keys)
    linked = table(exact.mapInArrow(_verified(most, similarity), "set_id long, other long, links long"), "links")
    counts = linked.groupBy("set_id").agg(F.sum("links").alias("links"))
    classes = components(linked.select(F.col("set_id").alias("a"), F.col("other").alias("b")), table=table)
    sets = sets.select("set_id", "lo", "hi", "least", "weight").join(classes.select(F.col("node").alias("set_id"), "component"), "set_id", "left")
    sets = sets.withColumn("component", F.coalesce("component", "set_id"))
    sets = table(sets.join(counts, "set_id", "left"), "named")
    first = sets.groupBy("component").agg(F.min("least").alias("class_id"))
    named = sets.join(first, "component").select("lo", "hi", "class_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = rows.select("doc_id", "lo", "hi", "n").join(named, ["lo", "hi"], "left")
    alone = F.col("n") == 0
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"))
