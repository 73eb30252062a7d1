"""Masked pseudo-likelihood of texts under a bidirectional window network over words.

A token is a word, a character of three or more UTF-8 bytes or a mark, each with the white space
before it; white space at the end is a token too, so every byte lies in one. A token is one of
2^18 classes of its hash. It is predicted from the ``SIDE`` tokens before and after it by hashed
embeddings and a hidden layer, as three softmaxes of 64 (each of the later ones given the digits
before it), so probabilities of all classes sum to 1. The softmaxes begin at the corpus's own frequencies of the
digits, which are counted first; the network learns what its neighbours change. Memory does not depend on the vocabulary.

Training passes over every token of all documents once, in ``rounds``. A round takes the rows whose hash falls
to it, dealt by another hash to shards of some ``SHARD`` bytes; their number follows from the size of the corpus
alone. A shard is gone through in the order of its rows' hashes, by Adagrad from the common parameters,
in pieces that are cut by rows and bytes alone, and the shards' results are averaged by their tokens, first in
each task, then over groups of tasks, then over all. So the network depends on the documents, not on how
they are partitioned, but for the rounding of sums. Scores are the sums of the log-probabilities of all tokens.

Null and empty texts have 0 tokens, the sum 0 and no mean. Repeated rows, and rows without a doc_id,
are scored each; they count in training as often as they occur, rows alike in id and text in one shard. Other
columns are ignored. With no text at all the network stays at its start.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from driftlog.llm.textblocks import blocks, flat, release, rows_of, ship, span_codes

SIDE, EMBED, HIDDEN, ROWS, WAYS = 3, 16, 32, 1 << 15, 64
SHAPES = {"e": (ROWS, EMBED), "p2": (WAYS, HIDDEN), "p3": (WAYS * WAYS, HIDDEN), "w": (2 * SIDE * EMBED, HIDDEN), "b": (HIDDEN,)}
SHAPES |= {f"v{j}": (HIDDEN, WAYS) for j in (1, 2, 3)} | {f"c{j}": (WAYS,) for j in (1, 2, 3)}
SPARSE = ("e", "p2", "p3")  # rows that a batch does not touch stay as they are
CHUNK = 8192
BATCH = 8192
SHARD = 4 << 20  # bytes of texts of a shard in a round

_KIND = np.full(256, 2, np.uint8)  # 0 white space, 1 of a word, 2 alone, 3 inside a character
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(0xC2, 0xE0)]] = 1
_KIND[0x80:0xC0] = 3


def start(seed: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    scale = {"e": 0.3, "w": (2 * SIDE * EMBED) ** -0.5, "v1": HIDDEN**-0.5, "v2": HIDDEN**-0.5, "v3": HIDDEN**-0.5, "p2": 0.5, "p3": 0.5}
    return {k: (rng.normal(0, 1, s) * scale.get(k, 0.0)).astype(np.float32) for k, s in SHAPES.items()}


def pack(params: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([params[k].ravel() for k in SHAPES])


def unpack(flat_params: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = np.array(flat_params[at : at + n], np.float32).reshape(s)
        at += n
    return out


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every token; the tokens of a text cover all its bytes."""
    if not len(raw):
        return (np.zeros(0, np.int64),) * 3
    kind = np.take(_KIND, raw)
    inside = np.flatnonzero(kind == 3)
    if len(inside):  # up to three bytes after a character's first are of its kind
        for _ in range(3):
            kind[inside] = kind[np.maximum(inside - 1, 0)]
    space, word = kind == 0, kind == 1
    begin = np.ones(len(raw), bool)
    begin[1:] = ~space[:-1] & (space[1:] | ~(word[1:] & word[:-1]))
    begin[inside] = False
    begin[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(begin)
    return starts, np.append(starts[1:], len(raw)), rows_of(starts, offsets)


def classes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each token, the hash of each number's bytes, and the tokens' rows."""
    starts, ends, rows = tokens(raw, offsets)
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(0, np.uint64), rows
    codes, distinct = span_codes(raw, starts, ends)
    return codes, np.fromiter(map(xxh3_64_intdigest, distinct.tolist()), np.uint64, len(distinct)), rows


def windows(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embedding rows around each token (0 outside the text), its three digits, and its text's row."""
    codes, hashes, rows = classes(raw, offsets)
    ids = ((hashes % np.uint64(ROWS - 1)).astype(np.int32) + 1)[codes]
    around = np.zeros((len(ids), 2 * SIDE), np.int32)
    for d in range(1, SIDE + 1):
        same = rows[d:] == rows[:-d]
        around[d:, SIDE - d] = ids[:-d] * same
        around[:-d, SIDE + d - 1] = ids[d:] * same
    digits = np.stack([(hashes >> np.uint64(s) & np.uint64(WAYS - 1)).astype(np.int32) for s in (58, 52, 46)], axis=1)
    return around, np.take(digits, codes, axis=0), rows


#: Rows that are worked on at once: their layers stay in a core's cache.
TILE = 2048


def _ready(p: dict[str, np.ndarray]) -> tuple[tuple, list[tuple]]:
    """The parameters as ``_inputs`` and ``_layer`` take them; they do not change within a batch.

    A hidden layer is tanh(a + b) = 1 - 2r with r = 1 / (1 + exp(2a) exp(2b)). The exponentials of the rows of the tables of digits
    are made here once, and 1 and 2 go to the weights behind, so that the layer is r itself.
    """
    layers = []
    for j in (1, 2, 3):
        v, q, table, near = p[f"v{j}"], p.get(f"q{j}"), None, False
        bias = (p[f"c{j}"] + v.sum(axis=0)).astype(v.dtype, copy=False)
        most = float((np.abs(v).sum(axis=0) + np.abs(p[f"c{j}"])).max()) + (0.0 if q is None else float(max(q.max(), -q.min())))
        if q is not None:
            q = (q + bias).astype(v.dtype, copy=False)
        if j > 1:
            table = 2 * p[f"p{j}"]
            near = bool(table.max() <= 40 and table.min() >= -40)  # then exp(2a) at its ends leaves r at its own
            table = np.exp(table, out=table) if near else table
        layers.append((-2 * v, bias if q is None else q, table, near, most < 80))
    return (p["e"], 2 * p["w"], 2 * p["b"]), layers


def _inputs(first: tuple, around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, twice what the hidden layers add to their digits' rows, and its exponentials."""
    e, w, b = first
    x = np.take(e, around, axis=0).reshape(len(around), -1)
    a = x @ w
    a += b
    with np.errstate(over="ignore", under="ignore"):
        return x, a, np.exp(a)


def _layer(layer: tuple, a: np.ndarray, grown: np.ndarray, given: np.ndarray | None, own: np.ndarray):
    """Hidden layer r, exponentials of the logits, their sums, and the log-probability of the classes at ``own`` of all rows' ways."""
    v, bias, table, near, bounded = layer
    with np.errstate(over="ignore", under="ignore"):
        if table is None:
            r = grown + 1
        else:
            r = np.take(table, given, axis=0)
            if near:
                r *= grown
            else:
                r += a
                np.exp(r, out=r)
            r += 1
    np.divide(1, r, out=r)
    s = r @ v
    s += bias if bias.ndim == 1 else np.take(bias, given, axis=0)
    if not bounded and not (s.max() < 80 and s.min() > -80):  # no sum of exponentials may vanish or overflow
        s -= s.max(axis=1, keepdims=True)
    logs = np.take(s.ravel(), own)
    np.exp(s, out=s)
    total = s @ np.ones(WAYS, s.dtype)
    logs -= np.log(total)
    return r, s, total, logs


def _given(digits: np.ndarray) -> tuple:
    """Row of each table of digits."""
    return None, digits[:, 0].astype(np.int64), digits[:, 0].astype(np.int64) * WAYS + digits[:, 1]


def _owns(digits: np.ndarray) -> np.ndarray:
    """By digit, where it lies among the ways of all rows of its tile."""
    return (np.arange(len(digits)) % TILE * WAYS)[None, :] + digits.T


def _summed(rows: np.ndarray, values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows, which are below ``size``, and the sums of their values, two columns at a time as complex numbers."""
    found = np.flatnonzero(np.bincount(rows, minlength=size))
    out = np.zeros((size, values.shape[1]), values.dtype)
    pairs = np.result_type(values.dtype, np.complex64)
    into, of = out.view(pairs), values.view(pairs)
    for k in range(of.shape[1]):
        np.add.at(into[:, k], rows, of[:, k])
    return found, np.take(out, found, axis=0)


def gradients(p: dict[str, np.ndarray], around: np.ndarray, digits: np.ndarray) -> tuple[float, dict]:
    """Mean loss of the tokens and its gradients; those of ``SPARSE`` as rows and values."""
    n, kind, loss = len(around), p["w"].dtype, 0.0
    out = {k: np.zeros_like(p[k]) for k in SHAPES if k not in SPARSE}
    inputs = np.empty((n, 2 * SIDE * EMBED), kind)
    deltas = {j: np.empty((n, HIDDEN), kind) for j in (2, 3)}
    (first, layers), given, owns, around = _ready(p), _given(digits), _owns(digits), around.astype(np.int64)
    back, backs = np.ascontiguousarray(p["w"].T), [np.ascontiguousarray(4 * p[f"v{j}"].T) for j in (1, 2, 3)]
    for lo in range(0, n, TILE):
        here, da = slice(lo, lo + TILE), 0
        x, a, grown = _inputs(first, around[here])
        ones = np.ones(len(x), kind)
        for j, layer in enumerate(layers, 1):
            r, d, total, logs = _layer(layer, a, grown, None if j == 1 else given[j - 1][here], owns[j - 1, here])
            loss -= float(logs.sum()) / n
            np.divide(1, total, out=total)
            d *= total[:, None]
            d.reshape(-1)[owns[j - 1, here]] -= 1
            out[f"v{j}"] += r.T @ d
            out[f"c{j}"] += ones @ d
            dh = np.matmul(d, backs[j - 1], out=None if j == 1 else deltas[j][here])
            r -= r * r  # a quarter of the slope of tanh
            dh *= r
            da = dh if j == 1 else np.add(da, dh, out=da)
        out["w"] += x.T @ da
        out["b"] += ones @ da
        np.matmul(da, back, out=inputs[here])
    for j in (1, 2, 3):  # of h, which is 1 - 2r
        out[f"v{j}"] *= -2
        out[f"v{j}"] += out[f"c{j}"]
    out |= {f"p{j}": _summed(given[j - 1], deltas[j], len(p[f"p{j}"])) for j in (2, 3)}
    out["e"] = _summed(around.ravel(), inputs.reshape(-1, EMBED), len(p["e"]))
    for k, g in out.items():
        g = g[1] if k in SPARSE else g
        g *= kind.type(1 / n)
    return loss, out


def learn(p: dict[str, np.ndarray], squares: dict[str, np.ndarray], around: np.ndarray, digits: np.ndarray, rate: float, seed: int = 0) -> None:
    """Adagrad in place over the tokens once, in an order drawn with the seed."""
    order = np.random.default_rng(seed).permutation(len(around))
    for lo in range(0, len(order), BATCH):
        pick = order[lo : lo + BATCH]
        for k, g in gradients(p, np.take(around, pick, axis=0), np.take(digits, pick, axis=0))[1].items():
            rows, g = g if k in SPARSE else (None, g)
            total = g * g
            total += squares[k] if rows is None else np.take(squares[k], rows, axis=0)
            squares[k][... if rows is None else rows] = total
            np.sqrt(total, out=total)
            total += np.float32(1e-8)
            g *= rate
            g /= total
            if rows is None:
                p[k] -= g
            else:
                p[k][rows] = np.subtract(np.take(p[k], rows, axis=0), g, out=g)


def prior(counts: np.ndarray, add: float = 0.1) -> dict[str, np.ndarray]:
    """Logarithms of how frequent each digit is after the digits before it, from the counts of all classes."""
    out, by = {}, counts.astype(np.float64)
    for j in (3, 2, 1):
        node = by.reshape(-1, WAYS)
        by = node.sum(axis=1)
        out[f"q{j}"] = np.log((node + add) / (by[:, None] + add * WAYS)).astype(np.float32)
    return out | {"q1": out["q1"][0]}


def frequencies(docs: DataFrame) -> np.ndarray:
    """Occurrences of every class in all documents; a task sends a row a class, and so many come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(WAYS**3, np.int64)
        for batch in batches:
            for part in blocks(batch, "text"):
                codes, hashes, _ = classes(*flat(part.column("text")))
                np.add.at(counts, (hashes >> np.uint64(46)).astype(np.int64), np.bincount(codes, minlength=len(hashes)))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], ["c", "n"])
        release()

    got = docs.select("text").mapInArrow(run, "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(WAYS**3, np.int64)
    out[np.asarray(got.column("c"))] = np.asarray(got.column("n"))
    return out


def pieces(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[tuple[int, pa.Array]]:
    """Shard and texts of runs of rows of one shard, each of ``most`` bytes or little more, however the rows come in batches."""
    held: list[pa.Array] = []
    shard, size = None, 0
    for batch in batches:
        shards = np.asarray(batch.column("shard"))
        sizes = np.asarray(pc.binary_length(batch.column("text")), np.int64)
        lo = 0
        while lo < batch.num_rows:
            if shards[lo] != shard:
                if held:
                    yield shard, pa.concat_arrays(held)
                shard, size, held = int(shards[lo]), 0, []
            end = lo + int(np.searchsorted(shards[lo:], shard, "right"))  # shards ascend
            full = lo + int(np.searchsorted(np.cumsum(sizes[lo:end]), most - size)) + 1  # up to the row that fills the piece
            hi = min(end, full)
            held.append(batch.column("text").slice(lo, hi - lo))
            size += int(sizes[lo:hi].sum())
            if size >= most:
                yield shard, pa.concat_arrays(held)
                size, held = 0, []
            lo = hi
    if held:
        yield shard, pa.concat_arrays(held)


def train(params: dict[str, np.ndarray], shards: Iterator[tuple[int, pa.Array]], rate: float, seed: int) -> tuple[np.ndarray, int]:
    """Sum over the shards of their parameters times their tokens, and the tokens; each shard begins at ``params``."""
    total, tokens_of_all = np.zeros(sum(int(np.prod(x)) for x in SHAPES.values())), 0
    now, p, squares, weight = None, {}, {}, 0
    for shard, texts in shards:
        if shard != now:
            if weight:
                total += weight * pack(p).astype(np.float64)
                tokens_of_all += weight
            now, weight = shard, 0
            p = {k: v.copy() for k, v in params.items()}
            squares = {k: np.zeros_like(v) for k, v in p.items()}
        around, digits, _ = windows(*flat(texts))
        learn(p, squares, around, digits, rate, seed)
        weight += len(digits)
    if weight:
        total += weight * pack(p).astype(np.float64)
        tokens_of_all += weight
    return total, tokens_of_all


def _sums(t: pa.Table) -> pa.Table:
    """One row of a group's pieces and weights."""
    whole = sum(np.frombuffer(x.as_buffer(), np.float64) for x in t.column("piece"))
    return pa.table({"i": t.column("i")[:1], "piece": pa.array([whole.tobytes()], pa.binary()), "weight": pa.array([sum(t.column("weight").to_pylist())])})


def fit(docs: DataFrame, rounds: int = 3, rate: float = 0.1, shard: int = SHARD) -> dict[str, np.ndarray]:
    """Train on all tokens of all documents."""
    spark, params = docs.sparkSession, start()
    ship(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    fixed = prior(frequencies(docs)) if size else {}
    params |= fixed
    n = max(1, round(size / rounds / shard))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    h = F.xxhash64("doc_id", "text")
    for r in range(rounds):
        shared = spark.sparkContext.broadcast(params)  # 3 MB

        def run(batches: Iterator[pa.RecordBatch], shared=shared, r=r) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            total, weight = train(shared.value, pieces(batches), rate / (r + 1), r)
            if weight:
                cut = [total[lo : lo + CHUNK].tobytes() for lo in range(0, len(total), CHUNK)]
                task = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays([pa.array(range(len(cut)), pa.int32()), pa.array([task] * len(cut), pa.int32()), pa.array(cut, pa.binary()), pa.array([weight] * len(cut), pa.int64())], ["i", "task", "piece", "weight"])
            release()

        own = docs.where(F.pmod(h, F.lit(rounds)) == r).where("text is not null").select(F.pmod(F.xxhash64(h, F.lit(1)), F.lit(n)).cast("int").alias("shard"), h.alias("h"), "text")
        dealt = own.repartition(parts, "shard").sortWithinPartitions("shard", "h", "text")
        made = dealt.mapInArrow(run, "i int, task int, piece binary, weight long")
        # tasks first by groups of about the root of their number, so that no group has many pieces
        some = made.groupBy("i", F.pmod("task", F.lit(math.isqrt(parts) + 1)).alias("g")).applyInArrow(_sums, "i int, piece binary, weight long")
        got = some.groupBy("i").applyInArrow(_sums, "i int, piece binary, weight long").toArrow()  # one row a piece of 64 KB
        if got.num_rows:
            got = got.sort_by("i")
            mean = [np.frombuffer(x, np.float64) / w for x, w in zip(got.column("piece").to_pylist(), got.column("weight").to_pylist(), strict=True)]
            params = unpack(np.concatenate(mean).astype(np.float32)) | fixed
    return params


def log_probs(params: dict[str, np.ndarray], around: np.ndarray, digits: np.ndarray) -> np.ndarray:
    """Log-probability of every token given the tokens around it."""
    out = np.empty(len(around), np.float32)
    (first, layers), given, owns = _ready(params), _given(digits), _owns(digits)
    for lo in range(0, len(around), TILE):
        here = slice(lo, lo + TILE)
        _, a, grown = _inputs(first, around[here])
        out[here] = sum(_layer(layer, a, grown, None if g is None else g[here], own[here])[3] for layer, g, own in zip(layers, given, owns, strict=True))
    return out


def score(docs: DataFrame, params: dict[str, np.ndarray]) -> DataFrame:
    """``(doc_id, n_tokens, sum_logprob, mean_logprob)`` of every row."""
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                around, digits, rows = windows(*flat(part.column("text")))
                n = np.bincount(rows, minlength=part.num_rows)
                sums = np.bincount(rows, weights=log_probs(shared.value, around, digits), minlength=part.num_rows).astype(np.float64)  # integers where no text has a token
                mean = pa.array(sums / np.maximum(n, 1), mask=n == 0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(sums), mean], ["doc_id", "n_tokens", "sum_logprob", "mean_logprob"])
        release()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, sum_logprob double, mean_logprob double")
