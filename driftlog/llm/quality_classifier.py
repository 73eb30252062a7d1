"""Quality classifier: a support vector machine on naive Bayes features.

Features are indicators of character trigrams and of n-grams of word shapes (case, digits,
symbols, length, repetition), hashed to ``2 ** BITS`` columns. Each is scaled by the log ratio
of its counts in the two classes; a linear hinge-loss model is fitted by dual coordinate
descent, and a sigmoid fitted on rows held back turns margins into scores.

Null and empty texts have no indicator and get the score of the intercept. Repeated rows get
equal scores, rows without a doc_id are scored as all others. With labels of one class only, every score is that class's. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlog.llm.staging import Tables
from driftlog.llm.textblocks import U64, blocks, flat, mix, release, rows_of, ship, span_codes, words

BITS = 18


def _any(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask)])
    return total[ends] - total[starts]


def indicators(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each text of a block: features, and bounds of each text in them."""
    n = len(offsets) - 1
    top = U64((1 << BITS) - 1)
    rows, codes = [], []
    if len(raw) >= 3:
        at = np.flatnonzero(rows_of(np.arange(len(raw) - 2), offsets) == rows_of(np.arange(2, len(raw)), offsets)) if n > 1 else np.arange(len(raw) - 2)
        gram = raw[:-2].astype(np.uint32) << np.uint32(16) | raw[1:-1].astype(np.uint32) << np.uint32(8) | raw[2:]
        rows.append(rows_of(at, offsets))
        codes.append((gram[at] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS))
    starts, ends, row = words(raw, offsets)
    if len(starts):
        h, _ = span_codes(raw, starts, ends)
        size = np.minimum(np.searchsorted([3, 6, 10, 16], ends - starts, "right"), 4)
        upper = np.minimum(_any((raw >= 65) & (raw <= 90), starts, ends), 2)
        digit = _any((raw >= 48) & (raw <= 57), starts, ends) > 0
        last = raw[ends - 1]
        tail = np.select([np.isin(last, list(b"#*$%&")), last == 124, last == 33, np.isin(last, list(b".,;:?"))], [1, 2, 3, 4], 0)
        again = np.zeros(len(h), np.int64)
        for back, mark in ((2, 2), (1, 1)):
            again[back:][(h[back:] == h[:-back]) & (row[back:] == row[:-back])] = mark
        shape = ((((size * 3 + upper) * 2 + digit) * 5 + tail) * 3 + again).astype(U64)
        gram = np.zeros(len(h), U64)
        for k in (1, 2, 3):
            m = len(h) - k + 1
            if m < 1:
                break
            gram = gram[:m] * U64(1009) + shape[k - 1 :] + U64(1)
            same = row[:m] == row[k - 1 :]
            rows.append(row[:m][same])
            codes.append((mix(gram[same] + U64(k << 40)) & top).astype(np.uint32))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    keys = np.unique(np.concatenate([(r.astype(np.int64) << BITS) | c for r, c in zip(rows, codes, strict=True)]))
    return keys & ((1 << BITS) - 1), np.searchsorted(keys, np.arange(n + 1) << BITS)


@dataclass
class Classifier:
    weights: np.ndarray  # of the features, log-count ratios multiplied in
    squares: np.ndarray  # of the log-count ratios: rows are scaled to unit length
    bias: float
    slope: float
    shift: float

    def scores(self, features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(self.weights[features], dtype=np.float64)])
        norm = np.concatenate([[0.0], np.cumsum(self.squares[features], dtype=np.float64)])
        margin = (total[bounds[1:]] - total[bounds[:-1]] + self.bias) / np.sqrt(1 + np.maximum(norm[bounds[1:]] - norm[bounds[:-1]], 0))
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500)))


def train(rows: list[np.ndarray], labels: np.ndarray, c: float = 1.0, epochs: int = 12, alpha: float = 1.0, seed: int = 7) -> Classifier:
    """Fit on the features of each row and labels 0 or 1; every fifth row fits the sigmoid."""
    size = 1 << BITS
    y = np.where(labels == 1, 1.0, -1.0)
    if not len(y) or (y == y[0]).all():
        sign = float(y[0]) if len(y) else 1.0
        return Classifier(np.zeros(size, np.float32), np.zeros(size, np.float32), sign, 5.0, 0.0)
    count = {}
    for s in (1.0, -1.0):
        p = alpha + np.bincount(np.concatenate([r for r, v in zip(rows, y, strict=True) if v == s]), minlength=size)
        count[s] = np.log(p / p.sum())
    ratio = count[1.0] - count[-1.0]
    scale = np.array([1 / np.sqrt(1 + (ratio[r] ** 2).sum()) for r in rows])  # rows of unit length, the intercept among them
    held = np.arange(len(y)) % 5 == 4
    weight = {s: len(y) / (2 * (y == s).sum()) for s in (1.0, -1.0)}

    def descend(which: np.ndarray) -> tuple[np.ndarray, float]:
        """Dual coordinate descent for the hinge loss; costs weigh both classes alike."""
        w, b, a, order = np.zeros(size), 0.0, np.zeros(len(y)), np.random.default_rng(seed)
        for _ in range(epochs):
            for i in order.permutation(which):
                x = ratio[rows[i]] * scale[i]
                g = y[i] * (w[rows[i]] @ x + b * scale[i]) - 1
                new = min(max(a[i] - g, 0.0), c * weight[y[i]])  # rows have unit length
                if new != a[i]:
                    step = (new - a[i]) * y[i]
                    w[rows[i]] += step * x
                    b += step * scale[i]
                    a[i] = new
        return w, b

    def margins(w: np.ndarray, b: float, which: np.ndarray) -> np.ndarray:
        return np.array([((w[rows[i]] * ratio[rows[i]]).sum() + b) * scale[i] for i in which])

    fit_on = np.flatnonzero(~held) if held.any() and len(set(y[~held])) > 1 and len(set(y[held])) > 1 else np.arange(len(y))
    look = np.flatnonzero(held) if len(fit_on) < len(y) else fit_on
    w, b = descend(fit_on)
    m, t = margins(w, b, look), (y[look] + 1) / 2
    # Platt's targets, then Newton steps on slope and shift.
    p, q = t.sum(), len(t) - t.sum()
    t = np.where(t == 1, (p + 1) / (p + 2), 1 / (q + 2))
    s, k = 1.0, 0.0
    for _ in range(50):
        f = 1 / (1 + np.exp(-np.clip(s * m + k, -30, 30)))
        d, v = f - t, f * (1 - f) + 1e-9
        grad = np.array([(d * m).sum() + 1e-3 * s, d.sum()])
        hess = np.array([[(v * m * m).sum() + 1e-3, (v * m).sum()], [(v * m).sum(), v.sum() + 1e-6]])
        ds, dk = np.linalg.solve(hess, grad)
        s, k = s - np.clip(ds, -2, 2), k - np.clip(dk, -2, 2)
    w, b = descend(np.arange(len(y)))
    return Classifier((w * ratio).astype(np.float32), (ratio**2).astype(np.float32), float(b), float(max(s, 1e-3)), float(k))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 5_000, max_features: int = 20_000_000) -> Classifier:
    """Train on at most ``max_rows`` of the labelled documents given, those with the smallest hash of doc_id.

    Of these, in the order of the hash, as many are used as have ``max_features`` indicators together.
    Of rows that share a doc_id, the one whose text has the least hash is taken; of labels, the least.
    """
    spark = docs.sparkSession
    ship(spark)
    ids = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    chosen = F.broadcast(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                features, bounds = indicators(*flat(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(features, pa.int32()))], ["doc_id", "label", "features"])
        release()

    rows = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "label", "text")
    with Tables(spark, "labelled") as table:
        made = table(rows.mapInArrow(run, "doc_id long, label int, features array<int>"), "features")
        sizes = made.select("doc_id", F.xxhash64("doc_id").alias("h"), F.size("features").alias("n")).toArrow().sort_by([("h", "ascending"), ("doc_id", "ascending")])
        used = sizes.column("doc_id").to_numpy()[np.cumsum(sizes.column("n").to_numpy()) <= max_features].tolist()
        few = spark.createDataFrame([(int(i),) for i in used], "doc_id long")
        got = made.join(F.broadcast(few), "doc_id", "left_semi").toArrow().sort_by("doc_id")
    lists = got.column("features").combine_chunks()
    bounds, values = np.asarray(lists.offsets), np.asarray(lists.values)
    order = np.random.default_rng(1).permutation(len(bounds) - 1)
    return train([values[bounds[i] : bounds[i + 1]] for i in order], np.asarray(got.column("label"))[order])


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """``(doc_id, score, predicted)`` of every row."""
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(model)  # 2 MB whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                p = shared.value.scores(*indicators(*flat(part.column("text"))))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])
        release()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")
