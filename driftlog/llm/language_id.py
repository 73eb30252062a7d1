"""Language identification by a bidirectional gated recurrent network over UTF-8 bytes.

Texts are cut into windows of ``T`` bytes that together cover them whole. Two GRUs read each
window from both ends, a softmax labels every byte, and a document's probabilities are the mean
over its bytes. Training is by backpropagation through time in NumPy with Adam.

Null texts and texts without a letter get ``und`` and score 0. With no labelled row, every text
gets ``und``. Equal texts get equal results, with or without a doc_id; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftlog.llm.textblocks import blocks, flat, release, ship

T = 64


def windows(offsets: np.ndarray, size: int = T) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and row of every window, long ones first."""
    sizes = np.diff(offsets)
    n = -(-sizes // size)
    rows = np.repeat(np.arange(len(sizes)), n)
    k = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
    starts = offsets[rows] + k * size
    lengths = np.minimum(size, offsets[rows + 1] - starts)
    order = np.argsort(-lengths, kind="stable")
    return starts[order], lengths[order], rows[order]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


@dataclass
class BiGRU:
    """Per direction: table (256, 3H) of byte inputs, recurrent weights (H, 3H), bias of the candidate's recurrent part (H)."""

    langs: list[str]
    params: dict[str, np.ndarray]

    @classmethod
    def new(cls, langs: list[str], hidden: int, seed: int) -> BiGRU:
        rng = np.random.default_rng(seed)
        params = {}
        for d in "fb":
            params[f"e{d}"] = rng.normal(0, 0.3, (256, 3 * hidden))
            params[f"u{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden))
            params[f"c{d}"] = np.zeros(hidden)
        params["w"] = rng.normal(0, 1 / np.sqrt(2 * hidden), (2 * hidden, len(langs)))
        params["b"] = np.zeros(len(langs))
        return cls(langs, {k: v.astype(np.float32) for k, v in params.items()})

    @property
    def hidden(self) -> int:
        return len(self.params["cf"])

    def _run(self, d: str, x: np.ndarray, active: np.ndarray, keep: list | None) -> np.ndarray:
        """States at every step; x: (T, B) bytes of windows sorted by falling length, active: windows at each step."""
        h_n, e, u, c = self.hidden, self.params[f"e{d}"], self.params[f"u{d}"], self.params[f"c{d}"]
        out = np.zeros((len(x), x.shape[1], h_n), np.float32)
        h = np.zeros((x.shape[1], h_n), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            k = active[t]
            if not k:
                continue
            old = h[:k]
            a = e[x[t, :k]]
            g = old @ u
            zr = a[:, : 2 * h_n] + g[:, : 2 * h_n]
            _sigmoid(zr)
            z, r = zr[:, :h_n], zr[:, h_n:]
            gn = g[:, 2 * h_n :] + c
            n = a[:, 2 * h_n :] + r * gn
            np.tanh(n, out=n)
            new = n + z * (old - n)
            if keep is not None:
                keep.append((t, k, old.copy(), zr, gn, n))
            h[:k] = new
            out[t, :k] = new
        return out

    def log_probs(self, x: np.ndarray, active: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """(T, B, languages)."""
        states = np.concatenate([self._run(d, x, active, None if keep is None else keep.setdefault(d, [])) for d in "fb"], axis=2)
        if keep is not None:
            keep["states"] = states
        s = states @ self.params["w"] + self.params["b"]
        s -= s.max(axis=2, keepdims=True)
        return s - np.log(np.exp(s).sum(axis=2, keepdims=True))

    def gradients(self, x: np.ndarray, active: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over bytes and its gradients, by backpropagation through time."""
        keep: dict = {}
        lp = self.log_probs(x, active, keep)
        alive = np.arange(x.shape[1])[None, :] < active[:, None]
        total, h_n = alive.sum(), self.hidden
        loss = -lp[:, np.arange(x.shape[1]), label][alive].mean()
        d_s = np.exp(lp)
        d_s[:, np.arange(x.shape[1]), label] -= 1
        d_s *= alive[:, :, None] / np.float32(total)
        flat_s, states = d_s.reshape(-1, d_s.shape[2]), keep["states"].reshape(-1, 2 * h_n)
        grads = {"w": states.T @ flat_s, "b": flat_s.sum(axis=0)}
        d_states = (flat_s @ self.params["w"].T).reshape(keep["states"].shape)
        for i, d in enumerate("fb"):
            u = self.params[f"u{d}"]
            g_e, g_u, g_c = np.zeros_like(self.params[f"e{d}"]), np.zeros_like(u), np.zeros(h_n, np.float32)
            d_h = np.zeros((x.shape[1], h_n), np.float32)
            for t, k, old, zr, gn, n in reversed(keep[d]):
                z, r = zr[:, :h_n], zr[:, h_n:]
                dh = d_h[:k] + d_states[t, :k, i * h_n : (i + 1) * h_n]
                d_n = dh * (1 - z) * (1 - n * n)
                d_z = dh * (old - n) * z * (1 - z)
                d_r = d_n * gn * r * (1 - r)
                d_gn = d_n * r
                d_a = np.concatenate([d_z, d_r, d_n], axis=1)
                d_g = np.concatenate([d_z, d_r, d_gn], axis=1)
                np.add.at(g_e, x[t, :k], d_a)
                g_u += old.T @ d_g
                g_c += d_gn.sum(axis=0)
                d_h[:k] = dh * z + d_g @ u.T
            grads |= {f"e{d}": g_e, f"u{d}": g_u, f"c{d}": g_c}
        return float(loss), grads

    def documents(self, raw: np.ndarray, offsets: np.ndarray, batch: int = 4096) -> np.ndarray:
        """Mean probabilities of every text of a block; zeros for empty texts."""
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        starts, lengths, rows = windows(offsets)
        padded = np.concatenate([raw, np.zeros(T, np.uint8)])
        for lo in range(0, len(starts), batch):
            s, n = starts[lo : lo + batch], lengths[lo : lo + batch]
            x = padded[s[None, :] + np.arange(n[0])[:, None]]
            active = np.searchsorted(-n, -np.arange(n[0]), "left")
            p = np.exp(self.log_probs(x, active))
            alive = np.arange(len(s))[None, :] < active[:, None]
            np.add.at(out, rows[lo : lo + batch], (p * alive[:, :, None]).sum(axis=0))
        return out / np.maximum(np.diff(offsets), 1)[:, None]


def train(texts: list[bytes], langs: list[str], hidden: int = 8, steps: int = 220, batch: int = 256, seed: int = 3) -> BiGRU:
    """Fit by ``steps`` batches of windows drawn from all of every text, languages in equal parts."""
    names = sorted(set(langs))
    model = BiGRU.new(names, hidden, seed)
    pieces, labels = [], []
    for text, lang in zip(texts, langs, strict=True):
        for at in range(0, len(text), T):
            pieces.append(np.frombuffer(text[at : at + T], np.uint8))
            labels.append(names.index(lang))
    if not pieces:
        return model
    y, rng, moments = np.array(labels), np.random.default_rng(seed), {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.params.items()}
    counts = np.bincount(y, minlength=len(names))
    by_lang = [np.flatnonzero(y == k) for k in range(len(names))]
    for step in range(1, steps + 1):
        which = rng.integers(len(names), size=batch)
        pick = np.array([by_lang[k][i] for k, i in zip(which, rng.integers(counts[which]), strict=True)])
        pick = pick[np.argsort([-len(pieces[i]) for i in pick], kind="stable")]
        n = np.array([len(pieces[i]) for i in pick])
        x = np.zeros((n[0], len(pick)), np.uint8)
        for j, i in enumerate(pick):
            x[: n[j], j] = pieces[i]
        _, grads = model.gradients(x, np.searchsorted(-n, -np.arange(n[0]), "left"), y[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        rate = 0.02 * min(1, 1 / max(norm, 1e-9)) * (1 - step / (steps + 1)) ** 0.5
        for k, g in grads.items():
            m, v = moments[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            model.params[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def fit(docs: DataFrame, max_rows: int = 3_000, each: int = 1_000, max_bytes: int = 4_096, seed: int = 3) -> BiGRU:
    """Train on at most ``each`` documents of a language and ``max_rows`` of all, those with the smallest hash of doc_id.

    Of a sampled text, at most ``max_bytes`` bytes come to the driver, taken from ``max_bytes // T`` places spread over it.
    Rows without a doc_id are not trained on; of rows that share one, that with the least language and bytes is.
    """
    ship(docs.sparkSession)
    rows = docs.where("doc_id is not null and lang is not null and text is not null and text rlike '\\\\p{L}'")
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    ids = rows.select("doc_id", "lang", F.xxhash64("doc_id").bitwiseAND(F.lit(2**53 - 1)).alias("h"))
    # Ids below a share of the hash's range that holds more than are wanted of a language; a window ranks these alone.
    share = (F.lit(1.5 * each + 50) / F.approx_count_distinct("doc_id")).alias("share")
    shares = ids.groupBy("lang").agg(share)
    known = shares.limit(10_001).collect()  # a row a language
    few = F.broadcast(docs.sparkSession.createDataFrame(known, "lang string, share double")) if len(known) <= 10_000 else shares
    ids = ids.join(few, "lang").where(F.col("h") < F.col("share") * F.lit(2.0**53)).drop("share").distinct()
    ids = ids.withColumn("rank", F.dense_rank().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("rank") <= each)
    chosen = ids.orderBy("rank", "h", "doc_id", "lang").limit(max_rows).select("doc_id", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                out = []
                for t in part.column("text").to_pylist():
                    raw = t.encode()
                    if len(raw) > max_bytes:
                        n = max_bytes // T
                        raw = b"".join(raw[a : a + T] for a in ((len(raw) - T) * k // (n - 1) for k in range(n)))
                    out.append(raw)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.binary()), part.column("lang")], ["doc_id", "raw", "lang"])
        release()

    rows = rows.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").select("doc_id", "text", "lang")
    got = rows.mapInArrow(run, "doc_id long, raw binary, lang string").groupBy("doc_id").agg(F.min(F.struct("lang", "raw")).alias("one")).select("doc_id", "one.lang", "one.raw").toArrow()
    got = got.sort_by("doc_id") if got.num_rows else got
    return train(got.column("raw").to_pylist(), got.column("lang").to_pylist(), seed=seed)


def predict(docs: DataFrame, model: BiGRU) -> DataFrame:
    """``(doc_id, lang_pred, score)`` of every row."""
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(model)  # some 60 KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.langs, "und"], dtype=object)
        for batch in batches:
            for part in blocks(batch, "text", 1 << 20):
                known = np.asarray(part.column("known").to_pylist(), bool) & bool(model.langs)
                p = model.documents(*flat(part.column("text"))) if model.langs else np.zeros((len(known), 1))
                best = np.where(known, p.argmax(axis=1), len(model.langs))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names[best], pa.string()), pa.array(np.where(known, np.clip(p.max(axis=1), 0, 1), 0.0))], ["doc_id", "lang_pred", "score"])
        release()

    rows = docs.select("doc_id", F.col("text"), F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("known"))
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
