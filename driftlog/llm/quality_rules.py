"""Quality rules: text statistics, a base filter, and a decision list learned from labels.

Statistics are counted on whole texts by array operations. The learner grows conjunctions of
thresholds by FOIL gain on two thirds of the labelled rows, prunes each on the rest and keeps
it while it is precise there (sequential covering). A list becomes ordered Spark conditional
expressions; documents that no rule rejects are kept.

Nulls and empty texts have no words and fail the base filter. Rows that repeat, or have no doc_id,
are judged each for itself. With no labels, or labels of one class, the list is empty. Other columns stay out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from driftlog.llm.piece_ids import sums_by
from driftlog.llm.textblocks import blocks, flat, ranks, release, rows_of, ship, span_codes, words

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_upper", "n_bangs", "n_lines")
SCHEMA = "doc_id {}, " + ", ".join(f"{c} long" for c in BASE + MORE)


def _mask(symbols: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(symbols)] = True
    return out


_SYMBOL, _UPPER, _BANG = _mask(b"#*$%&|<>"), _mask(bytes(range(65, 91))), _mask(b"!")


def statistics(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of each text of a block, given as flat UTF-8."""
    n = len(offsets) - 1
    starts, ends, rows = words(raw, offsets)
    bounds = np.searchsorted(rows, np.arange(n + 1))
    inside = np.zeros(len(raw) + 1, np.int32 if len(raw) < 2**31 else np.int64)  # code points before each byte
    np.cumsum((raw & 0xC0) != 0x80, out=inside[1:])
    out = {"n_words": np.diff(bounds), "word_chars": sums_by(bounds, inside[ends] - inside[starts]), "n_symbols": sums_by(offsets, _SYMBOL[raw]), "n_bangs": sums_by(offsets, _BANG[raw])}
    latin = np.zeros(len(raw), bool)
    latin[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
    out["n_upper"] = sums_by(offsets, _UPPER[raw] | latin)

    stop = np.flatnonzero(raw == 10)
    begin = np.unique(np.concatenate([offsets[:-1], stop + 1]))
    begin = begin[begin < len(raw)]
    finish = np.append(begin[1:], len(raw))
    finish = finish - ((finish > begin) & (raw[np.maximum(finish - 1, 0)] == 10)) if len(raw) else finish
    held = np.searchsorted(starts, finish) > np.searchsorted(starts, begin)
    begin, finish = begin[held], finish[held]
    line_rows = rows_of(begin, offsets)
    out["n_lines"] = np.bincount(line_rows, minlength=n)
    codes, distinct = span_codes(raw, begin, finish)
    same = np.unique(line_rows * max(len(distinct), 1) + codes)  # row and line, once each
    out["n_dup_lines"] = out["n_lines"] - np.bincount(same // max(len(distinct), 1), minlength=n)

    codes, distinct = span_codes(raw, starts, ends)
    covered = np.zeros(len(codes) + 1, np.int8)
    if len(codes) >= 3:
        at = np.flatnonzero(rows[:-2] == rows[2:])
        pairs, n_pairs = ranks(codes[:-1].astype(np.int64) * len(distinct) + codes[1:])
        three, n_three = ranks(pairs[at] * len(distinct) + codes[at + 2])
        three, n_three = ranks(rows[at] * n_three + three)  # a window counts within its text
        at = at[np.bincount(three, minlength=n_three)[three] > 1]
        for k in range(3):
            covered[at + k] = 1
    out["n_repeat_words"] = sums_by(bounds, covered[:-1])
    return out


def text_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the counts in ``BASE`` and ``MORE`` of every row."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                got = statistics(*flat(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(got[c].astype(np.int64)) for c in BASE + MORE)], ["doc_id", *BASE, *MORE])
        release()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA.format(kind))


#: Features of the learned rules, as Spark expressions over the counts.
FEATURES = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "bangs_per_word": "n_bangs / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # feature >= threshold, else feature <= threshold
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x >= self.threshold if self.above else x <= self.threshold

    def column(self) -> Column:
        c = F.expr(FEATURES[self.feature])
        return c >= F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)


def learn(x: dict[str, np.ndarray], bad: np.ndarray, max_rules: int = 16, max_conditions: int = 4, precision: float = 0.9) -> list[list[Condition]]:
    """Rules for rejecting, each a conjunction; ``bad``: rows to reject. Every third row prunes."""
    n = len(bad)
    prune = np.arange(n) % 3 == 2
    left, rules = np.ones(n, bool), []

    def covers(rule: list[Condition]) -> np.ndarray:
        out = np.ones(n, bool)
        for c in rule:
            out &= c.holds(x[c.feature])
        return out

    def worth(rule: list[Condition]) -> float:
        hit = covers(rule) & left & prune
        p = int((hit & bad).sum())
        return (p - (int(hit.sum()) - p)) / max(int(hit.sum()), 1)

    while len(rules) < max_rules and (left & bad & ~prune).sum() >= 3:
        rule, inside = [], left & ~prune
        while len(rule) < max_conditions and (inside & ~bad).any():
            p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
            base, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
            for name, values in x.items():
                order = np.argsort(values[inside], kind="stable")
                v, b = values[inside][order], bad[inside][order]
                cut = np.flatnonzero(v[1:] > v[:-1])  # between different values only
                if not len(cut):
                    continue
                low_p, low_n = np.cumsum(b)[cut], np.cumsum(~b)[cut]
                for above, p, q in ((False, low_p, low_n), (True, p0 - low_p, n0 - low_n)):
                    with np.errstate(divide="ignore", invalid="ignore"):
                        gain = np.where(p > 0, p * (np.log2(p / (p + q)) - base), 0)
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (gain[k], Condition(name, above, float((v[cut[k]] + v[cut[k] + 1]) / 2)))
            if best[1] is None:
                break
            rule.append(best[1])
            inside &= best[1].holds(x[best[1].feature])
        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        if not rule or worth(rule) < 2 * precision - 1 or not (covers(rule) & left & bad & prune).any():
            break
        rules.append(rule)
        left &= ~covers(rule)
    return rules


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> list[list[Condition]]:
    """Learn from at most ``max_rows`` labelled documents, those with the smallest hash of doc_id.

    Of rows that share a doc_id, the one with the least counts is taken; of labels, the least.
    """
    ids = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("label"))
    chosen = F.broadcast(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    rows = text_statistics(docs.select("doc_id", "text").join(chosen.select("doc_id"), "doc_id", "left_semi"))
    rows = rows.groupBy("doc_id").agg(F.min(F.struct(*BASE, *MORE)).alias("counts")).select("doc_id", "counts.*")
    rows = rows.join(chosen, "doc_id").select("doc_id", "label", *(F.expr(e).alias(f) for f, e in FEATURES.items()))
    got = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).toPandas()
    return learn({f: got[f].to_numpy(float) for f in FEATURES}, got["label"].to_numpy() == 0) if len(got) else []


def verdict(rules: list[list[Condition]]) -> Column:
    """Ordered conditions: false for what a rule rejects, else true."""
    out = None
    for rule in rules:
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """The counts of every row, ``base_failed`` and ``kept``."""
    rows = text_statistics(docs)
    rows = rows.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))
    return rows.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict(rules)))


def keep(docs: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """The documents that are kept, with all their columns, in one pass."""
    spark = docs.sparkSession
    ship(spark)
    names = [f"_count_{c}" for c in BASE + MORE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                got = statistics(*flat(part.column("text")))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(got[c].astype(np.int64)) for c in BASE + MORE)], [*part.schema.names, *names])
        release()

    schema = StructType([*docs.schema.fields, *(StructField(n, LongType()) for n in names)])
    rows = docs.mapInArrow(run, schema)
    rows = rows.select("*", *(F.col(n).alias(c) for n, c in zip(names, BASE + MORE, strict=True) if c not in docs.columns))
    clash = [c for c in BASE + MORE if c in docs.columns]
    if clash:  # the documents' own columns of these names step aside while the rules look
        rows = rows.withColumnsRenamed({c: f"_own_{c}" for c in clash}).withColumns({c: F.col(f"_count_{c}") for c in clash})
    kept = rows.where(~F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")).where(verdict(rules))
    return kept.select(*(F.col(f"_own_{c}").alias(c) if c in clash else F.col(c) for c in docs.columns))
