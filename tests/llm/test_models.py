"""Personal data, masked scores and language identification."""

from __future__ import annotations

import hashlib
import pathlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftlog.llm import language_id as lang
from driftlog.llm import masked_words as mw
from driftlog.llm import personal_data as pii
from driftlog.llm.textblocks import flat

DATA = "/root/testdata/sf0.01"
BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain(text: str) -> list[pii.Span]:
    return [(k, m.start(), m.end()) for k, p in BASE for m in re.finditer(p, text) if pii.valid(k, m.group())]


def test_patterns_are_the_plain_ones():
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab@.+-1239 ()%_") for _ in range(rng.randint(0, 40))) for _ in range(8000)]
    texts += ["1.2.3.4.5.6.7.8 300.1.1.1 a@b@c.d.e", "001.0255.3.4", "9" * 3000, "a" * 50_000 + "@", "1." * 2000]
    for t in texts:
        assert pii.patterns(t)[0] == plain(t)


def test_luhn():
    assert pii.luhn("4539578763621486") and not pii.luhn("4539578763621487")


def test_long_runs_take_time_in_proportion():
    import time

    began = time.time()
    for t in ("a" * 1_000_000, "1" * 1_000_000, "a.b" * 300_000 + "@", "1.2." * 200_000, "+1" * 200_000):
        pii.patterns(t)
    assert time.time() - began < 30


@pytest.fixture(scope="module")
def model(spark):
    return pii.fit(spark.read.parquet(f"{DATA}/documents.parquet"))


def test_field_parts_what_a_pattern_ran_together(model):
    text = "x 4539578763621486 4716059138270165 y +1 (826) 555-4081 190.137.223.204 z"
    good, every = pii.spans_of(text, model)
    assert good == plain(text) and set(good) <= set(every)
    found = {(k, text[a:b]) for k, a, b in every}
    assert {("card", "4539578763621486"), ("ip", "190.137.223.204"), ("phone", "+1 (826) 555-4081")} <= found
    assert "555" not in pii.redacted(text, every) and pii.redacted("a b", []) == "a b"


def test_field_leaves_plain_numbers_alone(model):
    for text in ("version 2.0.1 of 2024-11-26 at 10:20:30", 'token = "2321bac4d15ec8f90433955bf9d3cf61da5bdd1e"', "pages 1234 to 5678", "4539578763621487 is no card"):
        assert pii.spans_of(text, model) == ([], [])


def test_field_gradient_and_best_by_enumeration():
    text = "+1 22 333-4444 5.6.7.8"
    zone = pii.Zone.of(text, 0, len(text))
    segments = list(zone.segments)
    names = sorted({x for here in segments for _, f in here for x in f})
    field = pii.Field({x: i for i, x in enumerate(names)}, np.random.default_rng(0).normal(0, 0.7, (len(names), len(pii.KINDS))))
    n = len(zone.starts)

    def all_ways(j):  # every segmentation of tokens 0 to j - 1, with its score
        if j == 0:
            return [((), 0.0)]
        out = list(all_ways(j - 1))
        for i, f in segments[j - 1]:
            s = field.scores(f)
            out += [((*w, (i, j - 1, k)), v + s[k]) for w, v in all_ways(i) for k in range(len(pii.KINDS))]
        return out

    ways = all_ways(n)
    assert field.best(zone) == list(max(ways, key=lambda x: x[1])[0])
    gold, grad = set(ways[5][0]), np.zeros_like(field.weights)
    field.gradient(zone, gold, grad)
    z = np.logaddexp.reduce([v for _, v in ways])
    want = np.zeros_like(grad)
    feats = {(i, j): f for j, here in enumerate(segments) for i, f in here}
    for way, v in [(tuple(gold), None), *ways]:
        weight = 1.0 if v is None else -np.exp(v - z)
        for i, j, k in way:
            for x in feats[i, j]:
                want[field.index[x], k] += weight
    assert np.allclose(grad, want)


def test_number_tables_take_little_memory(model):
    """One zone of five million characters, and one with an entity in every line."""
    import pickle
    import subprocess
    import sys

    code = """
import pickle, random, resource, sys
from driftlog.llm import personal_data as pii
model = pickle.load(sys.stdin.buffer)
rng = random.Random(1)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
text = " ".join(str(rng.randrange(10**9)) for _ in range(500_000))
assert len(pii.zones(text)) == 1 and len(text) > 4_900_000
for _ in pii.Zone.of(text, 0, len(text)).segments:
    pass
lines = " ".join("4539578763621486 x" for _ in range(20_000))
good, every = pii.spans_of(lines, model)
assert len(good) == 20_000 and every == good
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""
    out = subprocess.run([sys.executable, "-c", code], input=pickle.dumps(model), capture_output=True, timeout=600, cwd=pathlib.Path(__file__).parents[2])
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) < 300_000  # KB


def test_personal_data_of_odd_frames(spark, odd, empty, model):
    for r in pii.find(odd, model).join(odd.select("doc_id", "text"), "doc_id").collect():
        base = plain(r.text or "")
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in pii.KINDS)
        assert r.n_spans == (len(r.spans.split(",")) if r.spans else 0) >= len(base)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
    out = {r.doc_id: r.text for r in pii.redact(odd, model).collect()}
    assert out[0] is None and out[1] == "" and out[9] == "mail [EMAIL] or [PHONE] at [IP]"
    assert pii.redact(odd, model).columns == odd.columns and pii.find(empty, model).count() == 0
    assert pii.spans_of("a@b.com", pii.fit(empty)) == ([("email", 0, 7)],) * 2


def test_masked_training_beats_word_frequencies(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    held = docs.where("doc_id % 5 = 0")
    got = mw.score(held, mw.fit(docs.where("doc_id % 5 <> 0"))).agg(F.sum("sum_logprob") / F.sum("n_tokens")).first()[0]
    _, digits, _ = mw.windows(*flat(pa.array([r.text for r in held.collect()])))
    _, inverse, counts = np.unique(digits, axis=0, return_inverse=True, return_counts=True)
    assert got > np.log(counts[inverse] / len(digits)).mean()  # frequencies of the held-out rows themselves


def test_masked_scores_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (1, 64):
            spark.conf.set("spark.sql.shuffle.partitions", str(min(n, 16)))
            params = mw.fit(docs.repartition(n), shard=40_000)
            got.append({r.doc_id: r.mean_logprob for r in mw.score(docs, params).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0].keys() == got[1].keys() and all(got[1][d] == pytest.approx(x, abs=1e-3) for d, x in got[0].items())


def test_masked_training_is_the_plain_loop(spark):
    """Rounds, shards, pieces and averages, row by row; texts of which one fills a piece alone."""
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(["one", "two,", "three", "é漢"]) for _ in range(rng.choice([0, 3, 40, 900])))) for i in range(60)] + [(3, None), (None, "x y")], "doc_id bigint, text string")
    size, rounds = sum(len((r.text or "").encode()) for r in docs.collect()), 2
    n, most = max(1, round(size / rounds / 20_000)), 1 << 20
    h = F.xxhash64("doc_id", "text")
    rows = docs.where("text is not null").select(F.pmod(h, F.lit(rounds)).alias("r"), F.pmod(F.xxhash64(h, F.lit(1)), F.lit(n)).alias("s"), h.alias("h"), "text").collect()
    _, digits, _ = mw.windows(*flat(pa.array([x.text for x in rows])))
    counts = np.zeros(mw.WAYS**3)
    np.add.at(counts, (digits[:, 0] * mw.WAYS + digits[:, 1]) * mw.WAYS + digits[:, 2], 1)
    fixed = mw.prior(counts)
    assert fixed["q1"][digits[0, 0]] == pytest.approx(np.log(((digits[:, 0] == digits[0, 0]).sum() + 0.1) / (len(digits) + 6.4)), abs=1e-5)
    params = mw.start() | fixed
    for r in range(rounds):
        total, weight = 0.0, 0
        for s in range(n):
            p, own = {k: v.copy() for k, v in params.items()}, 0
            squares = {k: np.zeros_like(v) for k, v in p.items()}
            piece, held = [], 0
            mine = sorted(((x.h, x.text) for x in rows if x.r == r and x.s == s))
            for i, (_, text) in enumerate(mine):
                piece.append(text)
                held += len(text.encode())
                if held >= most or i == len(mine) - 1:
                    around, digits, _ = mw.windows(*flat(pa.array(piece)))
                    mw.learn(p, squares, around, digits, 0.1 / (r + 1), r)
                    own += len(digits)
                    piece, held = [], 0
            total, weight = total + own * mw.pack(p).astype(np.float64), weight + own
        params = mw.unpack((total / weight).astype(np.float32)) | fixed
    got = mw.fit(docs.repartition(5), rounds=rounds, shard=20_000)
    assert n > 1 and got.keys() == params.keys()
    assert max(float(np.abs(got[k] - params[k]).max()) for k in params) < 1e-4


@pytest.mark.parametrize("cuts", [[], [1, 2, 3], [5], [2, 9]])
def test_pieces_do_not_depend_on_batches(cuts):
    texts, shards = ["a" * k for k in (3, 9, 0, 4, 4, 12, 1, 1, 1, 30, 2)], [0, 0, 0, 0, 0, 1, 1, 1, 1, 3, 3]
    whole = pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(texts)], ["shard", "text"])
    batches = [whole.slice(a, b - a) for a, b in zip([0, *cuts], [*cuts, len(texts)], strict=True)]
    got = [(s, [len(x) for x in t.to_pylist()]) for s, t in mw.pieces(iter(batches), 10)]
    assert got == [(0, [3, 9]), (0, [0, 4, 4]), (1, [12]), (1, [1, 1, 1]), (3, [30]), (3, [2])]


def test_word_tokens_cover_all_bytes():
    texts = ["", " \n", "one, two  three.\n", "漢字é x", "a", "b "]
    raw, offsets = flat(pa.array(texts))
    starts, ends, rows = mw.tokens(raw, offsets)
    got = [[raw[a:b].tobytes().decode() for a, b, r in zip(starts, ends, rows, strict=True) if r == i] for i in range(len(texts))]
    assert got == [[], [" \n"], ["one", ",", " two", "  three", ".", "\n"], ["漢", "字", "é", " x"], ["a"], ["b", " "]]


def test_masked_word_gradients():
    p = {k: v.astype(np.float64) for k, v in mw.start().items()}
    around, digits, _ = mw.windows(*flat(pa.array(["one two three one four", "two"])))
    assert (around[-1] == 0).all() and around[0, 3] == around[2, 2]
    for k, g in mw.gradients(p, around, digits)[1].items():
        if k in mw.SPARSE:
            full = np.zeros_like(p[k])
            full[g[0]] = g[1]
            g = full
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        keep, ends = p[k][i], []
        for d in (1e-4, -1e-4):
            p[k][i] = keep + d
            ends.append(mw.gradients(p, around, digits)[0])
        p[k][i] = keep
        assert g[i] == pytest.approx((ends[0] - ends[1]) / 2e-4, rel=1e-4)


def test_masked_gradients_do_not_depend_on_tiles(monkeypatch):
    """Gradients and scores of a batch in tiles of 7 rows and in one; logits beyond the range of exponentials of 32 bits too."""
    rng = random.Random(5)
    around, digits, _ = mw.windows(*flat(pa.array([" ".join(rng.choice(["one", "two,", "three"]) for _ in range(40))])))
    for scale in (1.0, 300.0):
        p = {k: v.astype(np.float64) * (scale if k[0] == "v" else 1) for k, v in mw.start().items()}
        got = []
        for tile in (7, 1 << 20):
            monkeypatch.setattr(mw, "TILE", tile)
            got.append((*mw.gradients(p, around, digits), mw.log_probs(p, around, digits)))
        assert np.isfinite(got[0][0]) and got[0][0] == pytest.approx(got[1][0]) and got[0][0] == pytest.approx(-got[0][2].mean(), rel=1e-5)
        assert np.allclose(got[0][2], got[1][2])
        for k, g in got[0][1].items():
            assert all(np.allclose(a, b) for a, b in (zip(g, got[1][1][k], strict=True) if k in mw.SPARSE else [(g, got[1][1][k])]))


class _Counted:
    """NumPy, with the elements counted whose exponentials or hyperbolic tangents are taken."""

    def __init__(self):
        self.n = 0

    def __getattr__(self, name):
        def counted(x, *args, **named):
            self.n += np.size(x)
            return getattr(np, name)(x, *args, **named)

        return counted if name in ("exp", "tanh") else getattr(np, name)


def test_masked_layers_take_one_exponential_a_hidden_unit(monkeypatch):
    """A token takes those of its hidden layer once, not once a digit, beside those of its logits and of the tables of a batch."""
    around, digits, _ = mw.windows(*flat(pa.array([" ".join(f"w{i * i % 977}" for i in range(6000))])))
    p, tables = mw.start(), (mw.WAYS + mw.WAYS**2) * mw.HIDDEN
    for run in (mw.log_probs, mw.gradients):
        counted = _Counted()
        monkeypatch.setattr(mw, "np", counted)
        run(p, around, digits)
        monkeypatch.setattr(mw, "np", np)
        assert counted.n <= tables + len(digits) * (3 * mw.WAYS + mw.HIDDEN)


@pytest.mark.parametrize("scale", [1.0, 30.0, 90.0, 3000.0])
@pytest.mark.parametrize("kind", [np.float32, np.float64])
def test_masked_scores_at_the_ends_of_the_hidden_layer(scale, kind):
    """Hidden layers as hyperbolic tangents, where exponentials of 32 bits end too; tables of digits small, large and against the inputs."""
    around, digits, _ = mw.windows(*flat(pa.array([" ".join(f"w{i * i % 97}" for i in range(300)) + "\n漢é"])))
    for of in (("w",), ("p2", "p3"), ("w", "p2", "p3")):
        p = {k: (v * (scale if k in of else 1)).astype(kind) for k, v in mw.start(3).items()}
        if of == ("w", "p2", "p3"):  # sums of large numbers that are small
            a = p["e"][around].reshape(len(around), -1) @ p["w"] + p["b"]
            p["p2"][digits[:, 0]] = 0.5 - a
        wide = {k: v.astype(np.float64) for k, v in p.items()}
        a = wide["e"][around].reshape(len(around), -1) @ wide["w"] + wide["b"]
        want = 0.0
        for j, add in enumerate((0, wide["p2"][digits[:, 0]], wide["p3"][digits[:, 0] * mw.WAYS + digits[:, 1]]), 1):
            s = np.tanh(a + add) @ wide[f"v{j}"] + wide[f"c{j}"]
            want = want + s[np.arange(len(s)), digits[:, j - 1]] - np.log(np.exp(s).sum(axis=1))
        with np.errstate(all="raise", under="ignore"):
            got = mw.log_probs(p, around, digits)
        assert np.allclose(got, want, atol=1e-4 if kind == np.float64 else 1e-4 * max(1, scale / 30))


def test_masked_word_scores_are_the_plain_sums(spark, odd, empty):
    params = mw.start(4)
    for r in mw.score(odd, params).join(odd.select("doc_id", "text"), "doc_id").collect():
        around, digits, _ = mw.windows(*flat(pa.array([r.text], pa.string())))
        assert r.n_tokens == len(digits) and (r.mean_logprob is None) == (not r.text)
        if len(digits) > 6000:
            continue
        want = 0.0
        for x, (a, b, c) in zip(around, digits, strict=True):
            top = params["e"][x].ravel() @ params["w"] + params["b"]
            for j, (t, h) in enumerate(((a, top), (b, top + params["p2"][a]), (c, top + params["p3"][a * mw.WAYS + b])), 1):
                s = (np.tanh(h) @ params[f"v{j}"] + params[f"c{j}"]).astype(np.float64)
                want += s[t] - np.log(np.exp(s).sum())
        assert r.sum_logprob == pytest.approx(want, rel=1e-4, abs=1e-3)
    assert mw.score(empty, params).count() == 0
    assert all((a == b).all() for a, b in zip(mw.fit(empty).values(), mw.start().values(), strict=True))


def test_shuffled_words_score_below_the_text(spark, tmp_path):
    """Words begin and end alike, so that their order is not seen in the two bytes beside a byte."""
    from driftlog.llm.queries import op8_masked_scores

    rng = random.Random(3)
    slots = [["qa" + "".join(rng.choice("bcdefghij") for _ in range(4)) + "aq" for _ in range(3)] for _ in range(12)]
    texts = [[rng.choice(slots[(i + j) % 12]) for j in range(60)] for i in range(3000)]
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(10_000 + i, " ".join(rng.sample(t, 60))) for i, t in enumerate(texts[:60])]
    spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.sum_logprob for r in op8_masked_scores(spark, str(tmp_path)).collect()}
    gap = np.mean([(got[i] - got[10_000 + i]) / len(docs[i][1]) for i in range(60)])
    assert gap > 0.02


def test_language_gradients():
    m = lang.BiGRU.new(["a", "b"], 3, 0)
    m.params = {k: v.astype(np.float64) for k, v in m.params.items()}
    x, active, y = np.random.default_rng(0).integers(0, 256, (5, 3)).astype(np.uint8), np.array([3, 3, 2, 2, 1]), np.array([0, 1, 0])
    _, grads = m.gradients(x, active, y)
    for k, g in grads.items():
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        keep, ends = m.params[k][i], []
        for d in (1e-3, -1e-3):
            m.params[k][i] = keep + d
            ends.append(m.gradients(x, active, y)[0])
        m.params[k][i] = keep
        assert g[i] == pytest.approx((ends[0] - ends[1]) / 2e-3, rel=5e-3)


def test_windows_cover_whole_texts():
    offsets = np.array([0, 0, 5, 133, 261])
    starts, lengths, rows = lang.windows(offsets, 64)
    seen = np.zeros(261, int)
    for s, n, r in zip(starts, lengths, rows, strict=True):
        seen[s : s + n] += 1
        assert offsets[r] <= s and s + n <= offsets[r + 1]
    assert (seen == 1).all() and list(lengths) == sorted(lengths, reverse=True)


def test_document_probabilities_do_not_depend_on_batches():
    m = lang.BiGRU.new(["a", "b", "c"], 4, 1)
    raw, offsets = flat(pa.array(["x" * 200, "", "hello", "é" * 90]))
    a, b = m.documents(raw, offsets, 4096), m.documents(raw, offsets, 3)
    assert np.allclose(a, b, atol=1e-5) and np.allclose(a.sum(axis=1), [1, 0, 1, 1], atol=1e-5)


def test_language_on_held_out_rows(spark, odd, empty):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    m = lang.fit(docs.where(fold != 2))
    rows = lang.predict(docs.where(fold == 2), m).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (rows.lang_pred == rows.lang).mean() > 0.97 and rows.score.between(0, 1).all()
    got = {r.doc_id: r for r in lang.predict(odd, m).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and got[0].score == 0.0
    assert got[7].lang_pred == got[8].lang_pred != "und" and lang.predict(empty, m).count() == 0
    none = lang.fit(empty)
    assert {r.lang_pred for r in lang.predict(odd, none).collect()} == {"und"}


def test_language_scores_are_the_plain_ones(spark):
    """Each window byte by byte, both ways, and the mean over a document's bytes."""
    m = lang.BiGRU.new(["a", "b", "c"], 5, 9)
    p, sig = {k: v.astype(float) for k, v in m.params.items()}, lambda x: 1 / (1 + np.exp(-x))

    def states(raw: bytes, d: str) -> list[np.ndarray]:
        h, out = np.zeros(5), []
        for c in raw if d == "f" else raw[::-1]:
            e, g = p[f"e{d}"][c], h @ p[f"u{d}"]
            z, r = sig(e[:5] + g[:5]), sig(e[5:10] + g[5:10])
            n = np.tanh(e[10:] + r * (g[10:] + p[f"c{d}"]))
            h = (1 - z) * n + z * h
            out.append(h)
        return out if d == "f" else out[::-1]

    texts = ["hello", "é" * 70, "x y " * 60, "a", "漢字 mixed \U0001f600 text " * 9, "123", None, ""]
    got = {r.doc_id: r for r in lang.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), m).collect()}
    for i, t in enumerate(texts):
        if not t or t == "123":
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        raw, total = t.encode(), np.zeros(3)
        for lo in range(0, len(raw), lang.T):
            for f, b in zip(states(raw[lo : lo + lang.T], "f"), states(raw[lo : lo + lang.T], "b"), strict=True):
                s = np.exp(np.concatenate([f, b]) @ p["w"] + p["b"])
                total += s / s.sum()
        total /= len(raw)
        assert got[i].lang_pred == "abc"[total.argmax()] and got[i].score == pytest.approx(total.max(), abs=1e-5)


def test_rare_languages_are_learned_and_ids_count_once(spark):
    """Three documents of a language among 1,500 of another; a doc_id repeated; rows without one."""
    rows = [(i, f"the quick brown fox {i} jumps", "en") for i in range(1500)] + [(5000 + i, "żółć gęślą jaźń " * 5, "pl") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    more = docs.union(spark.createDataFrame([rows[0]] * 40 + [(None, "qqqq", "zz")], docs.schema))
    a, b = lang.fit(docs, max_rows=200, each=100), lang.fit(more, max_rows=200, each=100)
    assert a.langs == b.langs == ["en", "pl"] and all((a.params[k] == b.params[k]).all() for k in a.params)
    got = {r.doc_id: r.lang_pred for r in lang.predict(docs, a).collect()}
    assert got[5000] == "pl" and got[7] == "en"
