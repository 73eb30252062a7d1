"""Rows that repeat a doc_id or have none: every operator gives a row what it gives the same text under an id of its own."""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import SparkSession

from driftlog.llm import direct_codes as codes
from driftlog.llm import language_id as lang
from driftlog.llm import masked_words as mw
from driftlog.llm import personal_data as pii
from driftlog.llm import quality_classifier as qc
from driftlog.llm import quality_rules as qr
from driftlog.llm.sentencepiece_codec import encode
from driftlog.llm.staging import in_small_batches, shared_folder
from driftlog.llm.token_counts import token_counts

DATA = "/root/testdata/sf0.001"
TEXTS = [None, "", "one two", "one two", "other text of the same id", "mail a.b@c.com or 10.0.0.1", "Le café, déjà vu", "x" * 3000, "word " * 80, None]
IDS = [None, 5, 5, 5, 5, None, 2**53 + 1, -1, None, None]
COLUMNS = "doc_id bigint, text string, lang string, quality int, n_tokens string, score string, kept int"


@pytest.fixture(scope="module")
def frames(spark):
    rows = lambda ids: [(d, t, "en", 1, "q", "z", 3) for d, t in zip(ids, TEXTS, strict=True)]
    return spark.createDataFrame(rows(IDS), COLUMNS), spark.createDataFrame(rows(range(len(TEXTS))), COLUMNS)


OPERATORS = {
    "op1": lambda d, m: token_counts(d, public_tokenizers.path("byte_bpe_50k.json")),
    "op3": lambda d, m: encode(d, public_tokenizers.path("piece_bpe_32k.model")),
    "op4": lambda d, m: qc.score(d, m["op4"]),
    "op5": lambda d, m: qr.judge(d, m["op5"]),
    "op7": lambda d, m: pii.find(d, m["op7"]),
    "op8": lambda d, m: mw.score(d, m["op8"]),
    "op9": lambda d, m: codes.read(d.sparkSession, codes.write(d, lambda: codes.word_encoder(public_tokenizers.path("word_bpe_49k.json")), 1, shared_folder(d.sparkSession, "t"))).drop("start"),
    "op10": lambda d, m: lang.predict(d, m["op10"]),
}


@pytest.fixture(scope="module")
def models(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    return {"op4": qc.fit(docs, labels), "op5": qr.fit(docs, labels), "op7": pii.fit(docs), "op8": mw.start(), "op10": lang.fit(docs)}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_results_are_by_row(frames, models, name):
    strange, plain = (OPERATORS[name](f, models) for f in frames)
    got = sorted((tuple(r) for r in strange.collect()), key=repr)
    own = {r[0]: tuple(r)[1:] for r in plain.collect()}
    want = [(d, *own[i]) for i, d in enumerate(IDS)]
    assert [g[0] for g in got] == [w[0] for w in sorted(want, key=repr)]
    for g, w in zip(got, sorted(want, key=repr), strict=True):
        assert g == pytest.approx(w) if name in ("op4", "op8", "op10") else g == w


def test_training_bears_strange_ids(frames, models):
    docs, _ = frames
    labels = docs.select("doc_id", "quality")
    assert qr.fit(docs, labels) == [] and qc.score(docs, qc.fit(docs, labels)).count() == len(IDS)
    assert pii.find(docs, pii.fit(docs)).count() == mw.score(docs, mw.fit(docs)).count() == lang.predict(docs, lang.fit(docs)).count() == len(IDS)


def test_kept_and_redacted_rows_keep_their_ids(frames, models):
    docs, _ = frames
    assert sorted((r.doc_id, r.text) for r in qr.keep(docs, []).collect()) == []  # none has fifty words that do not repeat
    got = sorted(((r.doc_id, r.text) for r in pii.redact(docs, models["op7"]).collect()), key=repr)
    assert got == sorted(((d, "mail [EMAIL] or [IP]" if t and "@" in t else t) for d, t in zip(IDS, TEXTS, strict=True)), key=repr)
    assert pii.redact(docs, models["op7"]).columns == docs.columns


def test_small_batches_leave_the_session_alone(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, frame = spark.conf.get(key), spark.range(100).repartition(1)
    small = in_small_batches(frame, 7)
    sizes = small.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
    assert max(r.n for r in sizes.collect()) == 7 and spark.conf.get(key) == before
    own = frame.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
    assert [r.n for r in own.collect()] == [100]
    assert small.join(spark.range(50), "id").count() == 50 and SparkSession.getActiveSession().conf.get(key) == before
