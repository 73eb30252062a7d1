"""The corpus pipeline against a plain version, and the queries' SQL."""

from __future__ import annotations

import os

import duckdb
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from driftlog.llm import personal_data as pii
from driftlog.llm import quality_rules as qr
from driftlog.llm.queries import ORACLES, QUERIES
from driftlog.llm.staging import shared_folder
from tests.llm.conftest import classes
from tests.llm.test_quality import plain
from tests.llm.test_similar import _brute

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def _feature(name: str, text: str) -> float:
    n, chars, symbols, dup, repeat = plain(text)
    lines = sum(bool(line.strip(" \t\n\x0b\x0c\r")) for line in text.split("\n"))
    upper = sum(c.isascii() and c.isupper() or "À" <= c <= "Þ" and c != "×" for c in text)
    return {"symbols_per_word": symbols / max(n, 1), "repeat_share": repeat / max(n, 1), "dup_line_share": dup / max(lines, 1), "mean_word": chars / max(n, 1), "upper_share": upper / max(chars, 1), "bangs_per_word": text.count("!") / max(n, 1), "words_per_line": n / max(lines, 1)}[name]


def test_pipeline_is_the_plain_one(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    rules = qr.fit(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"))

    def kept(t: str) -> bool:
        n, _, _, _, repeat = plain(t)
        hit = lambda c: (_feature(c.feature, t) >= c.threshold) if c.above else (_feature(c.feature, t) <= c.threshold)
        return n >= 50 and 100 * repeat <= 50 * n and not any(all(hit(c) for c in rule) for rule in rules)

    docs = {d: t for d, t in docs.items() if kept(t)}
    docs = {d: docs[d] for d, (c, _) in classes(docs).items() if c == d}
    bad = {d for d, *_ in _brute(docs, items)}
    docs = {d: t for d, t in docs.items() if d not in bad}
    assert docs and bad
    clean = spark.read.parquet(f"{DATA}/documents.parquet").where(F.col("doc_id").isin(list(docs)))
    field = pii.fit(clean)  # the stage's input
    own = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, DATA).collect()}
    assert set(got) == set(docs)
    for d, t in docs.items():
        assert got[d].ids == own.encode(pii.redacted(t, pii.spans_of(t, field)[1])), d
        for kind, a, b in pii.patterns(t)[0]:  # the plain patterns' spans are gone
            assert not any(s[0] == kind and t[a:b] == own.decode(got[d].ids)[s[1] : s[2]] for s in pii.patterns(own.decode(got[d].ids))[0])
        assert got[d].round_trip and got[d].parity
    assert any(pii.patterns(t)[0] for t in docs.values())


def test_rows_without_own_ids_are_kept_once_and_cleaned(spark):
    """Null ids, two texts under one id, copies of both; a null id holding an item."""
    text = lambda s: " ".join(f"{s}{i}" for i in range(60))
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").where("length(text) > 200").first().text
    rows = [(None, text("a")), (None, text("a")), (None, text("b")), (5, text("b")), (7, text("c")), (7, text("d")), (3, text("d")), (None, item)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    once = corpus_pipeline.near_copies(spark, docs, DATA)
    want = {(None, text("a")), (5, text("b")), (7, text("c")), (3, text("d"))}
    assert sorted(map(repr, once.toLocalIterator())) == sorted(map(repr, spark.createDataFrame([*want, (None, item)], docs.schema).toLocalIterator()))
    assert {tuple(r) for r in corpus_pipeline.benchmark_items(spark, once, DATA).collect()} == want


def test_stages_of_empty_odd_and_clashing_frames(spark, odd, empty):
    """Nulls in all columns, and columns whose names the stages use themselves, through every stage."""
    more = odd.selectExpr("*", "doc_id as _own_id", "text as again", "1 as kept", "'x' as class_id", "2L as n_repeat_words", "h as bound")
    for frame in (empty, odd.where("doc_id < 0"), more, more.union(more).withColumn("doc_id", F.expr("if(doc_id % 2 = 0, null, 3)"))):
        docs = frame
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, DATA)
            assert docs.columns == frame.columns and docs.schema.simpleString() == frame.schema.simpleString()
        docs.count()
        for _, stage in corpus_pipeline.STAGES[1:4]:  # on rows that the rules would reject
            out = stage(spark, frame, DATA)
            assert out.columns == frame.columns and out.where("text is null").count() <= frame.where("text is null").count()
        assert corpus_pipeline.tokens(spark, frame, DATA).count() == frame.count()


def test_run_removes_the_tables_between(spark):
    folder = shared_folder(spark, "x").rpartition("/")[0].removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    corpus_pipeline.run(spark, DATA).count()
    assert len([x for x in set(os.listdir(folder)) - before if x.startswith("pipeline-")]) == 1


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        path = f"{DATA}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    got, want = QUERIES[name](spark, DATA).toPandas(), con.sql(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda df: sorted(df[columns].round(9).itertuples(index=False, name=None))
    assert key(got) == key(want)


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in QUERIES} == {*(f"op{i}" for i in range(1, 11)), "pipeline"}
