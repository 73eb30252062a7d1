"""Token counts, token files and the SentencePiece codec, against the libraries themselves."""

from __future__ import annotations

import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from driftlog.llm import direct_codes as codes
from driftlog.llm.piece_ids import IdDictionary
from driftlog.llm.sentencepiece_codec import Codec, decode, encode, parse
from driftlog.llm.staging import shared_folder
from driftlog.llm.textblocks import points_of, segments, span_codes
from driftlog.llm.token_counts import PieceCounter, token_counts
from tests.llm import conftest

BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
ODD = ["", " ", "it's  we'll\n\n  don't'S 'S ''s 'street  'll\tx", "a<|endoftext|>b <|endoftext|><|startoftext|>", "  x　y ２３ ½ Ⅷ 漢字  'res 're 'r 'v", "é \U0001f600‍ x\x1c\x1dy \x85z", "a'", "İSTANBUL Σας ΣΑΣ ǅ é", "▁ ▁▁x", "\x00 �"]
rng = random.Random(3)
RANDOM = ["".join(rng.choice("ab'strevlmd  \n\t1!.éÉ▁ñß漢") for _ in range(rng.randint(0, 40))) for _ in range(3000)]


def test_counts_are_the_librarys():
    counter, library = PieceCounter(BYTE), Tokenizer.from_file(BYTE)
    for texts in (ODD, RANDOM):
        assert list(counter.count(texts)) == [len(e) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_full_dictionary_starts_anew():
    small, library = PieceCounter(BYTE, dictionary_bytes=5_000), Tokenizer.from_file(BYTE)
    for i in range(0, 300, 20):
        assert list(small.count(RANDOM[i : i + 20])) == [len(e) for e in library.encode_batch(RANDOM[i : i + 20], add_special_tokens=False)]


@given(st.text(alphabet=st.sampled_from("ab '\n\t1.é"), max_size=60))
@settings(max_examples=200, deadline=None)
def test_long_texts_are_cut_where_no_pre_token_crosses(text):
    parts = segments(text, 7)
    library = _library()
    assert "".join(parts) == text
    assert sum(len(library.encode(p, add_special_tokens=False)) for p in parts) == len(library.encode(text, add_special_tokens=False))


def _library(cache={}):  # noqa: B006
    return cache.setdefault("t", Tokenizer.from_file(BYTE))


def test_counts_of_odd_frames(spark, odd, empty):
    got = {r.doc_id: r for r in token_counts(odd, BYTE, 10).collect()}
    library = _library()
    for r in odd.collect():
        n = len(library.encode(r.text or "", add_special_tokens=False))
        assert (got[r.doc_id].n_bytes, got[r.doc_id].n_tokens, got[r.doc_id].over_limit) == (len((r.text or "").encode()), n, n > 10)
    assert token_counts(empty, BYTE).count() == 0


def test_word_ids_are_the_librarys():
    encoder, library = codes.WordEncoder(WORD), Tokenizer.from_file(WORD)
    for texts in (ODD, RANDOM):
        flat, sizes = encoder.encode(texts, 1)
        assert [list(x) for x in np.split(flat, np.cumsum(sizes)[:-1])] == [e.ids + [1] for e in library.encode_batch(texts, add_special_tokens=False)]


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500), st.data())
@settings(max_examples=60, deadline=None)
def test_codes_round_trip_and_random_access(ids, data):
    ids = np.array(ids, np.uint32)
    made = codes.Codes(codes.pack(np.array([5]), np.array([0, len(ids)]), ids))
    assert (made.range(0, len(ids)) == ids).all()
    if len(ids):
        a, b = sorted((data.draw(st.integers(0, len(ids))), data.draw(st.integers(0, len(ids)))))
        assert (made.range(a, b) == ids[a:b]).all()
        i = data.draw(st.integers(0, len(ids) - 1))
        assert made[i] == ids[i]
    with pytest.raises(IndexError):
        made[len(ids)]


def test_files_give_what_was_written(spark, odd, empty):
    files = codes.write(odd, lambda: codes.WordEncoder(WORD), 1, shared_folder(spark, "t"), files=3, ids_per_file=50)
    got = {r.doc_id: r for r in codes.read(spark, files).collect()}
    library, start = Tokenizer.from_file(WORD), 0
    for r in odd.orderBy("doc_id").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [1]
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens) == (start, len(ids))
        assert got[r.doc_id].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert codes.write(empty, lambda: codes.WordEncoder(WORD), 1, shared_folder(spark, "t")) == []
    assert codes.read(spark, []).count() == 0


def test_pieces_are_the_librarys():
    codec, own = Codec(PIECE, threads=1), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    for texts in (ODD, RANDOM):
        flat, sizes, trip, _ = codec.encode(texts)
        assert [list(x) for x in np.split(flat, np.cumsum(sizes)[:-1])] == own.encode(texts)
        assert trip.tolist() == [own.decode(own.encode(t)) == t for t in texts] and not trip[[i for i, t in enumerate(texts) if "▁" in t]].any()
        plain = [t for t in texts if "▁" not in t]  # the marker itself reads back as a blank
        assert codec.decode_batch(codec.encode_batch(plain)) == plain == own.decode(codec.encode_batch(plain))


def test_complementary_doublings_are_told_apart():
    """Thue-Morse strings of two letters and their complements, on which polynomial hashes modulo 2^64 collide."""
    texts = [t for pair in ("aq", "xz", "09", "é漢") for n in (1024, 2048) for t in conftest.doublings(*pair, n)]
    library = Tokenizer.from_file(BYTE)
    assert list(PieceCounter(BYTE).count(texts)) == [len(library.encode(t, add_special_tokens=False)) for t in texts]
    flat, sizes = codes.WordEncoder(WORD).encode(texts)
    assert [list(x) for x in np.split(flat, np.cumsum(sizes)[:-1])] == [Tokenizer.from_file(WORD).encode(t, add_special_tokens=False).ids for t in texts]
    codec, own = Codec(PIECE, threads=1), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    flat, sizes, _, parity = codec.encode(texts)
    assert [list(x) for x in np.split(flat, np.cumsum(sizes)[:-1])] == own.encode(texts)


@pytest.mark.parametrize("most", [3_000, 30_000])
def test_dictionary_of_ids_forgets_and_stays_right(most):
    known = IdDictionary(most)
    rng = np.random.default_rng(4)
    for _ in range(60):
        words = [f"w{int(x)}" for x in rng.zipf(1.3, 40).clip(max=10**9)]
        points, offsets = points_of(words)
        flat, sizes, _ = known.gather(*span_codes(points, offsets[:-1], offsets[1:]), lambda new: ([[len(w), *map(ord, w)] for w in new], None))
        assert [list(x) for x in np.split(flat, np.cumsum(sizes)[:-1])] == [[len(w), *map(ord, w)] for w in words]
        assert known.held <= most + 40 * 400


def test_documents_without_id_come_first(spark):
    rows = [(2**60 + 1, "b"), (None, "a b"), (2**60, None), (None, "a"), (2**60 + 1, "a c d")]
    files = codes.write(spark.createDataFrame(rows, "doc_id bigint, text string"), lambda: codes.word_encoder(WORD), 1, shared_folder(spark, "t"), files=2)
    got = sorted(((r.start, r.doc_id, r.n_tokens) for r in codes.read(spark, files, ids_at_once=2).collect()))
    assert [x[1] for x in got] == [None, None, 2**60, 2**60 + 1, 2**60 + 1]
    assert [x[2] for x in got] == [2, 3, 1, 4, 2] and [x[0] for x in got] == [0, 2, 5, 6, 10]


def _field(number: int, kind: int, value: bytes) -> bytes:
    def varint(n: int) -> bytes:
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    return varint(number << 3 | kind) + (varint(len(value)) if kind == 2 else b"") + value


def test_marker_in_a_text_is_no_round_trip():
    _, _, trip, parity = Codec(PIECE, threads=1).encode(["a▁b", "a b", " a", "", "▁"])
    assert trip.tolist() == [False, True, True, True, False] and parity.all()


def test_decoded_tables_are_the_librarys(spark, odd, empty):
    own = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    rows = [(r.doc_id, own.encode(r.text) if r.text is not None else None) for r in odd.collect()]
    rows += [(None, own.encode(t)) for t in ODD] + [(7, [rng.randrange(own.vocab_size()) for _ in range(30)]) for _ in range(200)]
    frame = spark.createDataFrame(rows, "doc_id bigint, ids array<int>")
    got = sorted(((r.doc_id, r.text) for r in decode(frame, PIECE, most=50).collect()), key=repr)
    assert got == sorted(((d, None if x is None else own.decode(x)) for d, x in rows), key=repr)
    plain = decode(frame.where("doc_id is null or doc_id <> 7"), PIECE).collect()
    assert all(r.parity for r in plain) and decode(encode(empty, PIECE), PIECE).count() == 0


@pytest.mark.parametrize(("prefix", "squeeze"), [(1, 0), (0, 0), (1, 1), (0, 1)])
def test_prefixes_and_blanks_of_models(tmp_path, prefix, squeeze):
    path = _unigram(tmp_path, prefix, squeeze)
    codec, own = Codec(path, threads=1), sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["ab abc cab", " ab  c ", "", "  ", "é ab", "ab", "b\u2581a"]
    flat, sizes, trip, parity = codec.encode(texts)
    assert [list(x) for x in np.split(flat, np.cumsum(sizes)[:-1])] == own.encode(texts)
    assert trip.tolist() == [own.decode(own.encode(t)) == t for t in texts] and parity.all()


def _unigram(tmp_path, prefix: int = 1, squeeze: int = 0) -> str:
    """A small unigram model with byte fallback, written by hand."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", -20.0, 6) for i in range(256)]
    pieces += [(t, s, 1) for t, s in (("▁", -2.0), ("a", -3.0), ("b", -3.1), ("ab", -3.5), ("▁ab", -4.0), ("▁a", -3.7), ("ba", -4.2), ("c", -5.0), ("abc", -6.0))]
    data = b"".join(_field(1, 2, _field(1, 2, t.encode()) + _field(2, 5, struct.pack("<f", s)) + _field(3, 0, bytes([k]))) for t, s, k in pieces)
    data += _field(2, 2, _field(3, 0, b"\x01") + _field(35 & 127, 0, b"\x01")) + _field(3, 2, _field(1, 2, b"identity") + _field(3, 0, bytes([prefix])) + _field(4, 0, bytes([squeeze])))
    path = tmp_path / "u.model"
    path.write_bytes(data)
    return str(path)


def test_unigram_scores_and_byte_fallback(tmp_path):
    path = _unigram(tmp_path)
    model = parse(open(path, "rb").read())
    assert not model.bpe and model.byte_fallback and model.dummy_prefix and not model.squeeze
    codec, own = Codec(path, threads=1), sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["ab abc cab", "abba é", "", "  a  b ", "ababab abcabc"]
    flat, sizes, trip, parity = codec.encode(texts)
    assert [list(x) for x in np.split(flat, np.cumsum(sizes)[:-1])] == own.encode(texts)
    assert trip.all() and parity[:2].all()


def test_codec_of_odd_frames(spark, odd, empty):
    own = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    for r in encode(odd, PIECE).join(odd.select("doc_id", "text"), "doc_id").collect():
        want = own.encode(r.text or "")
        assert r.ids == want and r.n_tokens == len(want) and r.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
    assert encode(empty, PIECE).count() == 0
