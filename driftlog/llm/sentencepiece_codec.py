"""SentencePiece models run by the tokenizers library.

The model's protobuf is parsed here; normaliser, metaspace marker, unigram scores or BPE
merges and byte fallback are rebuilt as a ``tokenizers.Tokenizer``. On whole blocks the texts
are cut at the metaspace marker (no piece of such a model has it after another character,
which is checked), each distinct pre-token is encoded once by the library's threads, decoded
again and compared with the sentencepiece library's own ids. A pre-token whose ids differ
takes those of the sentencepiece library, and its documents say so in ``parity``.

Null and empty texts: no ids, round trip and parity true. Repeated rows: one result row each.
Other columns are ignored. Very long texts are read in parts that no pre-token crosses.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlog.llm.piece_ids import IdDictionary, sums_by
from driftlog.llm.textblocks import blocks, points_of, release, segments, ship, span_codes

MARK = "▁"
BLOCK = 1 << 19  # bytes of text at a time: what the libraries return for a block is many times as large
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protobuf message (integers, or bytes for the rest)."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            if kind != 2:
                raise ValueError(f"wire type {kind}")
            size = varint()
        yield key >> 3, data[i : i + size]
        i += size


@dataclass
class Model:
    pieces: list[tuple[str, float, int]]
    bpe: bool
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    squeeze: bool
    unk: int


def parse(data: bytes) -> Model:
    """What a serialised ModelProto says of pieces, trainer and normaliser."""
    pieces, bpe, fallback, charsmap, prefix, squeeze = [], False, False, b"", True, True
    for number, value in fields(data):
        if number == 1:
            text, score, kind = "", 0.0, NORMAL
            for n, v in fields(value):
                if n == 1:
                    text = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            pieces.append((text, score, kind))
        elif number == 2:
            for n, v in fields(value):
                if n == 3:
                    if v not in (1, 2):
                        raise ValueError("only unigram and BPE models are supported")
                    bpe = v == 2
                elif n == 24 and v:
                    raise ValueError("white space as a suffix is not supported")
                elif n == 35:
                    fallback = bool(v)
        elif number == 3:
            for n, v in fields(value):
                if n == 2:
                    charsmap = v
                elif n == 3:
                    prefix = bool(v)
                elif n == 4:
                    squeeze = bool(v)
    unk = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
    return Model(pieces, bpe, fallback, charsmap, prefix, squeeze, unk)


class Codec:
    """Encode and decode whole texts under a SentencePiece model file."""

    def __init__(self, path: str, threads: int = 2, check: bool = True, most: int = 48 << 20) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

        with open(path, "rb") as f:
            data = f.read()
        self.model = m = parse(data)
        if any(MARK in t.lstrip(MARK) for t, _, kind in m.pieces if kind in (NORMAL, USER_DEFINED)):
            raise ValueError("a piece has the metaspace marker after another character")
        ids = {t: i for i, (t, _, kind) in enumerate(m.pieces)}
        if m.bpe:
            merges = []
            for i in sorted(range(len(m.pieces)), key=lambda i: (-m.pieces[i][1], i)):
                t, _, kind = m.pieces[i]
                if kind in (NORMAL, USER_DEFINED) and len(t) > 1:
                    splits = [(t[:k], t[k:]) for k in range(1, len(t)) if t[:k] in ids and t[k:] in ids]
                    merges += sorted(splits, key=lambda x: (ids[x[0]], ids[x[1]]))
            model = models.BPE(vocab=ids, merges=merges, unk_token=m.pieces[m.unk][0], fuse_unk=True, byte_fallback=m.byte_fallback)
        else:
            model = models.Unigram([(t, s) for t, s, _ in m.pieces], m.unk, m.byte_fallback)
        steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
        if m.squeeze:
            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ +| +$"), "")]
        self.clean = normalizers.Sequence(steps) if steps else None
        mark = [normalizers.Prepend(MARK)] * m.dummy_prefix + [normalizers.Replace(" ", MARK)]
        self.inner = Tokenizer(model)  # for pre-tokens, which are normalised already

        def whole() -> Tokenizer:
            out = Tokenizer(model)
            out.normalizer = normalizers.Sequence([*steps, *mark])
            out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
            out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()] + [decoders.Strip(" ", 1, 0)] * m.dummy_prefix)
            return out

        self._whole, self._made = whole, None
        self.inner.decoder = decoders.Sequence([decoders.ByteFallback(), decoders.Fuse()])
        self.own = None
        if check:
            import sentencepiece

            self.own = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.is_byte = np.array([kind == BYTE for _, _, kind in m.pieces])
        self.most = most
        self.forget()

    def forget(self) -> None:
        """Start the dictionary of pre-tokens anew."""
        self.known = IdDictionary(self.most, flags=2)

    @property
    def tokenizer(self):
        """The whole tokenizer, made when first asked for: blocks of documents need its model alone."""
        self._made = self._made or self._whole()
        return self._made

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole texts by the rebuilt tokenizer alone."""
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def decode_batch(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)

    def _strings(self, strings: list[str]) -> tuple[list[list[int]], np.ndarray]:
        lists = [e.ids for e in self.inner.encode_batch_fast(strings, add_special_tokens=False)]
        flags = np.ones((len(strings), 2), bool)
        if self.own is not None:
            # The library marks the start itself, and may drop blanks there: then a letter stands before the pre-token.
            bare, asked, after = len(self.own.encode("a")), [], {}
            for i, s in enumerate(strings):
                if self.model.dummy_prefix and s[0] == MARK and s[-1] != MARK and s[1] != MARK:
                    asked.append(s[1:])
                    continue
                text = s.replace(MARK, " ")
                if s[0] == MARK and (not self.model.dummy_prefix or s[-1] == MARK):  # nothing but markers, if it ends with one
                    after[i] = True
                    text = "a" + text
                elif s[0] == MARK:
                    text = text[1:]
                asked.append(text)
            for i, ids in enumerate(self.own.encode(asked, num_threads=1)):
                ids = ids[bare:] if i in after else ids
                if ids != lists[i]:
                    flags[i, 1], lists[i] = False, ids
        back = self.inner.decode_batch(lists, skip_special_tokens=False)
        flags[:, 0] = [a == b for a, b in zip(back, strings, strict=True)]
        return lists, flags

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts one after the other; how many each has; and each text's round trip and parity."""
        parts, owner, same, parity = [], [], np.ones(len(texts), bool), np.ones(len(texts), bool)
        for i, text in enumerate(texts):
            same[i] = MARK not in text
            if self.clean is not None:
                clean = self.clean.normalize_str(text)
                same[i] &= clean == text
                if self.own is not None:
                    marked = clean.replace(" ", MARK)
                    parity[i] = self.own.normalize(text) == (MARK + marked if clean and self.model.dummy_prefix else marked)
                text = clean
            if text:
                for k, part in enumerate(segments(text)):
                    parts.append((MARK if self.model.dummy_prefix and not k else "") + part.replace(" ", MARK))
                    owner.append(i)
        sizes, wrong, got = np.zeros(len(texts), np.int64), np.zeros((len(texts), 2), np.int64), []
        lo = size = 0
        for j, part in enumerate(parts):
            size += len(part)
            if size >= BLOCK or j == len(parts) - 1:
                flat, n, bad = self._encode(parts[lo : j + 1])
                got.append(flat)
                np.add.at(sizes, owner[lo : j + 1], n)
                np.add.at(wrong, owner[lo : j + 1], bad)
                lo, size = j + 1, 0
        return np.concatenate(got) if got else np.zeros(0, np.uint32), sizes, same & (wrong[:, 0] == 0), parity & (wrong[:, 1] == 0)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        points, offsets = points_of(texts)
        mark = points == ord(MARK)
        start = mark.copy()
        start[1:] &= ~mark[:-1]
        start[offsets[:-1]] = True
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(points))
        flat, sizes, slot = self.known.gather(*span_codes(points, starts, ends), self._strings)
        bounds = np.searchsorted(starts, offsets)
        flags = self.known.flags[slot]
        return flat, sums_by(bounds, sizes), np.stack([sums_by(bounds, ~flags[:, 0]), sums_by(bounds, ~flags[:, 1])], axis=1)


@lru_cache(maxsize=1)
def codec_of(path: str, threads: int, most: int) -> Codec:
    """The process's own codec: the libraries do not give all of a codec's memory back, so tasks share one."""
    return Codec(path, threads, most=most)


def encode(docs: DataFrame, model: str, threads: int = 2, ids: bool = True, dictionary: int = 48 << 20) -> DataFrame:
    """``(doc_id, n_tokens, n_byte_tokens, ids_crc32, round_trip, parity[, ids])`` of every row.

    ``dictionary``: bytes that a worker's dictionary of pre-tokens may take.
    """
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            codec = codec or codec_of(model, threads, dictionary)
            for part in blocks(batch, "text", BLOCK):
                flat, sizes, trip, parity = codec.encode([t or "" for t in part.column("text").to_pylist()])
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                raw = flat.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                out = [part.column("doc_id"), pa.array(sizes), pa.array(sums_by(bounds, codec.is_byte[flat])), pa.array(crc, pa.int64()), pa.array(trip), pa.array(parity)]
                if ids:
                    out.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_tokens", "n_byte_tokens", "ids_crc32", "round_trip", "parity", "ids"][: len(out)])
        if codec is not None:
            codec.forget()
        release()

    more = ", ids array<int>" if ids else ""
    return docs.select(F.col("doc_id"), F.col("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, n_byte_tokens long, ids_crc32 long, round_trip boolean, parity boolean{more}")


def decode(rows: DataFrame, model: str, threads: int = 2, id_col: str = "doc_id", ids_col: str = "ids", most: int = 1 << 19) -> DataFrame:
    """``(doc_id, text, parity)`` of a table of ids, decoded some ``most`` ids at a time.

    A text that differs from the sentencepiece library's is put as the library has it, with ``parity`` false.
    """
    ship(rows.sparkSession)
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            codec = codec or codec_of(model, threads, 1 << 20)
            sizes = np.asarray(pc.fill_null(pc.list_value_length(batch.column("ids")), 0), np.int64)
            ends, lo = np.cumsum(sizes), 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
                ids = batch.column("ids").slice(lo, hi - lo).to_pylist()
                known = [x is not None for x in ids]
                texts = codec.decode_batch([x or [] for x in ids])
                own = codec.own.decode([x or [] for x in ids])
                parity = [a == b for a, b in zip(texts, own, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), pa.array([t if k else None for t, k in zip(own, known, strict=True)], pa.string()), pa.array(parity)], ["doc_id", "text", "parity"])
                lo = hi
        if codec is not None:
            codec.forget()
        release()

    return rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"doc_id {kind}, text string, parity boolean")
