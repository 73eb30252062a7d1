"""Token counts without token ids.

Each task keeps a dictionary from pre-token (by its own bytes) to its number of pieces.
A block of documents is split into pre-tokens by array operations, the pre-tokens that the
dictionary lacks are counted once each by the tokenizers library, and the per-document
frequencies are joined to the dictionary and summed. Nothing is shuffled; a task's memory
is the dictionary (bounded by ``dictionary_bytes``; a full one is started anew) and a block.

Nulls and empty texts: 0 bytes, 0 tokens. Repeated rows, and rows without a doc_id: one result row
each. Other columns are ignored, whatever their names. Very long texts are read in parts that no pre-token crosses.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlog.llm.piece_ids import ENTRY, decoded
from driftlog.llm.pretokens import byte_level
from driftlog.llm.textblocks import CharClasses, blocks, points_of, release, segments, ship, span_codes


class PieceCounter:
    """Pieces of whole texts under a byte-level BPE tokenizer file."""

    def __init__(self, path: str, dictionary_bytes: int = 96 << 20) -> None:
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("a byte-level tokenizer without normalizer or added blank is needed")
        added = spec.get("added_tokens") or []
        if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that change the text around them are not supported")
        texts = sorted((t["content"] for t in added if t["content"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, texts))) if texts else None
        self.classes = CharClasses()
        self.most, self.held = dictionary_bytes, 0
        self.pieces: dict[bytes, int] = {}

    def count(self, texts: list[str]) -> np.ndarray:
        total = np.zeros(len(texts), np.int64)
        parts, owner = [], []
        for i, text in enumerate(texts):
            chunks = [text]
            if self.special is not None and self.special.search(text):
                total[i] += len(self.special.findall(text))
                chunks = self.special.split(text)
            for chunk in chunks:
                for part in segments(chunk):
                    if part:
                        parts.append(part)
                        owner.append(i)
        lo = size = 0
        for j, part in enumerate(parts):  # a block's memory stays bounded for one very long text too
            size += len(part)
            if size >= 2 << 20 or j == len(parts) - 1:
                np.add.at(total, owner[lo : j + 1], self._count(parts[lo : j + 1]))
                lo, size = j + 1, 0
        return total

    def _count(self, texts: list[str]) -> np.ndarray:
        points, offsets = points_of(texts)
        starts = byte_level(points, offsets, self.classes)
        codes, distinct = span_codes(points, starts, np.append(starts[1:], len(points)))
        keys = distinct.tolist()
        if self.held > self.most:
            self.pieces, self.held = {}, 0
        new = [k for k in keys if k not in self.pieces]
        if new:
            self.pieces.update(zip(new, map(len, self.tokenizer.encode_batch_fast(decoded(new, "utf-32-le"), add_special_tokens=False)), strict=True))
            self.held += sum(map(len, new)) + ENTRY * len(new)
        pieces = np.fromiter(map(self.pieces.__getitem__, keys), np.int64, len(keys))
        sums = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(pieces[codes], out=sums[1:])
        bounds = np.searchsorted(starts, offsets)
        return sums[bounds[1:]] - sums[bounds[:-1]]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of every row; see the module's text for nulls and so on."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        counter = PieceCounter(tokenizer)
        for batch in batches:
            for part in blocks(batch, "text"):
                text = pc.fill_null(part.column("text"), "")
                n = counter.count(text.to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("id"), pc.binary_length(text).cast(pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])
        del counter
        release()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
