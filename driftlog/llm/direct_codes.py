"""Token-id files as directly addressable codes.

An id is cut into 8-bit chunks, low chunk first; level k holds the k-th chunks of the ids
that have one. Beside each level but the last stands a bitmap that says which of its
entries go on, with a directory of ranks every 512 bits, so any id is found by one rank
query a level and nothing else is decoded.

File: ``DACS`` | uint32 levels | uint64 documents | uint64 ids | doc ids (int64) | bitmap of
the documents that have a doc id (little bit order) | document starts (uint64, one more at the
end) | per level: uint64 entries, chunks, bitmap (little bit order), rank directory (uint64).

``write`` sorts documents by id over range partitions, encodes them whole and writes one or
more files a partition under the given folder; a task writes under a name of its own and
moves the file when it is whole, so a repeated task does no harm. Ids go into the chunk levels
block by block; a worker keeps its encoder, with a dictionary of bounded size, from task to task.

Null or empty texts have the end id alone. Documents without a doc_id come first and are read
back without one. Rows with the same id are ordered by their text. Extra columns are ignored.
An empty table gives no file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlog.llm.piece_ids import IdDictionary, sums_by
from driftlog.llm.pretokens import word_level
from driftlog.llm.textblocks import CharClasses, blocks, points_of, release, segments, ship, span_codes

STEP = 512


class Packer:
    """Ids by chunk levels, added part by part: two bytes a chunk are held until ``parts`` makes the file's bytes."""

    def __init__(self) -> None:
        self.n = 0
        self.levels: list[tuple[list[np.ndarray], list[np.ndarray]]] = [([], [])]

    def add(self, ids: np.ndarray) -> None:
        self.n += len(ids)
        k, rest = 0, ids
        while True:
            if k == len(self.levels):
                self.levels.append(([], []))
            more = rest > 255
            self.levels[k][0].append(rest.astype(np.uint8))
            self.levels[k][1].append(more)
            rest, k = rest[more] >> 8, k + 1
            if not len(rest):
                return

    def parts(self, doc_ids: np.ndarray, known: np.ndarray, starts: np.ndarray) -> Iterator[bytes]:
        """The file's bytes, in order, for documents whose ids lie one after the other."""
        yield b"DACS" + struct.pack("<IQQ", len(self.levels), len(doc_ids), self.n)
        yield np.asarray(doc_ids, np.int64).tobytes() + np.packbits(known, bitorder="little").tobytes() + np.asarray(starts, np.uint64).tobytes()
        for chunks, mores in self.levels:
            more = np.concatenate(mores) if mores else np.zeros(0, bool)
            ones = np.zeros(len(more) // STEP + 2, np.uint64)
            if len(more):
                sums = np.add.reduceat(more, np.arange(0, len(more), STEP), dtype=np.int64)
                np.cumsum(sums, out=ones[1 : len(sums) + 1])
                ones[len(sums) + 1 :] = ones[len(sums)]
            yield struct.pack("<Q", len(more))
            yield from (c.tobytes() for c in chunks)
            yield np.packbits(more, bitorder="little").tobytes() + ones.tobytes()


def pack(doc_ids: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> bytes:
    """The file's bytes at once."""
    packer = Packer()
    packer.add(ids.astype(np.uint32))
    return b"".join(packer.parts(doc_ids, np.ones(len(doc_ids), bool), starts))


class Codes:
    """A file's bytes, open for reading any id or any range of ids."""

    def __init__(self, data: bytes | memoryview) -> None:
        if bytes(data[:4]) != b"DACS":
            raise ValueError("not a file of directly addressable codes")
        levels, docs, self.n = struct.unpack_from("<IQQ", data, 4)
        at = 24

        def take(kind: type, count: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(data, kind, count, at)
            at += x.nbytes
            return x

        self.doc_ids = take(np.int64, docs)
        self.known = np.unpackbits(take(np.uint8, (docs + 7) // 8), count=docs, bitorder="little").astype(bool)
        self.starts, self.levels = take(np.uint64, docs + 1).astype(np.int64), []
        for _ in range(levels):
            n = int(take(np.uint64, 1)[0])
            self.levels.append((take(np.uint8, n), take(np.uint8, (n + 7) // 8), take(np.uint64, n // STEP + 2)))

    @staticmethod
    def _rank(bits: np.ndarray, ones: np.ndarray, i: int) -> int:
        """Set bits before position i."""
        block = i // STEP
        part = bits[block * (STEP // 8) : (i + 7) // 8]
        return int(ones[block]) + int(np.unpackbits(part, bitorder="little")[: i - block * STEP].sum())

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for chunks, bits, ones in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            i, shift = self._rank(bits, ones, i), shift + 8
        return value

    def range(self, a: int, b: int) -> np.ndarray:
        """Ids a to b - 1."""
        if not 0 <= a <= b <= self.n:
            raise IndexError((a, b))
        out = np.zeros(b - a, np.uint32)
        at, shift = np.arange(b - a), 0
        for chunks, bits, ones in self.levels:
            out[at] |= chunks[a:b].astype(np.uint32) << np.uint32(shift)
            lo = a // 8 * 8
            more = np.unpackbits(bits[lo // 8 : (b + 7) // 8], bitorder="little")[a - lo : b - lo].astype(bool)
            at = at[more]
            if not len(at):
                break
            first = self._rank(bits, ones, a)
            a, b, shift = first, first + len(at), shift + 8
        return out


class WordEncoder:
    """Whole texts to ids by a tokenizer file with NFC and lower case, a word pattern and BPE with word ends."""

    def __init__(self, path: str) -> None:
        import json
        import re

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        if kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("a tokenizer with NFC, white space and lower case normalisers is needed")
        added = spec.get("added_tokens") or []
        if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that change the text around them are not supported")
        self.special = {t["content"]: t["id"] for t in added}
        self.splitter = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if added else None
        self.classes, self.known = CharClasses(), IdDictionary(192 << 20)

    def _normal(self, text: str) -> str:
        if text.isascii() or max(text) < "ɐ":
            return text.lower()
        return self.tokenizer.normalizer.normalize_str(text)

    def _strings(self, strings: list[str]) -> tuple[list[list[int]], None]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)], None

    def encode(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other (``end`` after each, if given), and how many each has."""
        parts, owner, ids, sizes = [], [], [], np.zeros(len(texts), np.int64)
        fixed: list[tuple[int, int]] = []  # (part before which it stands, id)
        for i, text in enumerate(texts):
            for chunk in self.splitter.split(text) if self.splitter and self.splitter.search(text) else [text]:
                if chunk in self.special:
                    fixed.append((len(parts), self.special[chunk]))
                    sizes[i] += 1
                elif chunk:
                    for part in segments(self._normal(chunk)):
                        parts.append(part)
                        owner.append(i)
            if end is not None:
                fixed.append((len(parts), end))
                sizes[i] += 1
        got, counts = [], np.zeros(len(parts), np.int64)
        lo = size = 0
        for j, part in enumerate(parts):
            size += len(part)
            if size >= 2 << 20 or j == len(parts) - 1:
                flat, counts[lo : j + 1] = self._encode(parts[lo : j + 1])
                got.append(flat)
                lo, size = j + 1, 0
        np.add.at(sizes, owner, counts)
        flat = np.concatenate(got) if got else np.zeros(0, np.uint32)
        if fixed:
            before = np.concatenate([[0], np.cumsum(counts)])
            flat = np.insert(flat, before[[k for k, _ in fixed]], np.array([v for _, v in fixed], np.uint32))
        return flat, sizes

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        points, offsets = points_of(texts)
        starts, ends = word_level(points, offsets, self.classes)
        flat, sizes, _ = self.known.gather(*span_codes(points, starts, ends), self._strings)
        return flat, sums_by(np.searchsorted(starts, offsets), sizes)


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """The process's own encoder: its dictionary of bounded size serves all tasks of a worker."""
    return WordEncoder(path)


def write(docs: DataFrame, encoder: Callable[[], WordEncoder], end: int, folder: str, files: int | None = None, ids_per_file: int = 8 << 20) -> list[tuple[str, int, int]]:
    """Write the ids of all documents; ``(file, documents, ids)`` of each file, in the order of the ids."""
    spark = docs.sparkSession
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyarrow import fs
        from pyspark import TaskContext

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        task, made = TaskContext.get(), None
        where, root = fs.FileSystem.from_uri(folder)
        packer, doc_ids, known, sizes, rows = Packer(), [], [], [], []

        def flush() -> None:
            nonlocal packer
            if not doc_ids:
                return
            name = f"part-{task.partitionId():06d}-{len(rows):04d}.dac"
            n = np.concatenate(sizes)
            where.create_dir(root, recursive=True)
            own = f"{root}/.{name}-{task.taskAttemptId()}"
            with where.open_output_stream(own) as out:
                for part in packer.parts(np.concatenate(doc_ids), np.concatenate(known), np.concatenate([[0], np.cumsum(n)])):
                    out.write(part)
            where.move(own, f"{root}/{name}")
            rows.append((name, len(n), packer.n))
            packer = Packer()
            for x in (doc_ids, known, sizes):
                x.clear()

        for batch in batches:
            made = made or encoder()
            for part in blocks(batch, "text"):
                flat, n = made.encode([t or "" for t in part.column("text").to_pylist()], end)
                ids = part.column("doc_id")
                doc_ids.append(np.asarray(pc.fill_null(ids, 0), np.int64))
                known.append(np.asarray(ids.is_valid()))
                sizes.append(n)
                packer.add(flat)
                if packer.n >= ids_per_file:
                    flush()
        flush()
        release()
        if rows:
            yield pa.RecordBatch.from_pydict({"file": [r[0] for r in rows], "docs": [r[1] for r in rows], "ids": [r[2] for r in rows]})

    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    done = rows.mapInArrow(run, "file string, docs long, ids long").collect()  # one row a file
    return [(f"{folder}/{r.file}", r.docs, r.ids) for r in sorted(done, key=lambda r: r.file)]


def read(spark, files: list[tuple[str, int, int]], ids_at_once: int = 1 << 20) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from the files alone, some ids at a time."""
    ship(spark)
    schema, first, rows = "doc_id long, start long, n_tokens long, ids_crc32 long", 0, []
    for path, _, n in files:
        rows.append((path, first))
        first += n
    if not rows:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                where, name = fs.FileSystem.from_uri(path)
                with where.open_input_stream(name) as f:
                    codes = Codes(f.read())
                lo, docs = 0, len(codes.doc_ids)
                while lo < docs:
                    hi = max(lo + 1, int(np.searchsorted(codes.starts, codes.starts[lo] + ids_at_once, "right")) - 1)
                    a = codes.starts[lo : hi + 1]
                    ids = memoryview(codes.range(int(a[0]), int(a[-1])).astype("<u4")).cast("B")
                    at = (4 * (a - a[0])).tolist()
                    crc = [zlib.crc32(ids[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(codes.doc_ids[lo:hi], mask=~codes.known[lo:hi]), pa.array(a[:-1] + base), pa.array(np.diff(a)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    lo = hi
        release()

    table = spark.createDataFrame(rows, "path string, base long").repartition(len(rows))
    return table.mapInArrow(run, schema)
