"""How the sources of a language differ in their terms, by sorted runs.

Occurrences are sorted and scanned twice. Each task sorts those of a block of texts by (language, term,
source, document), and the lengths of the runs give document frequencies and counts of the block, a row for
each of its terms. These rows are dealt out by ranges of (hash of language and term, block), sorted by hash,
language, term and block, and one scan adds up the runs of a (language, term). A frequent term may lie in many
ranges; the runs at the ends of a range are marked, and put together from their parts by a small aggregate, all
others are whole and leave the scan as they are, if frequent enough.

Each language keeps the terms of at least ``least`` of its documents. A group gives a term with ``c``
occurrences there p = 1 + floor(10^9 (c + 2) / (N + 2 V)), V the language's kept terms and N the group's
occurrences of them, and two groups differ in a term by floor((p - q)^2 / (p + q)). Runs go to workers in
chunks together with the N of all groups of their language, and give partial sums of each pair of
sources and the chunk's best terms of each source; sums and ranks are finished by an aggregate and a window.

All arithmetic is of integers: 64 bits where bounded (p is at most 10^9 + 1), Python's or decimal(38)
elsewhere. Every row is a document of its own, rows that repeat and rows without a doc_id too. Null texts, languages
and sources are read as ''. A group without kept terms still is one: it has N = 0, and its pairs have values. With
no kept term at all in a language pairs have the value 0. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from driftlog.llm.staging import Tables, staged
from driftlog.llm.textblocks import U64, blocks, flat, mix, release, rows_of, ship, span_codes

SCALE = 10**9
#: Terms of a chunk, and bytes of texts of a block.
CHUNK, BLOCK = 1024, 16 << 20

_TERM = np.zeros(256, bool)
_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def term_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every term: longest runs of ASCII letters and bytes from 0x80."""
    if not len(raw):
        return (np.zeros(0, np.int64),) * 3
    solid = _TERM[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    begin, stop = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1] | edge[1:-1]
    stop[:-1] &= ~solid[1:] | edge[1:-1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(stop) + 1, rows_of(starts, offsets)


def _packed(outer: np.ndarray, key: np.ndarray, columns: list[pa.Array]) -> list[pa.Array]:
    """Columns as lists, one for each run of ``outer``."""
    offsets = pa.array(np.append(np.flatnonzero(np.append(True, outer[1:] != outer[:-1])), len(key)).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, c) for c in columns]


def _block_runs(docs: DataFrame) -> DataFrame:
    """``(h, lang, term, block, sources, df, n)``: documents and occurrences by source of a language's term in a block of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in blocks(batch, "text", BLOCK):
                raw, offsets = flat(part.column("text"))
                starts, ends, rows = term_spans(raw, offsets)
                if not len(starts):
                    continue
                codes, names = span_codes(np.take(_LOWER, raw), starts, ends)
                lang, source = (part.column(c).dictionary_encode() for c in ("lang", "source"))
                n_terms, n_sources = len(names), len(source.dictionary)
                # sorted by (language, term, source, document): runs of documents, of sources, of terms
                rows = rows.astype(np.int32)
                key = (np.asarray(lang.indices).astype(np.int64)[rows] * n_terms + codes) * n_sources + np.asarray(source.indices)[rows]
                del raw, starts, ends, codes
                order = np.argsort(key, kind="stable")  # rows ascend already
                key, rows = key[order], rows[order]
                del order
                new = np.append(True, key[1:] != key[:-1])
                at = np.flatnonzero(new)
                n = np.diff(np.append(at, len(key))).astype(np.int32)
                df = np.add.reduceat((new | np.append(True, rows[1:] != rows[:-1])).astype(np.int32), at, dtype=np.int32)
                del rows, new
                key = key[at]
                outer = key // n_sources
                each = outer[np.append(True, outer[1:] != outer[:-1])]
                hashes = np.fromiter(map(xxh3_64_intdigest, names.tolist()), U64, n_terms)
                l, t = each // n_terms, each % n_terms
                h = mix(hashes[t] + U64(0x9E3779B97F4A7C15) * np.fromiter((xxh3_64_intdigest(x) for x in lang.dictionary.to_pylist()), U64, len(lang.dictionary))[l])
                lists = _packed(outer, key, [source.dictionary.take(pa.array(key % n_sources)), pa.array(df), pa.array(n)])
                terms = pa.array(names.tolist(), pa.binary()).cast(pa.string()).take(pa.array(t))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), lang.dictionary.take(pa.array(l)), terms, pa.array(np.full(len(each), block)), *lists], ["h", "lang", "term", "block", "sources", "df", "n"])
                block += 1
        release()

    return docs.mapInArrow(run, "h long, lang string, term string, block long, sources array<string>, df array<int>, n array<int>")


CHUNKS = "lang string, terms array<string>, sizes array<int>, sources array<string>, counts array<bigint>, df bigint"


def _scan(least: int):
    """Runs of (language, term) over sorted rows: whole ones in chunks; the first and the last of a range, which may be cut, alone and with their ``df``."""

    def chunk(lang: str, terms: list, sizes: list, sources: pa.Array | list, counts: pa.Array | list, df: int | None) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int32(), pa.string(), pa.int64())
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x, k)) for x, k in zip((terms, sizes, sources, counts), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), *lists, pa.array([df], pa.int64())], ["lang", "terms", "sizes", "sources", "counts", "df"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None  # the run that may go on: (lang, term), with its documents and, by source, occurrences
        df, counts, first = 0, {}, True

        def end(cut: bool) -> Iterator[pa.RecordBatch]:
            if cut or df >= least:
                yield chunk(now[0], [now[1]], [len(counts)], list(counts), list(counts.values()), df if cut else None)

        for batch in batches:
            if not batch.num_rows:
                continue
            lang, term = (batch.column(c).dictionary_encode() for c in ("lang", "term"))
            code = np.asarray(lang.indices).astype(np.int64) * len(term.dictionary) + np.asarray(term.indices)
            new = np.append(True, code[1:] != code[:-1])
            begin = np.flatnonzero(new)
            lists = batch.column("sources")
            sizes = np.diff(np.asarray(lists.offsets))
            source = lists.flatten().dictionary_encode()
            width = len(source.dictionary)
            key, inverse = np.unique(np.repeat(np.cumsum(new) - 1, sizes) * width + np.asarray(source.indices), return_inverse=True)
            total = np.zeros((2, len(key)), np.int64)
            for k, c in enumerate(("df", "n")):
                np.add.at(total[k], inverse, np.asarray(batch.column(c).flatten()))
            of = key // width
            bounds = np.searchsorted(of, np.arange(len(begin) + 1))
            documents = np.add.reduceat(total[0], bounds[:-1])
            name = lambda r: (lang[int(begin[r])].as_py(), term[int(begin[r])].as_py())  # noqa: B023, E731
            for r in sorted({0, len(begin) - 1}):  # the runs that may go on from the batch before, or into the next one
                if r or name(0) != now:
                    if now is not None:
                        yield from end(first)
                        first = False
                    now, df, counts = name(r), 0, {}
                df += int(documents[r])
                for s, c in zip(source.dictionary.take(pa.array(key[bounds[r] : bounds[r + 1]] % width)).to_pylist(), total[1][bounds[r] : bounds[r + 1]].tolist(), strict=True):
                    counts[s] = counts.get(s, 0) + c
            inner = np.arange(1, len(begin) - 1)
            inner = inner[documents[inner] >= least]
            own = np.asarray(lang.indices)[begin[inner]]
            for k in np.unique(own).tolist():
                some = inner[own == k]
                for lo in range(0, len(some), CHUNK):
                    pick = some[lo : lo + CHUNK]
                    at = np.concatenate([np.arange(bounds[r], bounds[r + 1]) for r in pick.tolist()])
                    yield chunk(lang.dictionary[k].as_py(), term.take(pa.array(begin[pick])).dictionary_decode(), (bounds[pick + 1] - bounds[pick]).tolist(), source.dictionary.take(pa.array(key[at] % width)), pa.array(total[1][at]), None)
        if now is not None:
            yield from end(True)
        release()

    return run


def term_runs(docs: DataFrame, least: int, table: Tables) -> DataFrame:
    """The terms of at least ``least`` documents of a language, in chunks, with the occurrences in each source one after the other."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = table(_block_runs(docs), "blocks").repartitionByRange(n, "h", "block").sortWithinPartitions("h", "lang", "term", "block")
    found = table(dealt.mapInArrow(_scan(least), CHUNKS), "runs")
    parts = found.where("df is not null").select("lang", F.col("terms")[0].alias("term"), "df", "sources", "counts")  # two a range at most
    wide = parts.groupBy("lang", "term").agg(F.sum("df").alias("df")).where(F.col("df") >= least)
    cut = parts.select("lang", "term", F.inline(F.arrays_zip("sources", "counts"))).groupBy("lang", "term", "sources").agg(F.sum("counts").alias("n"))
    cut = cut.join(wide, ["lang", "term"], "left_semi").groupBy("lang", "term").agg(F.collect_list(F.struct("sources", "n")).alias("of"))  # one a source
    cut = cut.select("lang", F.array("term").alias("terms"), F.array(F.size("of")).alias("sizes"), F.col("of.sources").alias("sources"), F.col("of.n").alias("counts"))
    return table(found.where("df is null").drop("df").unionByName(cut), "terms")


def share(c: np.ndarray, n: int | np.ndarray, v: int) -> np.ndarray:
    """p of ``c`` occurrences in a group of ``n`` and ``v`` terms; products beyond 64 bits are Python's."""
    total = n + 2 * v
    if int(np.max(c, initial=0)) + 2 < 2**63 // SCALE and int(np.max(total)) < 2**63:
        return 1 + SCALE * (c + 2) // total
    return (1 + SCALE * (np.asarray(c, object) + 2) // np.asarray(total, object)).astype(np.int64)


def difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _audit(most: int, rows: int = 1 << 20):
    """Partial sums of pairs, less what two absent terms add, and the best terms of each source, by chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                lang, terms, sizes, sources, counted, groups, v = (batch.column(c)[at].as_py() for c in ("lang", "terms", "sizes", "sources", "counts", "groups", "V"))
                names = [g["source"] for g in groups]
                place = {s: i for i, s in enumerate(names)}
                total = np.array([g["N"] for g in groups], np.int64)
                zero = share(np.zeros(len(names), np.int64), total, v)
                step = max(1, rows // len(names))
                run_of, at_source = np.repeat(np.arange(len(terms)), sizes), np.array([place[s] for s in sources], np.int64)
                for lo in range(0, len(terms), step):
                    some = np.array([t.encode() for t in terms[lo : lo + step]], object)
                    mine = (run_of >= lo) & (run_of < lo + step)
                    counts = np.zeros((len(some), len(names)), np.int64)
                    counts[run_of[mine] - lo, at_source[mine]] = np.array(counted, np.int64)[mine]
                    p = share(counts, total, v)
                    q = share(counts.sum(axis=1), int(total.sum()), v)
                    value = difference(p, q[:, None])
                    own = (counts > 0) & (p > q[:, None])
                    out: list[list] = [[], [], [], []]
                    for a, name in enumerate(names):
                        sums = difference(p[:, a : a + 1], p).sum(axis=0) - len(some) * difference(zero[a], zero)
                        keep = np.flatnonzero(sums)  # the pair of a with itself is 0
                        out[0] += [name] * len(keep)
                        out[1] += ["pair"] * len(keep)
                        out[2] += [names[b] for b in keep.tolist()]
                        out[3] += sums[keep].tolist()
                        best = sorted(np.flatnonzero(own[:, a]).tolist(), key=lambda i: (-value[i, a], some[i]))[:most]  # no other term can rank
                        out[0] += [name] * len(best)
                        out[1] += ["term"] * len(best)
                        out[2] += [some[i].decode() for i in best]
                        out[3] += value[best, a].tolist()
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(out[0]), pa.string()), *(pa.array(x, pa.string()) for x in out[:3]), pa.array(out[3], pa.int64())], ["lang", "source", "part", "item", "value"])
        release()

    return run


def source_divergence(docs: DataFrame, least: int = 10, most: int = 10) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: each source beside the others of its language, and the terms it has more of than its language.

    Part ``pair`` has every other source, the difference summed over all kept terms; part ``term`` the
    ``most`` terms that the source has, with p above the language's, by the difference from the language. Ranks go by
    value, greatest first, then by item in the order of UTF-8 bytes.
    """
    ship(docs.sparkSession)
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    with Tables(docs.sparkSession, "divergence") as table:
        groups = docs.select("lang", "source").distinct()
        terms = term_runs(docs, least, table)
        sums = terms.select("lang", F.inline(F.arrays_zip(F.col("sources").alias("source"), F.col("counts").alias("n")))).groupBy("lang", "source").agg(F.sum("n").alias("n"))
        v = terms.groupBy("lang").agg(F.sum(F.size("terms")).cast("long").alias("V"))
        stats = groups.join(sums, ["lang", "source"], "left").join(v, "lang", "left")
        stats = table(stats.select("lang", "source", F.coalesce("n", F.lit(0)).cast("long").alias("N"), F.coalesce("V", F.lit(0)).cast("long").alias("V")), "groups")
        # the result has a row for each two sources of a language, so a row may hold its list of sources
        langs = stats.groupBy("lang", "V").agg(F.array_sort(F.collect_list(F.struct("source", "N"))).alias("groups"))
        langs = F.broadcast(langs) if stats.count() <= 100_000 else langs
        chunks = terms.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # few bytes, much to compute
        found = chunks.join(langs, "lang").mapInArrow(_audit(most), "lang string, source string, part string, item string, value long")
        found = table(found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")), "found")

        absent = F.lit(1) + F.expr(f"cast({2 * SCALE} as bigint) div (N + 2 * V)")
        zero = stats.select("lang", "source", "V", F.when(F.col("V") > 0, absent).otherwise(F.lit(1)).cast("long").alias("p"))
        other = zero.groupBy("lang").agg(F.collect_list(F.struct(F.col("source").alias("item"), F.col("p").alias("q"))).alias("others"))
        pairs = zero.join(other, "lang").select("lang", "source", "V", "p", F.inline("others")).where("item != source")
        pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.expr("V * (((p - q) * (p - q)) div (p + q))").alias("value"))
        made = pairs.unionByName(found.where("part = 'pair'")).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
        w = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
        pairs = made.withColumn("rank", F.row_number().over(w))
        terms = found.where("part = 'term'").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
        return staged(pairs.unionByName(terms), "divergence-rows")
