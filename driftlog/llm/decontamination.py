"""Benchmark items inside documents: bottom-k MinHash containment search by item size, then an exact check.

Words are lower-case runs of letters and digits; a shingle is ``k`` words. Items are partitioned
by their number of shingles, with bounds that double. A document is looked at, for each
partition that has items, through windows of twice the partition's bound, one bound apart: an
item lies whole in one of them. A window's signature is its ``size`` smallest distinct shingle hashes,
as an item's is, so text that repeats beside an item takes no more than its own places; a window of at most ``size`` shingles is its own signature. A document whose window
shares a signature hash with an item is a candidate. For candidates, the share of the item's
distinct shingles that the whole document holds is counted exactly: a document's shingles are cut
to those that its candidate items have, and only these are joined to the items.

All of it is made of DataFrame functions. Items of fewer than ``k`` words have one shingle, all
their words, and are sought among the documents' shingles of that many words. Null or empty items
and texts match nothing. Rows of either table that share an id are one document or item that holds
the shingles of all of them. Rows without an id are not looked at. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlog.llm.staging import Tables, semi_join, staged

LETTERS = r"[^\p{L}\p{N}]+"


def _words(text: str) -> Column:
    return F.split(F.lower(F.col(text)), LETTERS)


def _grams(hashes: str, k: int) -> Column:
    """Hash of every k words that follow each other; the words come as hashes."""
    n = F.size(hashes)
    at = F.when(n >= k, F.sequence(F.lit(0), n - F.lit(k))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.lit(k), *(F.get(F.col(hashes), i + j) for j in range(k))))


def _hashed(rows: DataFrame, keep: list[str]) -> DataFrame:
    """The words' hashes; words that regular expressions leave empty at either end stay as they are."""
    return rows.select(*keep, _words("text").alias("words")).select(*keep, F.transform("words", lambda w: F.xxhash64(w)).alias("words"))


def _windows(grams: str, bound: int, size: int) -> Column:
    """Signatures of the windows of a partition, in one array."""
    width = 2 * bound
    if width <= size:
        return F.col(grams)
    starts = F.sequence(F.lit(1), F.greatest(F.size(grams) - F.lit(bound), F.lit(1)), F.lit(bound))
    return F.flatten(F.transform(starts, lambda i: F.slice(F.sort_array(F.array_distinct(F.slice(F.col(grams), i, F.lit(width)))), 1, size)))


def contained(docs: DataFrame, items: DataFrame, k: int = 5, least: float = 0.8, size: int = 32, limit: int = 1_000_000) -> DataFrame:
    """``(doc_id, item_id, n_shared, n_shingles, containment)`` of each pair with containment of at least ``least``.

    Up to ``limit`` signature hashes of items, and as many ids of candidates, are broadcast; beyond, rows are shuffled to them.
    """
    with Tables(docs.sparkSession, "contained") as table:
        return staged(_contained(docs, items, table, k, least, size, limit), "contained-pairs")


def _contained(docs: DataFrame, items: DataFrame, table: Tables, k: int, least: float, size: int, limit: int) -> DataFrame:
    items = items.where("item_id is not null and text is not null").select("item_id", "text")
    texts = items.select("item_id", F.filter(_words("text"), lambda w: w != "").alias("words")).where(F.size("words") > 0)
    texts = texts.select("item_id", F.transform("words", lambda w: F.xxhash64(w)).alias("words"), F.least(F.size("words"), F.lit(k)).alias("k"))
    grams = F.coalesce(*(F.when(F.col("k") == j, _grams("words", j)) for j in range(1, k + 1)))
    texts = texts.select("item_id", "k", grams.alias("grams"))
    texts = texts.groupBy("item_id", "k").agg(F.array_distinct(F.flatten(F.collect_list("grams"))).alias("grams"), F.max(F.size("grams")).alias("n"))
    texts = table(texts.withColumn("bound", F.when(F.col("k") < k, F.lit(1)).otherwise(F.pow(F.lit(2), F.ceil(F.log2(F.greatest("n", F.lit(size // 2)).cast("double")))).cast("int"))), "items")
    parts = sorted(tuple(r) for r in texts.select("k", "bound").distinct().collect())  # a few dozen pairs at most
    names = docs.select(F.col("doc_id"), F.col("text")).where("doc_id is not null and text is not null")
    schema = "doc_id {}, item_id {}, n_shared long, n_shingles long, containment double".format(docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString())
    if not parts:
        return docs.sparkSession.createDataFrame([], schema)

    lengths = sorted({p[0] for p in parts})
    hashed = _hashed(names, ["doc_id"]).select("doc_id", *(_grams("words", j).alias(f"grams{j}") for j in lengths))
    own = list(dict.fromkeys((j, bound if 2 * bound > size else 0) for j, bound in parts))
    signature = F.concat(*(_windows(f"grams{j}", bound, size) for j, bound in own))
    seen = hashed.select("doc_id", F.explode(signature).alias("h"))
    wanted = texts.select("item_id", F.explode(F.slice(F.sort_array("grams"), 1, size)).alias("h"))
    n = wanted.count()
    hits = seen.join(F.broadcast(wanted) if n <= limit else wanted, "h").select("doc_id", "item_id").distinct()
    hits = table(hits, "candidates")

    exact = texts.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("grams"))).alias("grams"))
    exact = table(exact, "shingles")
    sought = hits.join(exact, "item_id").groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("grams"))).alias("sought"))
    rows = semi_join(names, hits.select("doc_id").distinct(), "doc_id", limit)
    rows = _hashed(rows, ["doc_id"]).select("doc_id", F.flatten(F.array(*(_grams("words", j) for j in lengths))).alias("grams"))
    rows = rows.join(sought, "doc_id").select("doc_id", F.explode(F.array_intersect("sought", "grams")).alias("h")).distinct()
    wanted = hits.join(exact, "item_id").select("doc_id", "item_id", F.size("grams").cast("long").alias("n_shingles"), F.explode("grams").alias("h"))
    rows = wanted.join(rows, ["doc_id", "h"]).groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"), F.max("n_shingles").alias("n_shingles"))
    return rows.withColumn("containment", F.col("n_shared") / F.col("n_shingles")).where(F.col("n_shared") * 1000 >= F.col("n_shingles") * round(least * 1000))


def clean(docs: DataFrame, items: DataFrame, limit: int = 1_000_000, **options) -> DataFrame:
    """The documents that hold no item, with all their columns; rows without a doc_id stay."""
    bad = staged(contained(docs, items, limit=limit, **options).select("doc_id").distinct(), "contaminated")
    few = bad.count() <= limit  # else the documents are shuffled to the ids
    return docs.join(F.broadcast(bad) if few else bad, "doc_id", "left_anti")
