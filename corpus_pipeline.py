"""A corpus pipeline over ``documents``: rules, near copies, benchmark items, personal data, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and returns a frame, which is written as Parquet and
read again as the next stage's documents. All stages but the last return the documents' columns.

Null and empty texts fail the base filter of the rules. Rows without a doc_id, or that repeat one with
another text, are documents as all others. Rows alike in id and text are one. Other columns, whatever
their names, stay as they are. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlog.llm import personal_data, quality_rules
from driftlog.llm.decontamination import clean
from driftlog.llm.jaccard_join import jaccard_join
from driftlog.llm.sentencepiece_codec import encode
from driftlog.llm.staging import Tables, in_small_batches, remove, semi_join, shared_folder, staged


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base filter and the learned rules; rows without a doc_id are judged by their text all the same."""
    docs = in_small_batches(docs)
    found = quality_rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.keep(docs, found)


def _named(docs: DataFrame) -> tuple[DataFrame, str]:
    """Rows named by id and text, as ids may be null or repeated, and the column that has their own ids."""
    own = "_own_id"
    while own in docs.columns:
        own = "_" + own
    return docs.withColumnRenamed("doc_id", own).withColumn("doc_id", F.xxhash64(own, "text")), own


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of like documents, that with the least doc_id; one without a doc_id only if no other has one."""
    named, own = _named(in_small_batches(docs))
    with Tables(spark, "near-copies") as table:
        classes = jaccard_join(named.select("doc_id", "text")).select("doc_id", "class_id").distinct()
        ids = table(named.groupBy("doc_id").agg(F.min(F.struct(F.col(own).isNull(), own, "doc_id")).alias("order"), F.count("*").alias("n")), "ids")
        first = staged(classes.join(ids, "doc_id").groupBy("class_id").agg(F.min("order")["doc_id"].alias("doc_id")).select("doc_id"), "first")
        again = staged(ids.where("n > 1").select("doc_id").join(first, "doc_id", "left_semi"), "again")
    kept = semi_join(named, first, "doc_id")
    if again.head(1):  # rows alike in id and text; their texts alone are shuffled
        n = again.count()
        few = n <= 1_000_000
        second = F.xxhash64(F.lit(1), "text")
        alike = semi_join(kept, again, "doc_id", count=n).withColumn(own + "_text", second).dropDuplicates(["doc_id", own, own + "_text"]).drop(own + "_text")
        kept = kept.join(F.broadcast(again) if few else again, "doc_id", "left_anti").unionByName(alike)
    return kept.drop("doc_id").withColumnRenamed(own, "doc_id").select(*docs.columns)


def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; those without a doc_id are looked at as well."""
    named, own = _named(docs)
    kept = clean(named, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return kept.drop("doc_id").withColumnRenamed(own, "doc_id").select(*docs.columns)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts put as the kind in brackets; n_chars follows the text."""
    docs = in_small_batches(docs)
    out = personal_data.redact(docs, personal_data.fit(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    import public_tokenizers

    return encode(in_small_batches(docs), public_tokenizers.path("piece_bpe_32k.model"), dictionary=24 << 20)


STAGES = [("quality rules", rules), ("near copies", near_copies), ("benchmark items", benchmark_items), ("personal data", personal), ("tokens", tokens)]

#: Rules are learned and token ids need the model's pieces, so SQL cannot give run()'s rows; a brute-force version tests them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; of the tables between, the last one alone stays in the shared folder."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            folder = shared_folder(spark, "pipeline-" + name.replace(" ", "-"))
            docs = staged(docs, name, folder)
            if before:
                remove(spark, before)
            before = folder
    return docs
