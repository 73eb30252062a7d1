"""Designs and registries: pairs of steps, splits of prompts, shards and what is still missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftlog.functions.arrays import ranges
from driftlog.functions.hashing import record_id
from driftlog.operators.selection import numbered
from driftlog.sources.scratch import Scratch


def pair_registry(spark: SparkSession, seeds: list[int], splits: tuple[str, ...] = ("development", "test"), anchors: tuple[int, ...] = (0, 100, 200, 300), step: int = 20, last: int = 400, window: int = 100, protocol: str = "v1") -> DataFrame:
    """Identity pairs at the anchors, fixed pairs from step 0, rolling pairs within a window after each later anchor."""
    rows = [(b, e, "identity" if b == e else "fixed" if b == 0 else "rolling") for b in anchors for e in range(0, last + 1, step) if b == e or (b == 0 and e > 0) or 0 < b < e <= b + window]
    steps = spark.createDataFrame(rows, "behavior_step bigint, target_step bigint, purpose string")
    grid = spark.createDataFrame([(s, x) for s in seeds for x in splits], "training_seed bigint, split string").crossJoin(steps)  # the design, a few hundred rows
    out = grid.withColumn("protocol_version", F.lit(protocol))
    return out.withColumn("pair_id", record_id(**{c: F.col(c) for c in out.columns}))


def keep_pairs(pairs: DataFrame, split: str, seeds: list[int], identity: list[int], fixed: list[int], rolling: list[tuple[int, int]]) -> DataFrame:
    """Pairs of a reduced design: identity steps, targets of the first log, and (behaviour, target) steps of later logs."""
    b, e, purpose = F.col("behavior_step"), F.col("target_step"), F.col("purpose")
    some = ((purpose == "identity") & (b == e) & e.isin(identity)) | ((purpose == "fixed") & (b == 0) & e.isin(fixed))
    for x, y in rolling:
        some = some | ((purpose == "rolling") & (b == x) & (e == y))
    return pairs.where((F.col("split") == split) & F.col("training_seed").isin(seeds) & F.coalesce(some, F.lit(False)))


def with_comparators(selected: DataFrame, pairs: DataFrame) -> DataFrame:
    """The selection with the fixed pair from step 0 that each of its rolling pairs is compared with, where it lacks one.

    A rolling pair without a comparator in the registry is an error, raised where the result is read.
    """
    key = ["split", "training_seed", "target_step"]
    needed = selected.where("purpose = 'rolling'").select(*key).distinct()
    needed = needed.join(selected.where("purpose = 'fixed' and behavior_step = 0").select(*key), key, "left_anti")
    fixed = pairs.where("purpose = 'fixed' and behavior_step = 0").withColumn("_there", F.lit(True))
    more = needed.join(fixed, key, "left")
    lost = F.raise_error(F.concat(F.lit("no comparator for "), F.to_json(F.struct(*key)))).cast("string")
    return selected.unionByName(more.withColumn("purpose", F.when(F.col("_there"), F.col("purpose")).otherwise(lost)).select(*selected.columns))


def selection(pairs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs whose pair_id is selected, and selected ids that no pair has."""
    ids = ids.select("pair_id").distinct()
    return pairs.join(ids, "pair_id", "left_semi"), ids.join(pairs, "pair_id", "left_anti")


def engineering_registry(spark: SparkSession, seeds: list[int], split: str = "development", last: int = 400, protocol: str = "v1") -> DataFrame:
    """The small design of trial runs: anchors 0 and the last step, identity pairs and the one fixed pair."""
    return pair_registry(spark, seeds, (split,), (0, last), last, last, 0, protocol)


def first_prompts(prompts: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first n prompts in an order, for limited runs."""
    return prompts.orderBy(*order).limit(n)


def union_registry(train: DataFrame, test: DataFrame) -> DataFrame:
    """Both upstream splits as one registry, each row with its ``original_split``."""
    return train.withColumn("original_split", F.lit("train")).unionByName(test.withColumn("original_split", F.lit("test")))


def split_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows by the value of each column: ``(column, value, n)`` in one pass."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")
    return rows.select(each).groupBy("x.column", "x.value").agg(F.count(F.lit(1)).alias("n"))


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by an order, such as the last entry of a path."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def batched(rows: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """Each row's batch of ``size`` rows within its key, in an order; no key's rows meet in one task."""
    with Scratch(rows.sparkSession, "batched") as scratch:
        made = numbered(rows, keys, order, scratch).withColumn("batch", F.floor(F.col("_rank") / size).cast("bigint"))
        return scratch.result(made.drop("_rank", "_n"))


def shards_within(shards: DataFrame, most: int) -> DataFrame:
    """Shards whose range of samples begins before ``most``: all that hold one of the first samples."""
    return shards.where(F.col("start") < most)


def purpose_rank() -> Column:
    return F.when(F.col("purpose") == "identity", 0).when(F.col("purpose") == "fixed", 1).otherwise(2)


def split_registry(prompts: DataFrame, n_train: int, salt: str) -> DataFrame:
    """The ``n_train`` rows of original split "train" with the least assignment hash are for training, its others for development.

    The cut is found from the hashes alone by a top-k, so no window holds all prompts.
    """
    rows = prompts.withColumn("split_assignment_hash", F.sha2(F.concat_ws("|", F.lit(salt), F.col("prompt_id").cast("string")), 256))
    order = F.struct("split_assignment_hash", "prompt_id")
    cut = rows.where("original_split = 'train'").select(order.alias("k")).orderBy("k").limit(n_train).agg(F.max("k").alias("cut"))
    chosen = F.when(F.col("original_split") != "train", F.col("original_split")).when(order <= F.col("cut"), F.lit("training")).otherwise(F.lit("development"))
    return rows.crossJoin(F.broadcast(cut)).withColumn("research_split", chosen).drop("cut")  # one row


def duplicate_extras(rows: DataFrame, column: str) -> DataFrame:
    """Rows beyond the first of each value, in all."""
    return rows.groupBy(column).agg((F.count(F.lit(1)) - 1).alias("extra")).agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("n_extra"))


def sample_shards(prompts: DataFrame, keys: list[str], samples: int, block: int, shard: int) -> DataFrame:
    """Units of work: blocks of samples times shards of consecutive prompts of each key."""
    shards = batched(prompts.select(*keys, "prompt_id"), keys, ["prompt_id"], shard).withColumnRenamed("batch", "shard").groupBy(*keys, "shard").agg(F.count(F.lit(1)).alias("n_prompts"), F.min("prompt_id").alias("first_prompt"))
    return shards.select("*", F.inline(ranges(F.lit(samples).cast("bigint"), block)))


def missing_units(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Units that are not done yet."""
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")


def next_pair(pairs: DataFrame, sources: DataFrame, outputs: DataFrame) -> DataFrame:
    """First pair, identity ones first, with fewer output units than source units."""
    counts = lambda df, n: df.groupBy("pair_id").agg(F.count(F.lit(1)).alias(n))
    rows = pairs.join(counts(sources, "n_source"), "pair_id").join(counts(outputs, "n_output"), "pair_id", "left")
    more = F.raise_error(F.concat(F.lit("more outputs than sources for "), F.col("pair_id").cast("string"))).cast("bigint")
    rows = rows.withColumn("n_output", F.when(F.col("n_output") > F.col("n_source"), more).otherwise(F.coalesce("n_output", F.lit(0))))
    left = rows.where("n_output < n_source")
    return left.orderBy(purpose_rank(), "training_seed", "split", "behavior_step", "target_step").limit(1)


def latest_metrics(records: DataFrame, core: list[str]) -> DataFrame:
    """Last record of each seed and step; rows without any core metric go; tokens per second from the steps' differences where not logged."""
    newest = F.row_number().over(Window.partitionBy("training_seed", "step").orderBy(F.desc("record_index")))
    rows = records.withColumn("_n", newest).where("_n = 1").drop("_n")
    some = None
    for c in core:
        some = F.col(c).isNotNull() if some is None else some | F.col(c).isNotNull()
    w = Window.partitionBy("training_seed").orderBy("step")
    tokens, seconds = F.col("num_tokens") - F.lag("num_tokens").over(w), F.col("elapsed_seconds") - F.lag("elapsed_seconds").over(w)
    speed = F.coalesce("tokens_per_second", F.try_divide(F.greatest(tokens, F.lit(0)).cast("double"), F.when(seconds > 0, seconds.cast("double"))))
    return rows.where(some).withColumn("tokens_per_second", speed)
