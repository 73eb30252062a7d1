"""Integrity checks. Each returns the rows that break a rule, with the rule's name; ``assert_none`` raises on any."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlog.functions.numeric import is_close


def expect(df: DataFrame, name: str, bad: Column, keys: list[str]) -> DataFrame:
    """Rows for which ``bad`` holds; NULL counts as no break."""
    return df.where(F.coalesce(bad, F.lit(False))).select(F.lit(name).alias("rule"), F.to_json(F.struct(*keys)).alias("row"))


def broken(df: DataFrame, rules: dict[str, Column], keys: list[str]) -> DataFrame:
    """A row for each rule that a row breaks, in one pass; NULL counts as no break."""
    names = F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items())), lambda x: x.isNotNull())
    return df.select(F.explode(names).alias("rule"), F.to_json(F.struct(*keys)).alias("row"))


def all_of(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def assert_none(breaks: DataFrame) -> None:
    found = breaks.limit(5).collect()  # enough to name
    if found:
        raise ValueError("; ".join(f"{r.rule}: {r.row}" for r in found))


def rescore_rows(rows: DataFrame, behavior: str | None = None, target: str | None = None) -> DataFrame:
    """Weights finite and equal to target less behaviour log-probability, rewards binary, lengths positive."""
    keys, z = ["trajectory_id", "training_seed", "behavior_step", "target_step"], F.col("log_weight")
    parts = [
        expect(rows, "finite_weight", z.isNull() | F.isnan(z) | (F.abs(z) == float("inf")), keys),
        expect(rows, "binary_reward", ~F.col("correctness_reward").isin(0.0, 1.0), keys),
        expect(rows, "positive_length", F.col("completion_length") <= 0, keys),
    ]
    if behavior and target:
        parts.append(expect(rows, "weight_is_difference", ~is_close(z, F.col(target) - F.col(behavior), atol=1e-9), keys))
    if "mean_log_ratio_per_token" in rows.columns:
        parts.append(expect(rows, "ratio_per_token", ~is_close(F.col("mean_log_ratio_per_token"), z / F.col("completion_length"), atol=1e-10), keys))
    return all_of(parts)


def completeness(rows: DataFrame, keys: list[str], k: int, index: str = "sample_index", first: int = 0) -> DataFrame:
    """Groups whose indices are not exactly the k from ``first`` on."""
    i = F.col(index) - F.lit(first)
    got = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(i).alias("least"), F.max(i).alias("most"), F.count_distinct(i).alias("distinct"))
    return got.where(~((F.col("n") == k) & (F.col("least") == 0) & (F.col("most") == k - 1) & (F.col("distinct") == k)))


def identity_rows(rows: DataFrame, atol: float = 1e-9) -> DataFrame:
    """Identity pairs have equal steps and zero weight; other pairs have different steps."""
    keys = ["trajectory_id", "training_seed", "behavior_step", "target_step"]
    same = F.col("behavior_step") == F.col("target_step")
    own = F.col("purpose") == "identity"
    return all_of([expect(rows, "identity_steps", own != same, keys), expect(rows, "identity_weight", own & (F.abs("log_weight") > atol), keys)])


def identity_differences(rows: DataFrame) -> DataFrame:
    """Identity rows have zero differences and a flag that is true; other rows have neither."""
    keys, own = ["trajectory_id", "training_seed", "behavior_step", "target_step"], F.col("purpose") == "identity"
    token, sequence = F.col("identity_max_abs_token_logprob_diff"), F.col("identity_abs_sequence_logprob_diff")
    return broken(rows, {
        "token_difference": own & ~(token == 0).eqNullSafe(F.lit(True)),
        "sequence_difference": own & ~(sequence == 0).eqNullSafe(F.lit(True)),
        "identity_pass": own & ~F.col("identity_pass").eqNullSafe(F.lit(True)),
        "only_identity": ~own & (token.isNotNull() | sequence.isNotNull() | F.col("identity_pass").isNotNull()),
    }, keys)


def numeric_identity_fail(token: Column, sequence: Column, atol: float) -> Column:
    """Whether a difference exceeds the tolerance; NULL does not."""
    return F.coalesce(token > atol, F.lit(False)) | F.coalesce(sequence > atol, F.lit(False))


def statistics_in_range(stats: DataFrame, keys: list[str]) -> DataFrame:
    ess, k = F.col("ess"), F.col("K")
    return all_of([expect(stats, "ess", (ess < 1 - 1e-9) | (ess > k + 1e-8), keys), expect(stats, "pwis", (F.col("pwis") < 0) | (F.col("pwis") > 1), keys), expect(stats, "alpha", (F.col("alpha") < 0) | (F.col("alpha") > 1), keys)])


def prompt_sets(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("missing", F.lit("right")).unionByName(b.join(a, keys, "left_anti").withColumn("missing", F.lit("left")))


def pair_prompts(stats: DataFrame, accuracy: DataFrame, pair: list[str]) -> DataFrame:
    """Pairs whose prompts are not exactly those of their target's reference: how many lack one, and how many it has besides."""
    target = ["split", "training_seed", "target_step"]
    known = accuracy.select(*target, "prompt_id", F.lit(1).alias("known")).distinct()
    n = known.groupBy(*target).agg(F.count(F.lit(1)).alias("n_reference"))
    seen = stats.select(*pair, "prompt_id").distinct().join(known, [*target, "prompt_id"], "left")
    counts = seen.groupBy(*pair).agg(F.count_if(F.col("known").isNull()).alias("without_reference"), F.count("known").alias("both"))
    out = counts.join(n, target, "left").withColumn("only_reference", F.coalesce("n_reference", F.lit(0)) - F.col("both"))
    return out.where("without_reference > 0 or only_reference > 0").select(*pair, "without_reference", "only_reference")


def online_rows(rows: DataFrame, expected_id: Column, start: int, end: int, most: int) -> DataFrame:
    """Samples of a target have reproducible ids, indices within the shard, binary rewards, and a truncation that is one."""
    length = F.size("completion_token_ids") if "completion_token_ids" in rows.columns else F.col("completion_length")
    return broken(rows, {
        "online_id": ~F.col("online_id").eqNullSafe(expected_id),
        "sample_index": ~F.col("sample_index").between(start, end - 1),
        "binary_reward": ~F.col("correct").isin(0.0, 1.0),
        "length": (F.col("completion_length") <= 0) | (F.col("completion_length") != length),
        "ended_and_truncated": F.col("terminated_with_eos") & F.col("was_truncated"),
        "truncated_length": F.col("was_truncated") & (F.col("completion_length") != most),
    }, ["training_seed", "target_step", "prompt_id", "sample_index"])


def registry_rows(rows: DataFrame, n_train: int, salt: str) -> DataFrame:
    """Ids and hashes are SHA-256 texts, no test prompt is trained on, and assignments follow from salt and prompt."""
    from driftlog.operators.registry import split_registry

    hexadecimal = lambda c: ~F.coalesce(F.col(c).rlike("^[0-9a-f]{64}$"), F.lit(False))
    again = split_registry(rows.drop("split_assignment_hash", "research_split"), n_train, salt).select("prompt_id", F.col("split_assignment_hash").alias("_hash"), F.col("research_split").alias("_split"))
    both = rows.join(again.dropDuplicates(["prompt_id"]), "prompt_id", "left")
    return broken(both, {
        "prompt_id": hexadecimal("prompt_id"),
        "assignment_hash": hexadecimal("split_assignment_hash") | ~F.col("split_assignment_hash").eqNullSafe(F.col("_hash")),
        "test_leak": (F.col("original_split") == "test") & (F.col("research_split") != "test"),
        "train_split": (F.col("original_split") == "train") & ~F.col("research_split").isin("training", "development"),
        "membership": ~F.col("research_split").eqNullSafe(F.col("_split")),
    }, ["prompt_id"])


def counts_differ(rows: DataFrame, column: str, expected: dict[str, int]) -> DataFrame:
    """Values of a column whose number of rows is not the expected one, those that should not be there included."""
    design = rows.sparkSession.createDataFrame(list(expected.items()), "value string, expected bigint")
    got = rows.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    out = got.join(design, "value", "full").select("value", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("expected", F.lit(0)).alias("expected"))
    return out.where("n <> expected")


def lock_breaks(lock: DataFrame, observed: DataFrame) -> DataFrame:
    """Names whose observed hash is not the locked one: changed, never locked, or locked and not there. Both: ``(name, sha256)``."""
    both = lock.select("name", F.col("sha256").alias("locked")).join(observed.select("name", F.col("sha256").alias("observed")), "name", "full")
    kind = F.when(F.col("locked").isNull(), "not_locked").when(F.col("observed").isNull(), "not_there").otherwise("changed")
    return both.where(~F.col("locked").eqNullSafe(F.col("observed"))).select("name", kind.alias("kind"))


def open_test(split: str, gate_sha256: str | None, locked_sha256: str | None) -> None:
    """The test split is closed until the frozen gate is there and has the locked hash."""
    if split != "test":
        return
    if gate_sha256 is None:
        raise PermissionError("the test split needs the frozen gate")
    if locked_sha256 is None or gate_sha256 != locked_sha256:
        raise PermissionError("the frozen gate is not the locked one")


def seed_coverage(cases: DataFrame, seeds: list[int]) -> None:
    """The cases' seeds are exactly those given."""
    found = {r[0] for r in cases.select("training_seed").distinct().limit(len(seeds) + 1).collect()}
    if found != set(seeds):
        raise ValueError(f"seeds {sorted(found)} instead of {sorted(seeds)}")


def rederived(stats: DataFrame, table: DataFrame, pair: list[str], atol: float = 1e-9) -> DataFrame:
    """Pairs of a table whose number of prompts or median overlap does not follow from the prompt statistics."""
    own = stats.groupBy(*pair).agg(F.count(F.lit(1)).alias("_n"), F.median("relative_ess").alias("_ress"))
    both = table.join(own, pair, "left")
    return broken(both, {
        "statistics": F.col("_n").isNull(),
        "n_prompts": F.col("n_prompts") != F.col("_n"),
        "median_relative_ess": ~is_close(F.col("median_prompt_relative_ess"), F.col("_ress"), atol=atol, rtol=0.0),
    }, pair)


def looked_up(registry: DataFrame, raw: DataFrame, index: str, own_hash: str, raw_hash: Column) -> tuple[DataFrame, DataFrame]:
    """Registry rows with the raw row at their position, and those whose position is empty or holds another text."""
    both = registry.join(raw.withColumn("_hash", raw_hash), index, "left")
    good = F.col(own_hash).eqNullSafe(F.col("_hash")) & F.col("_hash").isNotNull()
    return both.where(good).drop("_hash"), both.where(~good).select(*registry.columns)


def choose_split(table: DataFrame, wanted: str, final: bool = False) -> str:
    """The wanted split, if the table has it; a final report takes the test split alone."""
    if not table.where(F.col("split") == wanted).head(1):
        raise ValueError(f"no rows of split {wanted}")
    if final and wanted != "test":
        raise ValueError("a final report needs the test split")
    return wanted


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def conflicts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys with more than one value; NULL is a value."""
    kinds = F.count_distinct(value) + F.max(F.col(value).isNull().cast("int"))
    return df.groupBy(*keys).agg(kinds.alias("n")).where("n > 1")


def disjoint(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Values that both sides have."""
    return left.select(column).intersect(right.select(column))


def grid_gaps(df: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """Combinations of a design that have no row."""
    return grid.join(df.select(*keys).distinct(), keys, "left_anti")


def references(accuracy: DataFrame, reference: DataFrame, samples: int) -> DataFrame:
    """Every prompt has the same number of samples, its accuracy is its share, and the mean is the reference."""
    keys = ["split", "training_seed", "target_step", "prompt_id"]
    means = accuracy.groupBy(*keys[:-1]).agg(F.avg("prompt_accuracy").alias("mean")).join(reference, keys[:-1])
    return all_of([
        expect(accuracy, "samples", F.col("n_samples") != samples, keys),
        expect(accuracy, "share", ~is_close(F.col("prompt_accuracy"), F.col("success_count") / F.col("n_samples"), atol=1e-12), keys),
        expect(means, "mean", ~is_close(F.col("mean"), F.col("online_reference"), atol=1e-12), keys[:-1]),
    ])


def covered(rows: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Keys of either side without a partner."""
    return prompt_sets(rows, source, [key])
