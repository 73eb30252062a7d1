"""Trajectory, rescore and on-policy frames derived from the driver's tables: a prompt is a user, a trajectory an event."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Fixture:
    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def seeds(self) -> DataFrame:
        return self.table("region").where("r_regionkey < 3").selectExpr("cast(20260826 + r_regionkey as bigint) as training_seed", "cast(r_regionkey as bigint) as s")

    @cached_property
    def steps(self) -> DataFrame:
        return self.table("nation").where("n_nationkey <= 20").selectExpr("cast(n_nationkey as bigint) * 20 as step")

    @cached_property
    def pairs(self) -> DataFrame:
        b, e = self.steps.withColumnRenamed("step", "behavior_step"), self.steps.withColumnRenamed("step", "target_step")
        kind = "case when behavior_step = target_step then 'identity' when behavior_step = 0 then 'fixed' else 'rolling' end"
        known = "behavior_step in (0, 100, 200, 300) and (behavior_step = target_step or (behavior_step = 0 and target_step > 0) or (behavior_step > 0 and target_step > behavior_step and target_step <= behavior_step + 100))"
        return self.seeds.crossJoin(b).crossJoin(e).where(known).withColumn("purpose", F.expr(kind))  # a design grid of at most a few hundred rows

    @cached_property
    def trajectories(self) -> DataFrame:
        order = Window.partitionBy("user_id").orderBy("event_id")
        # prompts stay where they are while pairs make many rows of each: partitions that are not put together for being small before
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return self.table("events").repartition(max(parts, min(4 * parts, 128)), "user_id").select(
            F.col("user_id").alias("prompt_id"),
            F.expr("case when user_id % 3 = 0 then 'test' else 'development' end").alias("split"),
            (F.row_number().over(order) - 1).cast("bigint").alias("sample_index"),
            "event_id",
            F.expr("cast(case when event_type in ('purchase', 'signup') then 1 else 0 end as double)").alias("correctness_reward"),
            F.expr("event_id % 97 + 1").alias("completion_length"),
            F.expr("event_id % 97 + 1 >= 90").alias("was_truncated"),
            F.expr("0e0 - value").alias("behavior_logprob"),
        )

    def _rescored(self, most: int) -> DataFrame:
        weight = "3e0 * (cast(target_step - behavior_step as double) / 100e0) * (cast((event_id * 7919 + s * 104729 + behavior_step * 31 + target_step * 13 + 17) % 1009 as double) / 1009e0 - 5e-1)"
        rows = self.trajectories.where(F.col("sample_index") < most).crossJoin(F.broadcast(self.pairs))  # pairs: the design grid
        return rows.select("training_seed", "split", "behavior_step", "target_step", "purpose", "prompt_id", "sample_index", F.col("event_id").alias("trajectory_id"), "correctness_reward", "completion_length", "was_truncated", F.expr(weight).alias("log_weight"))

    @cached_property
    def rescores(self) -> DataFrame:
        return self._rescored(16)

    @cached_property
    def online(self) -> DataFrame:
        rows = self.trajectories.where("sample_index >= 16 and sample_index < 24").crossJoin(F.broadcast(self.seeds.crossJoin(self.steps.withColumnRenamed("step", "target_step"))))
        correct = "cast(case when (event_id * 31 + target_step * 37 + s * 11) % 101 < 40 then 1 else 0 end as double)"
        return rows.select("training_seed", "split", "target_step", "prompt_id", F.expr("sample_index - 16").alias("sample_index"), F.expr(correct).alias("correct"))
