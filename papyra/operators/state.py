"""Progress of runs and the usage log as small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def progress(events: DataFrame) -> DataFrame:
    """(base, steps, timestamps, config_hash) from (base, step, config_hash, ts, seq): each completed step once in order of
    its first completion, the time of its last one, and the hash of the last event."""
    per = events.where("step IS NOT NULL").groupBy("base", "step").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.max(F.struct("ts", "seq", "config_hash")).alias("_l"))
    g = per.groupBy("base").agg(F.sort_array(F.collect_list(F.struct("first", "step", "last"))).alias("l"), F.max("_l").alias("_l"))
    steps = F.transform("l", lambda x: x["step"])
    return g.select("base", steps.alias("steps"), F.map_from_arrays(steps, F.transform("l", lambda x: x["last"])).alias("timestamps"), F.col("_l.config_hash").alias("config_hash"))


def merged_progress(state: DataFrame, events: DataFrame) -> DataFrame:
    """New events folded into a stored state (as ``progress`` gives it)."""
    old = state.select("base", F.explode("timestamps").alias("step", "ts"), "config_hash").select("base", "step", "config_hash", "ts", F.lit(-1).cast("long").alias("seq"))
    return progress(old.unionByName(events.select("base", "step", "config_hash", "ts", F.col("seq").cast("long").alias("seq"))))


def skips(steps: Column, stored_hash: Column, step: str, current_hash: str) -> Column:
    """A step is left out if it was completed and the configuration is the stored one."""
    return F.coalesce(F.array_contains(steps, step) & (stored_hash == current_hash), F.lit(False))


class UsageLog:
    """Z3: calls recorded as rows of an append-only folder; reset begins a new one."""

    SCHEMA = "provider string, model string, input_tokens long, output_tokens long, ts timestamp"

    def __init__(self, spark, path: str) -> None:
        self.spark, self.path = spark, path

    def record(self, calls: DataFrame) -> None:
        cols = [c.split()[0] for c in self.SCHEMA.split(", ")]
        calls.select(*cols).write.mode("append").parquet(self.path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def reset(self) -> None:
        self.spark.createDataFrame([], self.SCHEMA).write.mode("overwrite").parquet(self.path)
