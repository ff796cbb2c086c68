"""Helpers that several operators share: table access, redelivery, shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def strip(c: Column) -> Column:
    """Trim all Unicode white space, the byte-order mark and zero-width blanks, not only U+0020."""
    return F.regexp_replace(c, r"(?U)^[\s\x{feff}\x{200b}\x1c-\x1f]+|[\s\x{feff}\x{200b}\x1c-\x1f]+$", "")


def latest(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """One row per key, that of the latest arrival; of equal arrivals the greatest row.

    Meant for narrow results: run the per-row work first and call this on what it gives, so
    that the shuffle carries keys and verdicts and no texts. Aggregates map-side, thus a key
    that holds a third of all rows arrives as one row per map task.
    """
    rest = [c for c in df.columns if c not in keys and c != ts]
    one = df.groupBy(*keys).agg(F.max(F.struct(F.col(ts).alias("_t"), *rest)).alias("_m"))
    return one.select(*keys, F.col("_m._t").alias(ts), *[F.col(f"_m.{c}").alias(c) for c in rest])


_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a local master (tests) gets one of its own; a
    cluster gets an error, as a machine's own folder would lose stages with the machine."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "papyra-shared")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a stage to the shared folder and read it back: cuts lineage and survives the loss of an executor.

    Results are lazy and read these folders, so they stay until ``release`` is called."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the stages written so far, once their results are saved; how many there were."""
    n = len(_WRITTEN)
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows over all cores where the input has fewer files than there are cores.

    A file of one row group is one task however large it is, which heavy per-row work would wait
    for. Inputs of many files, and frames without files, stay as they are: no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores, key) if 0 < len(df.inputFiles()) < cores else df
