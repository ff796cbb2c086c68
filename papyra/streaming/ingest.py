"""Structured Streaming form of the stateless head of the corpus pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.functions import text as T


def clean_stream(docs: DataFrame, ts: str = "ingested_at", late: str = "7 days", min_chars: int = 500) -> DataFrame:
    """Length filter, clean-up and exact deduplication within the watermark. A stream keeps the first document to arrive, not the first by path."""
    body = F.coalesce("body", F.lit(""))
    d = docs.withColumns({"raw_len": F.length(body), "raw_md5": F.md5(body)}).where(F.col("raw_len") >= min_chars)
    return d.withWatermark(ts, late).dropDuplicatesWithinWatermark(["raw_md5"]).withColumn("body", T.remove_boilerplate(F.col("body")))


def usage_windows(log: DataFrame, ts: str = "ts", size: str = "1 hour", late: str = "7 days") -> DataFrame:
    """Calls and tokens by provider in tumbling windows; late rows count until the watermark passes."""
    w = log.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), F.lower(F.trim("provider")).alias("provider"))
    return w.agg(F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens")).select(F.col("w.start").alias("start"), "provider", "calls", "input_tokens")
