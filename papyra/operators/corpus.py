"""The corpus pipeline: fields, status and length filters, clean-up, deduplication, relevance, groups and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions import text as T
from papyra.operators import cluster, firstkept, rank
from papyra.operators.common import stored


def once(df: DataFrame, key: str, arrived: str) -> DataFrame:
    """Each key once, whole rows: the earliest delivery. For a few narrow columns ``first_delivery`` shuffles less."""
    one = df.groupBy(key).agg(F.min_by(F.struct(*[c for c in df.columns if c != key]), arrived).alias("_r"))
    return one.select(key, "_r.*").select(*df.columns)


def first_delivery(df: DataFrame, key: str, arrived: str, **columns: Column) -> DataFrame:
    """(key, columns) of the earliest delivery of each key. Columns are computed first, so only results are shuffled and no texts."""
    d = df.select(F.col(key), F.col(arrived).alias("_at"), F.struct(*[c.alias(n) for n, c in columns.items()]).alias("_r"))
    return d.groupBy(key).agg(F.min_by("_r", "_at").alias("_r")).select(key, "_r.*")


def with_fields(docs: DataFrame) -> DataFrame:
    """Length in code points and MD5 of the raw body, taken before any cleaning (null body: empty)."""
    body = F.coalesce("body", F.lit(""))
    return docs.withColumns({"raw_len": F.length(body), "raw_md5": F.md5(body)})


def last_status(index: DataFrame) -> DataFrame:
    """S3: (filename, status), the last listed line of a name wins; names and statuses trimmed, statuses lower-cased."""
    rows = index.select(F.trim("filename").alias("filename"), F.struct("line_id", F.lower(F.trim("status")).alias("status")).alias("s"))
    return rows.groupBy("filename").agg(F.max("s").alias("s")).select("filename", F.col("s.status").alias("status"))


def filter_status(docs: DataFrame, index: DataFrame) -> DataFrame:
    """Keep documents whose status is ok, empty or missing."""
    return docs.join(last_status(index), "filename", "left").where(F.coalesce("status", F.lit("ok")).isin("ok", ""))


def dedup_exact(docs: DataFrame) -> DataFrame:
    """A1: of each raw MD5 the first document by (filepath, file_id). Aggregates map-side; a hot MD5 costs one row per task."""
    firsts = docs.groupBy("raw_md5").agg(F.min(F.struct("filepath", "file_id")).alias("f")).select(F.col("f.file_id").alias("file_id"))
    return docs.join(firsts, "file_id", "left_semi")


def paragraphs(docs: DataFrame) -> DataFrame:
    """(file_id, para_ord, para)."""
    return docs.select("file_id", F.posexplode(F.split("body", r"\n\s*\n")).alias("para_ord", "para"))


def dedup_paragraphs(docs: DataFrame, least: int = 100) -> DataFrame:
    """A4: (file_id, body). A paragraph of ``least`` characters that stands in two documents or more is kept where it first
    stands in order of (file_id, para_ord) only; without any such paragraph all bodies stay as they are."""
    p = paragraphs(docs).withColumn("fp", F.when(F.length(F.trim("para")) >= least, F.md5(F.trim("para"))))
    dup = p.where("fp IS NOT NULL").groupBy("fp").agg(F.min("file_id").alias("lo"), F.max("file_id").alias("hi"), F.min(F.struct("file_id", "para_ord")).alias("first")).where("lo < hi").select("fp", "first")
    asked = p.where("fp IS NOT NULL").join(dup, "fp", "left").where(F.col("first").isNull() | (F.struct("file_id", "para_ord") == F.col("first")))
    kept = asked.select("file_id", "para_ord", "para").unionByName(p.where("fp IS NULL").select("file_id", "para_ord", "para"))  # short ones have no part in the join
    bodies = kept.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("para_ord", "para"))).alias("ps"))
    return docs.select("file_id").join(bodies, "file_id", "left").select("file_id", F.coalesce(F.array_join(F.transform("ps", lambda x: x["para"]), "\n\n"), F.lit("")).alias("body"))


def reduced(docs: DataFrame, index: DataFrame, min_chars: int = 500) -> DataFrame:
    """E1 without its branches: (file_id, raw_len, body): status, length of the raw body, exact deduplication on the raw body,
    clean-up, near and paragraph deduplication."""
    d = filter_status(with_fields(docs), index).where(F.col("raw_len") >= min_chars)
    d = stored(dedup_exact(d).select("file_id", "raw_len", T.remove_boilerplate(F.col("body")).alias("body")), "cleaned")
    d = d.join(firstkept.kept_first(d).where("kept").select("file_id"), "file_id", "left_semi")
    return stored(d.select("file_id", "raw_len").join(dedup_paragraphs(d), "file_id"), "deduped")


def preprocess(docs: DataFrame, index: DataFrame, min_chars: int = 500) -> DataFrame:
    """E1 with branch A: (file_id, raw_len, body, score, cluster, summary).

    ``reduced`` documents with relevance, group and summary; statistics lines go from the summaries (P7). The texts of modes A,
    B and both are those of ``modes.mode_text``."""
    d = reduced(docs, index, min_chars)
    short = rank.summaries(d, "file_id", "body").select("file_id", T.strip_meta_header(F.col("summary")).alias("summary"))
    return d.join(rank.relevance(d), "file_id").join(cluster.clusters(d, "file_id", "body"), "file_id").join(short, "file_id")


def stats(df: DataFrame, before: str, after: str) -> DataFrame:
    """A5."""
    a, b = F.sum(F.length(before)), F.sum(F.length(after))
    return df.agg(F.count(F.lit(1)).alias("documents"), a.alias("chars_in"), b.alias("chars_out"), F.round((1 - b / a) * 100, 4).alias("compression_pct"))


def corpus_parts(df: DataFrame, group: str, name: str, body: str) -> DataFrame:
    """K8: (group, ord, text): the texts of a group behind separators, numbered by name and text. Groups may be of any size: parts
    stay rows, and ``sinks.write_corpus`` writes them in order. Places are counted in ranges of names, not by one task a group."""
    part = F.concat(F.lit("--- 来自文件: "), F.coalesce(name, F.lit("")), F.lit(" ---\n\n"), F.coalesce(body, F.lit("")))
    d = df.select(F.col(group).alias("group"), F.coalesce(name, F.lit("")).alias("n"), part.alias("text")).withColumn("h", F.md5("text"))
    w = Window.partitionBy("group", "b")
    d = d.withColumn("b", F.substring("n", 1, 8))  # names that begin alike are numbered by one task
    sizes = d.groupBy("group", "b").agg(F.count(F.lit(1)).alias("k"))
    start = sizes.withColumn("start", F.coalesce(F.sum("k").over(Window.partitionBy("group").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = d.withColumn("r", F.row_number().over(w.orderBy("n", "h")))
    same = (F.col("x.group").eqNullSafe(F.col("s.group"))) & (F.col("x.b") == F.col("s.b"))
    return at.alias("x").join(start.alias("s"), same).select(F.col("x.group").alias(group), (F.col("s.start") + F.col("x.r") - 1).alias("ord"), "x.text")


def group_top(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= n)
