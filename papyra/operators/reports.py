"""Report-level operators: chapters, contexts, merging, chunks, targets, issues, citations, usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions import text as T


def chapters(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, chap_ord, title, body); texts without chapter headings give no row."""
    d = df.select(key, F.regexp_extract_all(F.col(text), F.lit(T.CHAPTER), F.lit(0)).alias("titles"), F.split(F.col(text), T.CHAPTER).alias("bodies")).where(F.size("titles") > 0)
    z = d.select(key, F.posexplode(F.arrays_zip("titles", F.slice("bodies", 2, 100_000_000).alias("b"))).alias("chap_ord", "z"))
    return z.select(key, "chap_ord", T.strip(F.col("z.titles")).alias("title"), T.strip(F.col("z.b")).alias("body"))


def contexts(ch: DataFrame, key: str, n: int = 500) -> DataFrame:
    """For each chapter the end of the one before, the start of the next, and their titles."""
    w = Window.partitionBy(key).orderBy("chap_ord")
    before, after = F.coalesce(F.lag("body").over(w), F.lit("")), F.coalesce(F.lead("body").over(w), F.lit(""))
    return ch.select(key, "chap_ord", T.strip(F.right(before, F.lit(n))).alias("prev_summary"), T.strip(F.substring(after, 1, n)).alias("next_summary"), F.coalesce(F.lag("title").over(w), F.lit("")).alias("prev_title"), F.coalesce(F.lead("title").over(w), F.lit("")).alias("next_title"))


def merge_adjacent(df: DataFrame, key: str, order: str, label: str, body: str, sep: str = "\n\n") -> DataFrame:
    """Neighbouring rows of one label joined (gaps and islands): (key, island, label, parts, body)."""
    w = Window.partitionBy(key).orderBy(order)
    d = df.withColumn("_new", (F.coalesce(F.col(label), F.lit("")) != F.coalesce(F.lag(label).over(w), F.lit("\0"))).cast("int")).withColumn("island", F.sum("_new").over(w))
    g = d.groupBy(key, "island").agg(F.max(label).alias(label), F.count(F.lit(1)).alias("parts"), F.sort_array(F.collect_list(F.struct(order, body))).alias("l"))
    return g.select(key, "island", label, "parts", F.array_join(F.transform("l", lambda x: x[body]), sep).alias("body"))


def chunks(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """F16: (key, chunk_ord, chunk) of ``size`` characters; empty and null texts give none."""
    d = df.where(F.length(text) > 0).select(key, F.col(text).alias("_t"))
    return d.select(key, F.posexplode(F.transform(F.sequence(F.lit(1), F.length("_t"), F.lit(size)), lambda i: F.substr("_t", i, F.lit(size)))).alias("chunk_ord", "chunk"))


def section_windows(df: DataFrame, key: str, text: str, sections: str, size: int) -> DataFrame:
    """F16: (key, window, start, part): up to four sections and a text within ``size`` are one window; above four sections
    each has its own, half a window further on; else windows follow each other. Blank windows are left out, or begin at 0 if a section's."""
    n, t = F.length("_t"), F.col("_t")
    many = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda j: F.least(j * (size - size // 2), F.greatest(F.lit(0), n - size)))
    row = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size))
    starts = F.when((n <= size) & (F.col("_n") <= 4), F.array(F.lit(0))).when(F.col("_n") > 4, many).otherwise(row)
    d = df.where(F.length(text) > 0).select(key, F.col(text).alias("_t"), F.col(sections).cast("int").alias("_n"))
    return d.select(key, "_t", F.posexplode(starts).alias("window", "start")).select(key, "window", "start", F.substr("_t", F.col("start") + 1, F.lit(size)).alias("part"))


def slices(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(key, i, part): n parts that cut the text proportionally."""
    d = df.select(key, F.col(text).alias("_t"), F.length(text).cast("long").alias("_l"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    a, z = F.floor(F.col("i") * F.col("_l") / n).cast("int"), F.floor((F.col("i") + 1) * F.col("_l") / n).cast("int")
    return d.select(key, "i", F.substr("_t", a + 1, z - a).alias("part"))


def density_targets(ch: DataFrame, key: str, density: str, raw_len: str) -> DataFrame:
    """Adds target, the length a chapter should have."""
    w = Window.partitionBy(key)
    total = F.greatest(F.lit(16000), F.floor(F.col(raw_len) * 0.6))
    return ch.withColumn("target", F.greatest(F.lit(2000), F.floor(total * F.col(density) / F.avg(density).over(w) / F.count(F.lit(1)).over(w))).cast("long"))


def token_usage(log: DataFrame) -> DataFrame:
    """A10: calls and tokens by provider, and in total (provider null); names folded, each call once."""
    d = log.dropDuplicates(["log_id"]).select(F.coalesce(F.lower(F.trim("provider")), F.lit("")).alias("provider"), "input_tokens", "output_tokens")
    return d.rollup("provider").agg(F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"))


def score_gate(scores: DataFrame, key: str, score: str) -> DataFrame:
    """Overall score (whole number, -1 without any), and whether it passes 70 with every dimension at 60."""
    ok = F.when(F.col(score) >= 0, F.col(score))
    overall = F.coalesce(F.floor(F.avg(ok)), F.lit(-1)).cast("int")
    return scores.groupBy(key).agg(overall.alias("overall"), (F.coalesce(F.min(score) >= 60, F.lit(False)) & (overall >= 70)).alias("passed"))


def issue_topk(issues: DataFrame, key: str, severity: str, order: str, n: int = 10) -> DataFrame:
    """By severity 高, 中, 低 (others last), then in order, at most n a key."""
    rank = F.when(F.col(severity) == "高", 0).when(F.col(severity) == "中", 1).otherwise(2)
    return issues.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy(rank, order))).where(F.col("pos") <= n)


def citations(df: DataFrame, key: str, cites: str) -> DataFrame:
    """(key, pos, url, title): the first citation of each address within a row; blank addresses dropped."""
    d = df.select(key, F.posexplode(cites).alias("pos", "c")).select(key, "pos", F.col("c.url").alias("url"), F.col("c.title").alias("title")).where("trim(coalesce(url, '')) <> ''")
    first = d.groupBy(key, "url").agg(F.min(F.struct("pos", "title")).alias("f"))
    return first.select(key, F.col("f.pos").alias("pos"), "url", F.col("f.title").alias("title"))


def compression_targets(c) -> dict:
    """F28 for a length column: target, floor and token budget."""
    target = F.floor(c * 0.9)
    return {"target": target, "floor": F.floor(c * 0.8), "budget": F.least(F.lit(16384), F.greatest(F.lit(4096), F.floor(target * 1.5)))}


def transcript(turns: DataFrame, key: str, order: str, role: str, text: str) -> DataFrame:
    """S6, row form: the turns of a conversation with role labels, empty ones left out."""
    line = F.concat(F.when(F.lower(F.coalesce(role, F.lit(""))).isin("user", "human"), "用户：").otherwise("助手："), F.trim(text))
    d = turns.where(F.trim(F.coalesce(text, F.lit(""))) != "").groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, line.alias("t")))).alias("l"))
    return d.select(key, F.array_join(F.transform("l", lambda x: x["t"]), "\n\n").alias("transcript"))


def number_images(df: DataFrame, key: str, images: str) -> DataFrame:
    """A running number over all images in order of key and place. Counts per key are summed in ranges, so no task holds all images."""
    d = df.select(key, F.posexplode(images).alias("pos", "img"))
    per = d.groupBy(key).agg(F.count(F.lit(1)).alias("n")).withColumn("b", F.floor(F.col(key) / 10_000))
    base = per.groupBy("b").agg(F.sum("n").alias("bn")).withColumn("bstart", F.coalesce(F.sum("bn").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = per.join(base, "b").withColumn("start", F.col("bstart") + F.coalesce(F.sum("n").over(Window.partitionBy("b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return d.join(at.select(key, "start"), key).select(key, "pos", (F.col("start") + F.col("pos") + 1).alias("img_no"), F.col("img.url").alias("url"))
