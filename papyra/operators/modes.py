"""Branches of the corpus pipeline: mode A (groups and summaries), mode B (knowledge graph), both, and their texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions import text as T
from papyra.operators import assembly, cluster, corpus, knowledge, rank
from papyra.operators.common import stored

# Representatives of a group, characters of its label.
REPRESENTATIVES, LABEL = 3, 80


def cluster_sizes(d: DataFrame) -> DataFrame:
    """A9."""
    return d.groupBy("cluster").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.length("body")).alias("chars"))


def _ranked(d: DataFrame, n: int) -> DataFrame:
    """The n most relevant documents of each group, ranked in two steps so that no task ranks a whole group."""
    by = [F.desc("score"), F.col("file_id")]
    some = d.withColumn("_s", F.pmod(F.xxhash64("file_id"), F.lit(64))).withColumn("_r", F.row_number().over(Window.partitionBy("cluster", "_s").orderBy(*by))).where(F.col("_r") <= n)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(*by))).where(F.col("rank") <= n).drop("_s", "_r")


def group_parts(d: DataFrame, sentences: int = 5) -> DataFrame:
    """(cluster, documents, label, summary, key_paras array<(source, para)>) of documents with score, cluster,
    title and source. The label is the beginning of all titles in order of relevance, of which the first eighty suffice."""
    titled = _ranked(d.where(F.coalesce("title", F.lit("")) != "").select("file_id", "cluster", "score", "title"), LABEL)
    label = titled.groupBy("cluster").agg(F.substring(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "title"))), lambda x: x["title"]), " "), 1, LABEL).alias("label"))
    reps = stored(_ranked(d.select("file_id", "cluster", "score", "body", "source"), REPRESENTATIVES), "representatives")
    text = reps.groupBy("cluster").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "body"))), lambda x: x["body"]), "\n\n").alias("t"))
    short = rank.summaries(text, "cluster", "t", sentences)
    paras = assembly.longest_paragraph(corpus.paragraphs(reps), "file_id").join(reps.select("file_id", "cluster", "rank", "source"), "file_id")
    keys = paras.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "source", "para"))), lambda x: F.struct(x["source"].alias("source"), x["para"].alias("para"))).alias("key_paras"))
    out = cluster_sizes(d).join(short, "cluster").join(label, "cluster", "left").join(keys, "cluster", "left")
    return out.select("cluster", "documents", F.coalesce("label", F.concat(F.lit("主题 "), (F.col("cluster") + 1).cast("string"))).alias("label"), "summary", F.coalesce("key_paras", F.array().cast("array<struct<source:string,para:string>>")).alias("key_paras"))


def group_report(parts: DataFrame) -> str:
    """The text of mode A from ``group_parts``, a few rows."""
    lines = []
    for r in parts.orderBy("cluster").collect():
        lines += [f"## {r.label} ({r.documents} 篇)", "", "### 摘要", r.summary, "", "### 关键段落", *[x for k in r.key_paras for x in (f"> [来源: {k.source}] {k.para}", "")], "---", ""]
    return "\n".join(lines).strip()


def fallback_rows(d: DataFrame, sentences: int = 5) -> DataFrame:
    """M4: (ord, text), a block per document where no groups can be formed; as many rows as documents, for ``sinks.write_corpus``."""
    short = rank.summaries(d, "file_id", "body", sentences)
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("filename"))
    text = F.concat(F.lit("## "), title, F.lit("\n> [来源: "), F.col("source"), F.lit("]\n"), F.col("summary"), F.lit("\n\n---"))
    return d.join(short, "file_id").select(F.col("file_id").alias("ord"), text.alias("text"))


def prepared(docs: DataFrame, index: DataFrame) -> DataFrame:
    """The common head of both modes: cleaned, deduplicated and scored documents with title, file name and source label."""
    names = docs.select("file_id", "title", "filename", T.source_label(F.col("source"), F.col("published"), F.col("filename")).alias("source"), "published")
    d = corpus.reduced(docs, index)
    return stored(d.join(rank.relevance(d), "file_id").join(names, "file_id"), "prepared")


def mode_text(docs: DataFrame, index: DataFrame, mode: str = "A", recogniser: knowledge.Recogniser | None = None) -> str:
    """The text of mode A, B or AB. Mode B needs a recogniser. Three documents or fewer give fallback blocks."""
    d = prepared(docs, index)
    texts = []
    if "A" in mode:
        grouped = d.join(cluster.clusters(d, "file_id", "body"), "file_id")
        few = d.limit(4).count() <= 3
        texts.append("\n".join(r.text for r in fallback_rows(d).orderBy("ord").collect()) if few else group_report(group_parts(grouped)))
    if "B" in mode:
        found = stored(knowledge.recognised(d, recogniser or knowledge.by_dictionary({})), "mentions")
        ents = stored(knowledge.merged(knowledge.graph.entity_counts(found.where("name IS NOT NULL").select("doc", "pos", "name", "label")), found), "entities")
        texts.append(knowledge.graph_report(d, ents, found))
    spark = d.sparkSession
    joined = spark.createDataFrame([(texts,)], "t array<string>").select(T.strip_meta_header(F.array_join("t", assembly.MODE_RULE)))
    return joined.first()[0]
