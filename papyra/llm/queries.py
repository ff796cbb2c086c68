"""Queries of the training-data operators over whole tables, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.operators.common import table


SQL = {"p7_decoded": "SELECT doc_id, md5(coalesce(text, '')) text_md5 FROM documents"}


def limits(spark: SparkSession, d: str, tbl: str) -> tuple[int, int]:
    """(max_size, overlap) of a table in size_limits, a fixed table of a few rows."""
    row = table(spark, d, "size_limits").where(F.col("tbl") == tbl).agg(F.max("max_size").alias("m"), F.max("overlap").alias("o")).first()
    return int(row.m), int(row.o)


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """(tbl, rec_id, arrived, question, answer) of both pair tables."""
    a = table(spark, d, "research_findings").select(F.lit("research_findings").alias("tbl"), F.col("finding_id").alias("rec_id"), F.col("created_at").alias("arrived"), "question", "answer")
    b = table(spark, d, "search_results").select(F.lit("search_results"), "result_id", "fetched_at", "query", "content")
    return a.union(b)


def p1_judged(spark: SparkSession, d: str) -> DataFrame:
    from papyra.llm.pairs import judge_pairs

    return judge_pairs(pairs(spark, d), table(spark, d, "documents"), table(spark, d, "lang_labels"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_judged(spark, d).where("defect IS NOT NULL").select("tbl", "rec_id", "defect")


#: Of each table with long texts: key, text, arrival.
OVERSIZED = {"corpus_docs": ("file_id", "body", "ingested_at"), "search_results": ("result_id", "content", "fetched_at")}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from papyra.llm.splitting import split_oversized

    parts = [split_oversized(table(spark, d, t), *cols, *limits(spark, d, t), with_text=False).select(F.lit(t).alias("tbl"), "rec_id", "forced") for t, cols in OVERSIZED.items()]
    return parts[0].unionByName(parts[1])


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    from papyra.llm.splitting import pieces_of, split_oversized

    parts = [pieces_of(split_oversized(table(spark, d, t), *cols, *limits(spark, d, t))).select(F.lit(t).alias("tbl"), "*") for t, cols in OVERSIZED.items()]
    return parts[0].unionByName(parts[1])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from papyra.llm.mainbody import page_frames

    return page_frames(table(spark, d, "crawl_results")).select("crawl_id", F.explode("lines").alias("line_no"))


def p3_bodies(spark: SparkSession, d: str) -> DataFrame:
    from papyra.llm.mainbody import main_body, page_frames

    pages = table(spark, d, "crawl_results")
    return main_body(pages, page_frames(pages))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from papyra.llm.scans import read_scans

    got = read_scans(table(spark, d, "extraction_results"), with_text=False)
    return got.select("extract_id", F.inline("cases"))


def p5_texts(spark: SparkSession, d: str) -> DataFrame:
    from papyra.llm.scans import read_scans

    return read_scans(table(spark, d, "extraction_results")).select("extract_id", "repaired")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    from papyra.llm.neardup import similar_classes, similar_pairs

    return similar_pairs(*similar_classes(table(spark, d, "corpus_docs")))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    from papyra.llm.neardup import groups, similar_classes

    return groups(*similar_classes(table(spark, d, "corpus_docs"))).withColumnRenamed("id", "file_id")


def p6_links(spark: SparkSession, d: str) -> DataFrame:
    """Pairs between the first records of exact classes; ``p6_groups`` has the membership."""
    from papyra.llm.neardup import similar_classes

    return similar_classes(table(spark, d, "corpus_docs"))[1].select(F.col("a").alias("cls_a"), F.col("b").alias("cls_b"), "similarity")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    from papyra.llm.tokens import encode_corpus

    return encode_corpus(table(spark, d, "documents"))


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The round trip: encoded, decoded, and the MD5 of what comes back."""
    from papyra.llm.tokens import decode_ids

    return decode_ids(p7_ids(spark, d)).select("doc_id", F.md5("text").alias("text_md5"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    from papyra.llm.packing import pack_documents

    return pack_documents(table(spark, d, "documents"), limits(spark, d, "documents")[0])


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    from papyra.llm.packing import container_report

    return container_report(p8_containers(spark, d), limits(spark, d, "documents")[0])


def p9_languages(spark: SparkSession, d: str) -> DataFrame:
    from papyra.llm.language import identify_languages

    return identify_languages(table(spark, d, "documents"), table(spark, d, "lang_labels"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    from papyra.llm.language import wrong_or_mixed

    return wrong_or_mixed(p9_languages(spark, d)).select("doc_id", "seg", "lang")


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_judged, p2_found, p2_pieces, p3_found, p3_bodies, p5_found, p5_texts, p6_found, p6_groups, p6_links, p7_ids, p7_decoded, p8_containers, p8_report, p9_found, p9_languages)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
