"""Readers of document folders, status lists, chat exports and pages."""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.functions import text as T

HEADER_KEYS = ("url", "title", "source", "category", "published", "description")
_TURN = "array<struct<role:string,type:string,author:string,content:string,text:string,message:string,parts:string>>"


def corpus_dir(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """One row per .txt file whose name does not start with _ or a dot, header fields and body split."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=recursive, pathGlobFilter="*.txt")
    d = raw.select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("filepath"), F.col("_metadata.file_name").alias("filename"))
    return parse_documents(d.where(~F.col("filename").rlike(r"^[_.]")), "raw")


def parse_documents(df: DataFrame, raw: str) -> DataFrame:
    """Header lines ``key: value`` before a line of four or more =; the last of a repeated key counts; without the line all is body."""
    parts = F.split(raw, r"(?m)^={4,}\s*$", 2)
    d = df.withColumn("_p", parts).withColumn("_h", F.when(F.size("_p") == 2, F.col("_p")[0]).otherwise(F.lit("")))
    for k in HEADER_KEYS:
        hits = F.regexp_extract_all("_h", F.lit(rf"(?im)^[ \t]*{k}[ \t]*:(.*)$"), F.lit(1))
        d = d.withColumn(k, F.when(F.size(hits) > 0, F.trim(F.element_at(hits, -1))).otherwise(F.lit("")))
    body = T.strip(F.element_at("_p", -1))
    return d.withColumns({"body": body}).withColumns({"char_count": F.length("body"), "md5": F.md5("body")}).drop("_p", "_h", raw)


def status_csv(spark: SparkSession, path: str) -> DataFrame:
    """S3: (line_id, filename, status) of a status list with any of its accepted column names."""
    d = spark.read.option("header", True).csv(path)
    have = {c.lower(): c for c in d.columns}
    name = F.coalesce(*[F.nullif(F.trim(d[have[c]]), F.lit("")) for c in ("filename", "file", "name") if c in have])
    status = F.coalesce(*[F.nullif(F.trim(d[have[c]]), F.lit("")) for c in ("status",) if c in have], F.lit(""))
    return d.select(F.monotonically_increasing_id().alias("line_id"), name.alias("filename"), F.lower(status).alias("status")).where("filename IS NOT NULL")


def chat_json(df: DataFrame, raw: str) -> DataFrame:
    """Adds ``transcript`` for the shapes {conversations: []}, {messages|chat|turns|items: []} and a bare list; other texts are normalised."""
    lists = [F.from_json(F.get_json_object(raw, f"$.{k}"), _TURN) for k in ("conversations", "messages", "chat", "turns", "items")] + [F.from_json(raw, _TURN)]
    turns = F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists])
    who = lambda t: F.lower(F.coalesce(t["role"], t["author"], t["type"], F.lit("")))
    joined = lambda c: F.when(c.startswith("["), F.array_join(F.transform(F.from_json(c, "array<string>"), lambda p: F.coalesce(F.get_json_object(p, "$.text"), p)), " "))
    said = lambda t: F.trim(F.coalesce(joined(t["content"]), t["content"], t["text"], t["message"], joined(t["parts"]), F.lit("")))
    lines = F.transform(F.filter(turns, lambda t: said(t) != ""), lambda t: F.concat(F.when(who(t).isin("user", "human"), "用户：").otherwise("助手："), said(t)))
    return df.withColumn("transcript", F.when(F.size(lines) > 0, F.array_join(lines, "\n\n")).otherwise(T.lines_normalised(F.col(raw))))


def imported(df: DataFrame, filename: str, raw: str) -> DataFrame:
    """Dispatch by suffix."""
    suffix = F.lower(F.regexp_extract(filename, r"\.([^./]+)$", 1))
    d = chat_json(df, raw)
    return d.withColumn("text", F.when(suffix == "json", F.col("transcript")).when(suffix.isin("html", "htm"), T.html_text(F.col(raw))).otherwise(T.lines_normalised(F.col(raw)))).drop("transcript")


def front_matter(text: str) -> tuple[dict[str, str], dict[str, str]]:
    """Settings of a --- block (quotes off, # comments skipped) and the ## sections of a profile. Driver-side configuration."""
    import re

    meta: dict[str, str] = {}
    m = re.match(r"^---\s*\n(.*?)\n---\s*\n?", text, re.S)
    for line in (m.group(1) if m else "").splitlines():
        if ":" in line and not line.lstrip().startswith("#"):
            k, v = line.split(":", 1)
            meta[k.strip()] = v.strip().strip("\"'")
    parts = re.split(r"(?m)^##\s+(.+)$", text[m.end() :] if m else text)
    return meta, {k.strip(): v.strip() for k, v in zip(parts[1::2], parts[2::2])}


# Suffixes of texts, documents and images of a corpus folder.
TEXTS, DOCUMENTS, IMAGES = ("txt", "md", "json", "html", "htm"), ("docx", "pdf"), ("jpg", "jpeg", "png", "gif", "webp", "bmp")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def docx_parts(data: bytes | None, headings: bool = False) -> tuple[str, list[tuple[str, bytes]]]:
    """(text, images) of a .docx: paragraphs in order with formulas in $ and image marks, then table rows; with
    ``headings`` the heading styles one to three become # marks. Broken files give an empty text."""
    import xml.etree.ElementTree as ET

    from papyra.functions.mathtext import omml_to_latex

    try:
        z = zipfile.ZipFile(io.BytesIO(data or b""))
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("word/_rels/document.xml.rels"))} if "word/_rels/document.xml.rels" in z.namelist() else {}
    except (zipfile.BadZipFile, KeyError, ET.ParseError):
        return "", []
    images: list[tuple[str, bytes]] = []

    def said(e: ET.Element) -> str:
        if e.tag == f"{_W}t":
            return e.text or ""
        if e.tag == f"{_M}oMathPara":
            return "$$" + "".join(omml_to_latex(x).strip() for x in e.iter(f"{_M}oMath")) + "$$"
        if e.tag == f"{_M}oMath":
            return "$" + omml_to_latex(e).strip() + "$"
        if e.tag.endswith("}blip"):
            target = "word/" + (rels.get(e.get(f"{_R}embed")) or "")
            if target not in z.namelist():
                return ""
            name = f"img_{len(images) + 1:03d}.{target.rpartition('.')[2].lower()}"
            images.append((name, z.read(target)))
            return f"![image](assets/{name})"
        return "".join(map(said, e))

    def paragraph(p: ET.Element) -> str:
        style = p.find(f"{_W}pPr/{_W}pStyle")
        level = re.fullmatch(r"(?i)heading\s*([1-3])", style.get(f"{_W}val", "")) if headings and style is not None else None
        text = said(p).strip()
        return ("#" * int(level[1]) + " " if level and text else "") + text

    rows = [paragraph(p) for p in body.findall(f"{_W}p")]
    rows += [" | ".join(x for c in r.findall(f"{_W}tc") if (x := said(c).strip())) for t in body.findall(f"{_W}tbl") for r in t.findall(f"{_W}tr")]
    return "\n\n".join(x for x in rows if x), images


def docx_text(df: DataFrame, content: str = "content", headings: bool = False) -> DataFrame:
    """Adds ``text`` of a .docx given as bytes."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda b: docx_parts(b, headings)[0])

    return df.withColumn("text", run(F.col(content)))


def corpus_files(spark: SparkSession, path: str, recursive: bool = False, readers: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """(filename, text) of all files with a known suffix, in order of file name; files that give no text are left out.

    ``readers`` gives functions from bytes to text by suffix, for PDFs and for pictures that a vision client describes; without
    one such files are left out. A reader that fails on a file loses that file only."""
    own = readers or {}

    @F.pandas_udf("string")
    def decoded(suffix: pd.Series, data: pd.Series) -> pd.Series:
        def one(k: str, b: bytes) -> str:
            try:
                return own[k](b) if k in own else docx_parts(b)[0] if k == "docx" else bytes(b).decode("utf-8", "replace") if k in TEXTS else ""
            except Exception:
                return ""

        return pd.Series([one(k, b) for k, b in zip(suffix, data)])

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    d = raw.select(F.col("path"), F.element_at(F.split("path", "/"), -1).alias("filename"), "content").withColumn("_s", F.lower(F.regexp_extract("filename", r"\.([^.]+)$", 1)))
    d = d.where(F.col("_s").isin(*TEXTS, *DOCUMENTS, *IMAGES)).withColumn("_t", decoded("_s", "content"))
    text = F.when(F.col("_s").isin(*TEXTS), F.col("text")).otherwise(F.col("_t"))
    return imported(d, F.col("filename"), "_t").select("filename", "path", text.alias("text")).where(T.strip(F.col("text")) != "").select("filename", "text").orderBy("filename", "path")


def ingested(df: DataFrame, source: str, raw: str) -> DataFrame:
    """Adds ``platform`` and ``text`` to rows of (source, raw): files by suffix, fetched pages as HTML."""
    platform = T.detect_source(F.col(source))
    file = imported(df.withColumn("platform", platform), F.col(source), raw)
    return file.withColumn("text", F.when(F.col("platform") == "file", F.col("text")).otherwise(T.html_text(F.col(raw))))


def first_of(*paths: str) -> str:
    """The text of the first file that exists, '' without any; prompts, rubrics and arbitrated before combined reviews."""
    return next((open(p, encoding="utf-8", errors="replace").read() for p in paths if os.path.isfile(p)), "")


def prompts_for(sections: dict[str, str], defaults: dict[str, str], prefix: str = "") -> dict[str, str]:
    """For each role the profile's section of its name, else the default."""
    return {role: sections.get(prefix + role, text) for role, text in defaults.items()}
