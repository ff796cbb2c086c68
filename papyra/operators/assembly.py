"""Report-level operators on ordered parts: fallback chapters, merging by title or ordinal, densities, issues, page parts, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions import markdown as M
from papyra.functions import text as T

# Title of a report without headings; order of entity labels; separators.
WHOLE = "正文"
LABELS = ["PERSON", "ORG", "GPE", "DATE", "NORP", "EVENT", "QUANTITY", "FAC"]
MODE_RULE = "\n\n" + "=" * 60 + "\n\n"


def split_report(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, header, level, chapters array<(title, body)>). Numbered headings of level one or two part the text; without
    any, those of level three with a body do; without these all is one chapter. Null and empty texts give one empty chapter."""
    c = F.coalesce(F.col(text), F.lit(""))
    third = r"(?m)^### .+$"

    def parts(pattern: str) -> Column:
        titles, bodies = F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.split(c, pattern, -1)
        return F.transform(titles, lambda t, i: F.struct(T.strip(t).alias("title"), T.strip(F.get(bodies, i + 1)).alias("body")))

    chapters = parts(T.CHAPTER)
    deep = F.transform(F.filter(parts(third), lambda x: x["body"] != ""), lambda x: F.struct(T.strip(F.regexp_replace(x["title"], "^#+", "")).alias("title"), x["body"].alias("body")))
    whole = F.array(F.struct(F.lit(WHOLE).alias("title"), c.alias("body")))
    level = F.when(F.size(chapters) > 0, "chapter").when(F.size(deep) > 0, "section").otherwise("whole")
    head = lambda p: T.strip(F.get(F.split(c, p, 2), F.lit(0)))
    d = df.select(key, chapters.alias("_c"), deep.alias("_d"), whole.alias("_w"), level.alias("level"), head(T.CHAPTER).alias("_h"), head(third).alias("_h3"))
    pick = F.when(F.col("level") == "chapter", F.col("_c")).when(F.col("level") == "section", F.col("_d")).otherwise(F.col("_w"))
    header = F.when(F.col("level") == "chapter", F.col("_h")).when(F.col("level") == "section", F.col("_h3")).otherwise("")
    return d.select(key, header.alias("header"), "level", pick.alias("chapters"))


def report_chapters(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per chapter of ``split_report``: (key, chap_ord, title, body)."""
    return split_report(df, key, text).select(key, F.posexplode("chapters").alias("chap_ord", "c")).select(key, "chap_ord", "c.title", "c.body")


def _islands(ch: DataFrame, key: str, label: Column) -> DataFrame:
    w = Window.partitionBy(key).orderBy("chap_ord")
    d = ch.withColumn("_l", F.coalesce(label, F.lit("")))
    return d.withColumn("island", F.sum((F.coalesce(F.lag("_l").over(w), F.lit("\0")) != F.col("_l")).cast("int")).over(w))


def merge_same_titles(ch: DataFrame, key: str) -> DataFrame:
    """Neighbouring chapters of one normalised title joined under the first title: (key, island, title, parts, body).
    Of later parts a level-two heading line, the first, is dropped."""
    later = T.strip(F.regexp_replace(F.concat(F.lit("\n"), F.col("body")), r"(?s)\A(.*?)\n[ \t]*## [^\n]*", "$1"))
    d = _islands(ch, key, T.title_norm(F.col("title"))).withColumn("_first", F.row_number().over(Window.partitionBy(key, "island").orderBy("chap_ord")) == 1)
    d = d.withColumn("_b", F.when(F.col("_first"), F.col("body")).otherwise(later))
    g = d.groupBy(key, "island").agg(F.min_by("title", "chap_ord").alias("title"), F.count(F.lit(1)).alias("parts"), F.sort_array(F.collect_list(F.struct("chap_ord", "_b"))).alias("l"))
    return g.select(key, "island", "title", "parts", F.array_join(F.transform("l", lambda x: x["_b"]), "\n\n").alias("body"))


def merge_subchapters(ch: DataFrame, key: str) -> DataFrame:
    """Neighbouring chapters of one ordinal joined under the first title; later ones keep their titles as headings."""
    t = T.strip(F.regexp_replace(F.col("title"), "^#+", ""))
    d = _islands(ch, key, M.ordinal_key(F.col("title"))).withColumn("_t", t)
    g = d.groupBy(key, "island").agg(F.min_by("_t", "chap_ord").alias("title"), F.count(F.lit(1)).alias("parts"), F.sort_array(F.collect_list(F.struct("chap_ord", "_t", "body"))).alias("l"))
    text = F.transform("l", lambda x, i: F.when(i == 0, x["body"]).otherwise(F.concat(F.lit("## "), x["_t"], F.lit("\n\n"), x["body"])))
    return g.select(key, "island", "title", "parts", F.array_join(text, "\n\n").alias("body"))


def chapter_densities(ch: DataFrame, outlines: DataFrame, key: str, default: float = 3.0) -> DataFrame:
    """Adds ``density`` by place from (key, densities array<double>); missing places and missing outlines give the default."""
    return ch.join(outlines.select(key, "densities"), key, "left").withColumn("density", F.coalesce(F.get("densities", F.col("chap_ord")), F.lit(default))).drop("densities")


def chapter_issues(ch: DataFrame, issues: DataFrame, key: str, n: int = 15) -> DataFrame:
    """(key, chap_ord, pos, line): what of a report's review concerns each chapter, at most n lines a chapter.

    ``issues`` has (key, kind, ord, severity, location, problem, suggestion), kind 0 top issues, 1 issues of a dimension, 2
    inventions, 3 missing topics. The first two concern a chapter whose title's first ten characters or number their location
    holds, or that name no place; the others all chapters."""
    i = issues.select(key, "kind", "ord", F.coalesce("severity", F.lit("中")).alias("severity"), F.coalesce("location", F.lit("")).alias("location"), F.coalesce("problem", F.lit("")).alias("problem"), F.coalesce("suggestion", F.lit("")).alias("suggestion"))
    j = ch.select(key, "chap_ord", F.substring(T.strip(F.regexp_replace("title", "^#+", "")), 1, 10).alias("_t"), (F.col("chap_ord") + 1).cast("string").alias("_n")).join(i, key)
    here = F.col("location").contains(F.col("_t")) | F.col("location").contains(F.concat(F.lit("第"), "_n")) | ((F.col("kind") == 0) & F.col("location").contains(F.concat(F.lit("章节"), "_n"))) | (F.col("location") == "")
    advice = F.concat(F.lit("- ["), "severity", F.lit("] "), "problem", F.lit(" → "), "suggestion")
    line = F.when(F.col("kind") == 2, F.concat(F.lit("- [高][幻觉] 疑似编造，须删除: "), "problem")).when(F.col("kind") == 3, F.concat(F.lit("- [中][遗漏] 原始语料有但未覆盖: "), "problem")).otherwise(advice)
    w = Window.partitionBy(key, "chap_ord").orderBy("kind", "ord", "problem")
    return j.where((F.col("kind") >= 2) | here).select(key, "chap_ord", F.row_number().over(w).alias("pos"), line.alias("line")).where(F.col("pos") <= n)


def invented(verified: DataFrame, issues: DataFrame, key: str) -> DataFrame:
    """The doubtful facts of a check and the problems that speak of inventions, as a bag: (key, problem)."""
    return verified.select(key, "problem").union(issues.where(T.keyword_flags(F.col("problem"))["invented"]).select(key, "problem"))


def toc(ch: DataFrame, key: str) -> DataFrame:
    """(key, toc), the titles of a report as a list."""
    g = ch.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("chap_ord", "title"))).alias("l"))
    return g.select(key, F.array_join(F.transform("l", lambda x: F.concat(F.lit("- "), x["title"])), "\n").alias("toc"))


def page_segments(pages: DataFrame, key: str, parts: str) -> DataFrame:
    """(key, pos, segment): the elements of a page (array<array<struct<type,value,src,alt,latex,display>>>) as text.

    Images are numbered through the page, formulas set in $ or $$; a segment of more than two characters is kept where it first stands."""
    flat = F.flatten(F.transform(parts, lambda e, i: F.transform(e, lambda p, j: F.struct(i.alias("e"), j.alias("j"), p.alias("p")))))
    pics = F.filter(flat, lambda x: x["p"]["type"] == "image")
    number = lambda i, j: F.size(F.filter(pics, lambda x: (x["e"] < i) | ((x["e"] == i) & (x["j"] <= j))))

    def show(p: Column, i: Column, j: Column) -> Column:
        image = F.concat(F.lit("!["), F.coalesce(p["alt"], F.lit("")), F.lit("](assets/img_"), F.format_string("%03d", number(i, j)), T.image_ext(F.coalesce(p["src"], F.lit(""))), F.lit(")"))
        formula = F.when(F.coalesce(p["display"], F.lit(False)), F.concat(F.lit("\n$$\n"), p["latex"], F.lit("\n$$\n"))).otherwise(F.concat(F.lit("$"), p["latex"], F.lit("$")))
        return F.when(p["type"] == "text", p["value"]).when(p["type"] == "image", image).when(p["type"] == "formula", formula)

    text = F.transform(parts, lambda e, i: T.strip(F.array_join(F.transform(e, lambda p, j: show(p, i, j)), " ")))
    return keep_segments(pages.select(key, F.posexplode(text).alias("pos", "segment")), key)


def keep_segments(rows: DataFrame, key: str, least: int = 2) -> DataFrame:
    """Of (key, pos, segment) the segments longer than ``least``, each where it first stands."""
    return rows.where(F.length("segment") > least).groupBy(key, "segment").agg(F.min("pos").alias("pos")).select(key, "pos", "segment")


def remapped_images(df: DataFrame, key: str, text: str, images: str) -> DataFrame:
    """(key, text, images): file names of images numbered through all rows in order of key, in lists and in the text.
    Old names become marks first, so that no new name is taken for an old one."""
    from papyra.operators.reports import number_images

    numbers = number_images(df, key, images).groupBy(key).agg(F.min("img_no").alias("_from"))
    d = df.join(numbers, key, "left")
    new = lambda i, old: F.concat(F.lit("img_"), F.format_string("%03d", F.col("_from") + i), F.regexp_extract(old, r"(\.[^./]*)?$", 0))
    pairs = F.transform(images, lambda x, i: F.struct(i.alias("i"), x["filename"].alias("old"), new(i, x["filename"]).alias("new")))
    mark = lambda i: F.concat(F.lit("assets/\x01"), i.cast("string"), F.lit("\x01"))
    marked = F.aggregate(pairs, F.coalesce(F.col(text), F.lit("")), lambda t, p: F.replace(t, F.concat(F.lit("assets/"), p["old"]), mark(p["i"])))
    named = F.aggregate(pairs, marked, lambda t, p: F.replace(t, mark(p["i"]), F.concat(F.lit("assets/"), p["new"])))
    renamed = F.transform(images, lambda x, i: x.withField("filename", new(i, x["filename"])))
    return d.select(key, F.when(F.col("_from").isNull(), F.coalesce(text, F.lit(""))).otherwise(named).alias("text"), F.when(F.col("_from").isNull(), F.col(images)).otherwise(renamed).alias("images"))


def longest_paragraph(paras: DataFrame, key: str, least: int = 100, cut: int = 500) -> DataFrame:
    """(key, para): of the paragraphs longer than ``least`` the longest, of equals the first, cut."""
    p = paras.select(key, "para_ord", T.strip(F.col("para")).alias("para")).where(F.length("para") > least)
    best = p.groupBy(key).agg(F.max(F.struct(F.length("para").alias("n"), (-F.col("para_ord")).alias("o"), "para")).alias("b"))
    return best.select(key, F.substring("b.para", 1, cut).alias("para"))


def drift(before: DataFrame, after: DataFrame, key: str, claims: str = "claims") -> DataFrame:
    """(key, retained, lost, added, n_retained, n_lost, n_added) of claims that are word for word the same; the
    comparison by meaning is an external step."""
    j = before.select(key, F.col(claims).alias("_a")).join(after.select(key, F.col(claims).alias("_b")), key, "full")
    a, b = (F.coalesce(c, F.array().cast("array<string>")) for c in ("_a", "_b"))
    d = j.select(key, F.array_intersect(a, b).alias("retained"), F.array_except(a, b).alias("lost"), F.array_except(b, a).alias("added"))
    return d.select("*", *[F.size(x).alias(f"n_{x}") for x in ("retained", "lost", "added")])


def score_range(df: DataFrame, score: str) -> DataFrame:
    """A18."""
    return df.agg(F.min(score).alias("least"), F.max(score).alias("most"), F.round(F.avg(score), 6).alias("mean"))


def both_modes(a: Column, b: Column) -> Column:
    """The texts of both modes with the rule between them (which ``strip_meta_header`` takes off)."""
    return F.concat_ws(MODE_RULE, a, b)
