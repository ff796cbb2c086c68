"""Column functions on report Markdown and on JSON answers. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyra.functions.text import strip

# Numerals that number chapters, in order; labels of versions; limits of digests.
NUMERALS = "一 二 三 四 五 六 七 八 九 十".split()
OLD_LABELS = ["2.0", "1.0", "补充完整版"]
NEW_LABEL, CITED_LABEL, V5_SUFFIX = "3.0 最终版", "4.0（含引用）", " 5.0版"
CITED = r"3\.0\s*最终版|研究报告\s*3\.0|报告\s*3\.0"
DIGEST, DIGEST_CHAPTER = 8000, 1200
DEFAULT_TITLE = "深度调查报告"
DEFAULT_OUTLINE = ["一、概述与背景", "二、核心分析", "三、案例与数据", "四、结论与建议"]
INLINE = r"\[[^\]]+\]\([^)]+\)|\*\*[^*]+\*\*|\*[^*]+\*|\[\d+(?:\s*待验证)?\]"
FOOTNOTE = r"(?m)^\[\^(\d+)\]:[ \t]*(.+)$"


def doc_title(c: Column) -> Column:
    """the first heading of level one, '' without any."""
    return strip(F.regexp_extract(c, r"(?m)^#\s+(.+)$", 1))


def keywords(c: Column) -> Column:
    """the keyword line's parts, an empty array without such a line."""
    line = F.regexp_extract(c, r"(?m)\*\*关键词\*\*[：:]\s*(.+)$", 1)
    return F.when(F.coalesce(line, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(line, "、"), strip))


def inline_tokens(c: Column) -> Column:
    """array of (kind, token) of links, bold, italic and citation marks in order. Formulas are ``inline_math``."""
    kind = lambda x: F.when(x.rlike(r"^\[[^\]]+\]\("), "link").when(x.startswith("**"), "bold").when(x.startswith("*"), "italic").otherwise("citation")
    return F.transform(F.regexp_extract_all(c, F.lit(INLINE), F.lit(0)), lambda x: F.struct(kind(x).alias("kind"), x.alias("token")))


def inline_math(c: Column) -> Column:
    r"""the formulas between single $ signs or \( and \)."""
    hits = F.regexp_extract_all(c, F.lit(r"(?<!\$)\$(?!\$)(.+?)(?<!\$)\$(?!\$)|\\\((.+?)\\\)"), F.lit(0))
    return F.transform(hits, lambda x: F.regexp_replace(x, r"^(?:\$|\\\()|(?:\$|\\\))$", ""))


def table_cells(line: Column) -> Column:
    """the non-empty cells of a table line."""
    return F.filter(F.transform(F.split(line, r"\|"), strip), lambda x: x != "")


def is_separator(cells: Column) -> Column:
    """whether the cells are those of the line under a table's head."""
    return (F.size(cells) > 0) & F.forall(cells, lambda x: x.rlike(r"^[-:]+$"))


def alignments(cells: Column) -> Column:
    """left, center or right for each cell of a separator line."""
    one = lambda x: F.when(~x.rlike(r"^[-:]+$"), "left").when(x.startswith(":") & x.endswith(":"), "center").when(x.endswith(":"), "right").otherwise("left")
    return F.transform(cells, one)


def footnote_refs(c: Column) -> Column:
    """The numbers of footnote marks in order of their places, definitions left out."""
    return F.transform(F.regexp_extract_all(F.regexp_replace(c, FOOTNOTE, ""), F.lit(r"\[\^(\d+)\]"), F.lit(1)), lambda x: x.try_cast("int"))


def footnotes(c: Column) -> Column:
    """Array of (number, text) sorted by number; the last of a doubled definition counts."""
    lines = F.filter(F.split(c, "\n"), lambda x: x.rlike(r"^\[\^\d+\]:\s*\S"))
    pairs = F.transform(lines, lambda x, i: F.struct(F.regexp_extract(x, r"^\[\^(\d+)\]", 1).try_cast("long").alias("number"), (-i).alias("at"), strip(F.regexp_replace(x, r"^\[\^\d+\]:\s*", "")).alias("text")))
    ordered = F.array_sort(F.filter(pairs, lambda p: p["number"].isNotNull()))
    first = F.filter(ordered, lambda p, i: (i == 0) | (F.get(ordered, i - 1)["number"] != p["number"]))
    return F.transform(first, lambda p: F.struct(p["number"].alias("number"), p["text"].alias("text")))


def ordinal_key(title: Column) -> Column:
    """the numeral or number a chapter title begins with, else its first twenty characters. Heading marks are taken off first."""
    t = strip(F.regexp_replace(title, r"^#+\s*", ""))
    numeral = F.regexp_extract(t, "^(" + "|".join(NUMERALS) + ")[、．,]", 1)
    number = F.regexp_extract(t, r"^(\d+)[.\s、]", 1)
    return F.coalesce(F.nullif(numeral, F.lit("")), F.nullif(number, F.lit("")), F.substring(t, 1, 20))


def renumbered(c: Column, offset: Column) -> Column:
    """Every [n] becomes [n + offset]."""
    texts, marks = F.split(c, r"\[\d+\]", -1), F.regexp_extract_all(c, F.lit(r"\[(\d+)\]"), F.lit(1))
    number = lambda m: F.concat(F.lit("["), (m.cast("decimal(38,0)") + offset).cast("string"), F.lit("]"))
    return F.array_join(F.transform(texts, lambda x, i: F.concat(x, F.coalesce(number(F.get(marks, i)), F.lit("")))), "")


def list_lines(c: Column, least: int, n: int) -> Column:
    """The lines of an answer longer than ``least``, list numbers and bullets off, the first n."""
    lines = F.filter(F.transform(F.split(F.trim(c), "\n"), strip), lambda x: F.length(x) > least)
    return F.slice(F.transform(lines, lambda x: F.regexp_replace(x, r"^[0-9.\-) ]+", "")), 1, n)


def int_or(c: Column, default: int) -> Column:
    """F27."""
    return F.coalesce(strip(c).try_cast("int"), F.lit(default))


def replace_first(c: Column, pattern: str, new: str) -> Column:
    """The first match of a pattern replaced, others kept."""
    return F.array_join(F.split(c, pattern, 2), new)


def final_header(header: Column) -> Column:
    """the first old version label that occurs becomes that of the final version."""
    out = header
    for label in reversed(OLD_LABELS):
        out = F.when(header.contains(label), replace_first(header, label.replace(".", r"\."), NEW_LABEL)).otherwise(out)
    return out


def cited_label(c: Column) -> Column:
    """the label of the version with citations."""
    return replace_first(c, CITED, CITED_LABEL)


def v5_title(c: Column) -> Column:
    """the version appended to a first line that is a heading and does not name it yet."""
    line = F.substring_index(c, "\n", 1)
    return F.when(line.startswith("# ") & ~line.contains("5.0"), F.concat(F.rtrim(line), F.lit(V5_SUFFIX), F.substr(c, F.length(line) + 1))).otherwise(c)


def outline(answer: Column) -> Column:
    """(title, summary, keywords, chapters, parsed) of an outline answer.

    Code fences are taken off; what does not parse is cut at its last "level1" and tried again; then title, summary
    and at most five keywords are looked for by pattern, with the default outline."""
    shape = "struct<title:string,summary:string,keywords:array<string>,outline:array<struct<level1:string,density:double>>>"
    text = strip(F.regexp_replace(F.regexp_replace(strip(answer), r"^```\w*\n?", ""), r"\n?```$", ""))
    flat = F.regexp_replace(text, r"\r\n|\n", " ")
    open_ = flat.contains('"outline":') & ~F.rtrim(flat).endswith("}") & flat.contains('"level1"')
    fixed = F.when(open_, F.concat(F.regexp_replace(flat, r',?\s*\{?\s*"level1"(?!.*"level1").*$', ""), F.lit("]}")))
    first, second = F.from_json(text, shape), F.from_json(fixed, shape)
    pick = lambda p, k, d: F.coalesce(F.nullif(strip(F.regexp_extract(text, p, k)), F.lit("")), F.lit(d))
    words = F.slice(F.regexp_extract_all(F.regexp_extract(text, r'(?s)"keywords"\s*:\s*\[(.*?)\]', 1), F.lit('"([^"]+)"'), F.lit(1)), 1, 5)
    whole = lambda p: p.isNotNull() & (p["title"].isNotNull() | p["outline"].isNotNull())
    got = F.when(whole(first), first).when(whole(second), second)
    chapters = F.transform(got["outline"], lambda x: F.struct(x["level1"].alias("level1"), F.coalesce(x["density"], F.lit(3.0)).alias("density")))
    default = F.array(*[F.struct(F.lit(x).alias("level1"), F.lit(3.0).alias("density")) for x in DEFAULT_OUTLINE])
    return F.struct(
        F.when(got.isNotNull(), F.coalesce(got["title"], F.lit(DEFAULT_TITLE))).otherwise(pick(r'"title"\s*:\s*"([^"]*)"', 1, DEFAULT_TITLE)).alias("title"),
        F.when(got.isNotNull(), F.coalesce(got["summary"], F.lit(""))).otherwise(pick(r'"summary"\s*:\s*"([^"]*)"', 1, "")).alias("summary"),
        F.when(got.isNotNull(), F.coalesce(got["keywords"], F.array().cast("array<string>"))).otherwise(words).alias("keywords"),
        F.when(got.isNotNull(), F.coalesce(chapters, default)).otherwise(default).alias("chapters"),
        F.when(whole(first), "whole").when(whole(second), "cut").otherwise("pattern").alias("parsed"),
    )


def structure(answer: Column) -> Column:
    """the chapters (number, title) of a structure answer, given as an object with chapters or as a bare list; empty where neither parses."""
    item = "array<struct<num:string,title:string>>"
    text = strip(F.regexp_replace(F.regexp_replace(strip(answer), r"^```\w*\n?", ""), r"\n?```$", ""))
    inner = F.get_json_object(text, "$.chapters")
    return F.coalesce(F.from_json(inner, item), F.when(text.startswith("["), F.from_json(text, item)), F.array().cast(item))


def assembled(title: Column, summary: Column, words: Column, chapters: Column) -> Column:
    """title, summary as a quotation, keywords, a rule, and the chapters (array of (title, body)); a chapter without a heading gets its title as one."""
    head = F.concat(F.lit("# "), title, F.lit("\n\n> "), summary, F.lit("\n\n**关键词**："), F.array_join(words, ", "), F.lit("\n\n---\n\n"))
    part = lambda x: F.when(strip(x["body"]).startswith("#"), strip(x["body"])).otherwise(F.concat(F.lit("## "), x["title"], F.lit("\n\n"), strip(x["body"])))
    return F.concat(head, F.array_join(F.transform(chapters, lambda x: F.concat(part(x), F.lit("\n\n"))), "\n"))


def digest(chapters: Column) -> Column:
    """the start of every chapter (array of (title, body)), each cut so that all fit, cut at the limit."""
    each = F.least(F.lit(DIGEST_CHAPTER), F.floor(F.lit(DIGEST) / F.greatest(F.size(chapters), F.lit(1)))).cast("int")
    parts = F.transform(chapters, lambda x: F.concat(F.lit("\n\n## "), x["title"], F.lit("\n"), F.substr(x["body"], F.lit(1), each)))
    return F.substring(F.array_join(parts, ""), 1, DIGEST)


def issue_list(issues: Column) -> Column:
    """a consistency report of an array of (type, severity, location, description, suggestion)."""
    said = lambda x, k, d: F.coalesce(x[k], F.lit(d))
    one = lambda x, i: F.concat(
        F.lit("## 问题 "), (i + 1).cast("string"), F.lit("\n- **类型**: "), said(x, "type", "未知"), F.lit("\n- **严重程度**: "), said(x, "severity", "未知"),
        F.lit("\n- **位置**: "), said(x, "location", "未知"), F.lit("\n- **描述**: "), said(x, "description", ""), F.lit("\n- **建议**: "), said(x, "suggestion", ""), F.lit("\n"),
    )
    return F.concat_ws("\n", F.lit("# 全文一致性校验报告\n"), F.concat(F.lit("共发现 "), F.size(issues).cast("string"), F.lit(" 个问题\n")), F.transform(issues, one))


def sources_list(cites: Column, n: int | None = None) -> Column:
    """Numbered links of (url, title), the first n if given."""
    some = F.slice(cites, 1, n) if n else cites
    return F.array_join(F.transform(some, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". ["), F.coalesce(x["title"], x["url"], F.lit("")), F.lit("]("), F.coalesce(x["url"], F.lit("")), F.lit(")"))), "\n")


def section(text: Column, name: Column) -> Column:
    """The section of a rubric whose level-two heading begins with a name, up to the next level-two heading; null without one."""
    parts = F.split(text, r"(?m)(?=^## )")
    return F.get(F.transform(F.filter(parts, lambda x: x.startswith(F.concat(F.lit("## "), name))), strip), F.lit(0))
