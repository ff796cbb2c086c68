"""Column functions on texts. All stay in the JVM; patterns use (?iuUd) so that they fold and class characters as Unicode does."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The clean-up patterns in the order in which they apply; each match is removed.
BOILERPLATE = [
    r"(?m)^.*cookie[s]?\s*(policy|settings|preferences|consent).*$", r"(?m)^.*accept\s+(all\s+)?cookies.*$", r"(?m)^.*subscribe\s+(to\s+)?(our\s+)?newsletter.*$", r"(?m)^.*sign\s+up\s+for\s+.*newsletter.*$",
    r"(?m)^.*advertisement\s*[-–—]?\s*$", r"(?m)^.*skip\s+to\s+(main\s+)?content.*$", r"(?m)^.*toggle\s+navigation.*$", r"(?ms)^.*?Listen to CNN.*?$", r"(?m)^.*CNN\s+(Audio|Podcasts|Newsletter).*$",
    r"(?m)^.*Download our app.*$", r"(?m)^.*Get our free.*app.*$", r"(?m)^.*share\s+(this|on)\s+(facebook|twitter|x|linkedin|email).*$", r"(?m)^.*follow\s+us\s+on.*$", r"(?m)^.*(facebook|twitter|instagram|linkedin|youtube)\s*$",
    r"(?m)^(Home|News|World|Politics|Business|Opinion|Health|Entertainment|Style|Travel|Sports|Video|Audio)\s*$", r"(?m)^.*©\s*\d{4}.*$", r"(?m)^.*all\s+rights\s+reserved.*$", r"(?m)^.*terms\s+(of\s+)?(use|service).*$",
    r"(?m)^.*privacy\s+policy.*$", r"(?m)^.*sponsored\s+(content|by).*$", r"(?m)^.*paid\s+(content|partner).*$", r"(?m)(^\S{1,20}\s*\n){5,}", r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}[+\-]\d{2}:\d{2}",
    r"(?m)^\s*(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2}[,]?\s+\d{4}[,.]?\s*(?:\d{1,2}[:.]\d{2}\s*(?:a\.m\.|p\.m\.|AM|PM)?)?\s*(?:EST|PST|UTC|GMT|EDT|PDT)?\s*$",
    r"https?://[^\s)\]\"'<>]{10,}", r"&#?\w{2,8};", r"(?m)^.*(?:Special Investigations|Press Freedom Defense Fund|Impact\s*(?:&|and)\s*Reports).*$",
    r"(?m)^.*(?:Powered and implemented by|FactSet Digital Solutions|Mutual Fund and ETF data provided by).*$", r"(?m)^.*(?:Add \w+ (?:on|to) Google|Powered by \w+|Show me more content from).*$",
    r"(?m)^.*(?:Join Our (?:Talent|Newsletter) Community|CBS News Investigates|Updated on:).*$", r"(?m)^.*(?:Getty Images|AFP via Getty|Anadolu via Getty|AP Photo|Reuters).*$",
    r"(?m)^.*(?:Tiempo de lectura|Responsabilidad Social|Oportunidades de Empleo).*$", r"(?m)^.*(?:Screenshot from a video|A view of the site where|Photo:|Image:).*$",
]
# Hosts of chat exports.
PLATFORMS = {"chatgpt": r"chatgpt\.com|chat\.openai\.com", "gemini": r"gemini\.google\.com|g\.co/gemini", "perplexity": r"perplexity\.ai"}
# Heading of a chapter; marks around the list of inventions; slug patterns and length.
CHAPTER = r"(?md)^#{1,2}\s+(?:[一二三四五六七八九十]+、|\d+\.\s+|Chapter\s+\d+[.:]).+$"

INVENTED_FROM = ["【幻觉清单】", "## 幻觉清单", "### 幻觉清单", "幻觉清单："]
INVENTED_TO = ["【修改意见】", "【专家5】", "\n## 专家", "\n## 修改", "### 事实核查引用来源", "---\n\n### 事实核查引用来源"]
SLUGS = (r"share/([a-zA-Z0-9_-]+)", r"([a-zA-Z0-9]{10,})")


def strip(c: Column) -> Column:
    """Unicode strip."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def remove_boilerplate(c: Column) -> Column:
    """The patterns in order, then runs of blank lines shortened, then strip. Null stays null."""
    for p in BOILERPLATE:
        c = F.regexp_replace(c, "(?iuUd)" + p, "")
    c = F.regexp_replace(F.regexp_replace(c, r"\n{4,}", "\n\n"), r"\n{3,}", "\n\n")
    return strip(c)


def strip_meta_header(c: Column) -> Column:
    """The report header of mode A up to the first chapter, that of mode B, scattered statistics lines, long rules."""
    c = F.regexp_replace(c, r"(?s)\A(.*?)(?m:^)#\s*语料预处理报告.*?(?=(?m:^)## )", "$1")
    c = F.regexp_replace(c, r"(?s)\A(.*?)(?m:^)#\s*知识图谱语料.*?\n(?=(?m:^)## |\n## )", "$1")
    c = F.regexp_replace(c, r"(?md)^-\s*(?:有效文档|聚类数|压缩率|silhouette).*$", "")
    c = F.regexp_replace(c, r"(?md)^={10,}\s*$", "")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def published_date(c: Column) -> Column:
    """The first of four formats that reads the whole text, else null. ``operators.timestamps`` reads many more and settles zones."""
    c = strip(c)
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in ("yyyy-M-d", "yyyy-M-d'T'H:m:s", "MMMM d, yyyy", "d MMMM yyyy")])


def lines_normalised(c: Column) -> Column:
    """Non-empty stripped lines, a blank line between each two."""
    return F.array_join(F.filter(F.transform(F.split(c, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"), strip), lambda x: x != ""), "\n\n")


def html_text(c: Column) -> Column:
    """Scripts and styles dropped, tags to blanks, white space collapsed."""
    c = F.regexp_replace(c, r"(?is)<script[^>]*>.*?</script>", "")
    c = F.regexp_replace(c, r"(?is)<style[^>]*>.*?</style>", "")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"(?U)[\s\x1c-\x1f]+", " "))


def source_label(source: Column, published: Column, filename: Column) -> Column:
    """Source and date (time part off), else the file name."""
    date = strip(F.regexp_replace(published, r"T\d{2}:\d{2}:\d{2}[+\-]\d{2}:\d{2}", ""))
    return F.coalesce(F.nullif(F.concat_ws(" ", F.nullif(source, F.lit("")), F.nullif(date, F.lit(""))), F.lit("")), filename)


def detect_source(c: Column) -> Column:
    """S13."""
    s = F.trim(c)
    out = F.when(~s.rlike(r"^https?://"), "file")
    for name, p in PLATFORMS.items():
        out = out.when(s.rlike("(?i)" + p), name)
    return out.otherwise("generic")


def slug(c: Column, platform: Column) -> Column:
    """F15."""
    share, run = (F.nullif(F.substring(F.regexp_extract(c, p, 1), 1, 30), F.lit("")) for p in SLUGS)
    return F.concat_ws("_", platform, F.coalesce(share, run, F.lit("import")))


def truncate_notice(c: Column, n: int, notice: str = "\n\n[truncated]") -> Column:
    """S19."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(notice))).otherwise(c)


def tokens(c: Column) -> Column:
    """F2: lower-case runs of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def sentences(c: Column, least: int = 20) -> Column:
    """F1 and P12."""
    return F.filter(F.transform(F.split(c, r"(?U)(?<=[.!?。！？])[\s\x1c-\x1f]+"), strip), lambda x: F.length(x) > least)


def shingles(c: Column, k: int = 5) -> Column:
    """A3: the distinct k-character pieces of the normalised text; a shorter text is its own piece."""
    s = F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")
    # bound as a lambda variable, so that the text is normalised and split once and not for every piece
    cut = lambda signs: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(signs) - (k - 1)), lambda i: F.concat_ws("", F.slice(signs, i, F.lit(k)))))
    many = F.element_at(F.transform(F.array(F.split(s, "")), cut), 1)
    return F.when(F.length(s) < k, F.array(s)).otherwise(F.array_distinct(many))


def clean_json(c: Column) -> Column:
    """code fences off."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def strip_citations(c: Column) -> Column:
    """F11."""
    return F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]*\[\d+\]", "")


def mark_unverified(c: Column, numbers: list[int]) -> Column:
    """F12."""
    for n in numbers:
        c = F.replace(c, F.lit(f"[{n}]"), F.lit(f"[{n} 待验证]"))
    return c


def references(cites: Column, author_year: bool = False) -> Column:
    """one line per citation (url, title); with ``author_year`` also author and year where there are any."""
    said = lambda x: F.concat(F.coalesce(x["title"], x["url"], F.lit("")), F.lit(". "), F.coalesce(x["url"], F.lit("")))

    def line(x: Column, i: Column) -> Column:
        number = F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "))
        if not author_year:
            return F.concat(number, said(x))
        author, year = F.nullif(x["author"], F.lit("")), F.nullif(x["year"], F.lit(""))
        who = F.concat(F.coalesce(author, F.lit("Unknown")), F.coalesce(F.concat(F.lit(" ("), year, F.lit(")")), F.lit("")), F.lit(". "))
        return F.concat(number, F.when(author.isNotNull() | year.isNotNull(), who).otherwise(""), said(x))

    return F.concat_ws("\n", F.lit("## References\n"), F.transform(cites, line))


def xml_escape(c: Column) -> Column:
    """F25."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def keyword_flags(c: Column) -> dict[str, Column]:
    """P10: what marks in a review answer say."""
    return {"crossed": c.contains("❌"), "invented": c.rlike("幻觉|编造"), "missing_part": c.rlike("遗漏|缺失"), "no_note": c.contains("无需补注"), "covered": c.contains("覆盖充分")}


def config_hash(provider: Column, model: Column) -> Column:
    """F26."""
    return F.substring(F.md5(F.concat_ws("|", F.coalesce(provider, F.lit("")), F.coalesce(model, F.lit("")))), 1, 12)


def title_norm(c: Column) -> Column:
    """F8: heading marks and numbering off."""
    c = F.trim(F.regexp_replace(F.trim(c), r"^#+\s*", ""))
    c = F.regexp_replace(c, r"^[一二三四五六七八九十]+[、．,]\s*", "")
    return F.trim(F.regexp_replace(c, r"^\d+[.、]\s*", ""))


def image_ext(url: Column) -> Column:
    """The extension of an image's path, .png where it is none of the known."""
    e = F.lower(F.regexp_extract(url, r"(?i)\.(png|jpe?g|gif|webp|svg|bmp)(?:[?#].*)?$", 1))
    return F.concat(F.lit("."), F.when(e == "", "png").otherwise(e))


def image_ext_of(content_type: Column, data: Column) -> Column:
    """The extension of an image by its content type, else by its first bytes, .png where neither tells."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    out = F.when(kind.contains("png"), ".png")
    for name, ext in (("jpeg", ".jpg"), ("jpg", ".jpg"), ("gif", ".gif"), ("webp", ".webp"), ("bmp", ".bmp"), ("tif", ".tiff"), ("emf", ".emf"), ("wmf", ".wmf")):
        out = out.when(kind.contains(name), ext)
    head = F.hex(F.substring(data, 1, 12))
    return out.when(head.startswith("89504E470D0A1A0A"), ".png").when(head.startswith("FFD8"), ".jpg").when(head.startswith("47494638"), ".gif").when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), ".webp").otherwise(".png")


def math_count(c: Column) -> Column:
    """Mathematical letters and operators."""
    return F.length(c) - F.length(F.regexp_replace(c, r"[\x{2200}-\x{22FF}\x{1D400}-\x{1D7FF}\x{2070}-\x{209F}]", ""))


def block_kind(line: Column) -> Column:
    """F22 for one line."""
    s = F.trim(line)
    return (
        F.when(s == "", "blank").when(s.rlike(r"^#{1,6}\s+"), "heading").when(s.rlike(r"(?d)^(-{3,}|\*{3,}|_{3,})$"), "rule").when(s.rlike(r"^```"), "fence").when(s.rlike(r"^\[\^[^\]]+\]:"), "footnote").when(s.rlike(r"(?d)^!\[[^\]]*\]\([^)]+\)$"), "image").when(s.rlike(r"(?d)^\$\$(.+\$\$)?$|^\\\[(.+\\\])?$|^\\\]$"), "math")
        .when(s.rlike(r"(?d)^\|.*\|$"), "table").when(s.rlike(r"^[-*+]\s+"), "bullet").when(s.rlike(r"^\d+\.\s+"), "numbered").when(s.rlike(r"^>"), "quote").otherwise("text")
    )


def hallucination_section(c: Column) -> Column:
    """from the first of the start marks found to the earliest end mark."""
    starts = INVENTED_FROM
    part = F.lit(None).cast("string")
    for m in reversed(starts):
        part = F.when(F.instr(c, m) > 0, F.substring_index(F.substr(c, F.instr(c, m) + len(m)), "\0", 1)).otherwise(part)
    part = F.trim(part)
    for e in INVENTED_TO:
        part = F.substring_index(part, e, 1)
    return F.coalesce(strip(part), F.when(c.contains("未发现虚构"), "未发现虚构内容。"), F.lit(""))
