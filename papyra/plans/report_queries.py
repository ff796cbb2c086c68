"""Queries of the report-level operators over whole tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra.functions import markdown as M
from papyra.functions import text as T
from papyra.operators import assembly, corpus, graph, knowledge, reports, state
from papyra.operators.common import table
from papyra.plans.queries import _DOCS, _FOUND, _MENT, _PARAS, _WS, _mentions, docs, first, query

_STRIP = lambda x: f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"
_CH = r"(?m)^#{1,2}\s+(?:[一二三四五六七八九十]+、|\d+\.\s+|Chapter\s+\d+[.:]).+$"
_CHAPTERS = f"(SELECT doc_id, CAST(i - 1 AS INT) chap_ord, {_STRIP('titles[i]')} title, {_STRIP('bodies[i + 1]')} body FROM (SELECT doc_id, titles, bodies, unnest(generate_series(1, len(titles))) i FROM (SELECT doc_id, regexp_extract_all(text, '{_CH}') titles, regexp_split_to_array(text, '{_CH}') bodies FROM documents WHERE text IS NOT NULL)))"
_NORM = f"trim(regexp_replace(regexp_replace(trim(regexp_replace(trim(title, ' '), '^#+\\s*', ''), ' '), '^[一二三四五六七八九十]+[、．,]\\s*', ''), '^\\d+[.、]\\s*', ''), ' ')"
_BARE = _STRIP("regexp_replace(title, '^#+', '')")
_ORD = f"coalesce(nullif(regexp_extract({_BARE}, '^(一|二|三|四|五|六|七|八|九|十)[、．,]', 1), ''), nullif(regexp_extract({_BARE}, '^(\\d+)[.\\s、]', 1), ''), substr({_BARE}, 1, 20))"
_ISLANDS = lambda label: f"(SELECT *, sum(ch) OVER (PARTITION BY doc_id ORDER BY chap_ord) island FROM (SELECT *, CASE WHEN {label} IS DISTINCT FROM lag({label}) OVER (PARTITION BY doc_id ORDER BY chap_ord) THEN 1 ELSE 0 END ch FROM {_CHAPTERS}))"


def chapters(s, d):
    return reports.chapters(table(s, d, "documents"), "doc_id", "text")


@query(f"SELECT * FROM {_CHAPTERS}")
def chapter_rows(s, d):
    return chapters(s, d)


@query(f"WITH c AS (SELECT * FROM {_CHAPTERS}), w AS (SELECT doc_id, chap_ord, coalesce(lag(body) OVER o, '') b, coalesce(lead(body) OVER o, '') n, coalesce(lag(title) OVER o, '') prev_title, coalesce(lead(title) OVER o, '') next_title FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY chap_ord)) SELECT doc_id, chap_ord, {_STRIP('right(b, 500)')} prev_summary, {_STRIP('substr(n, 1, 500)')} next_summary, prev_title, next_title FROM w")
def chapter_contexts(s, d):
    return reports.contexts(chapters(s, d), "doc_id")


@query(f"SELECT doc_id, string_agg('- ' || title, chr(10) ORDER BY chap_ord) toc FROM {_CHAPTERS} GROUP BY 1")
def chapter_toc(s, d):
    return assembly.toc(chapters(s, d), "doc_id")


@query(f"SELECT doc_id, CASE WHEN n > 0 THEN 'chapter' WHEN m > 0 THEN 'section' ELSE 'whole' END AS level, CAST(CASE WHEN n > 0 THEN n WHEN m > 0 THEN m ELSE 1 END AS INT) parts FROM (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{_CH}')) n, len(list_filter(regexp_split_to_array(coalesce(text, ''), '(?m)^### .+$')[2:], lambda x: {_STRIP('x')} <> '')) m FROM documents)")
def report_parts(s, d):
    return assembly.split_report(table(s, d, "documents"), "doc_id", "text").select("doc_id", "level", F.size("chapters").alias("parts"))


@query(f"SELECT doc_id, CAST(island AS BIGINT) island, arg_min(title, chap_ord) title, count(*) parts, CAST(sum(length(body)) AS BIGINT) chars FROM {_ISLANDS(_ORD)} GROUP BY doc_id, island")
def merge_subchapters(s, d):
    ch = chapters(s, d)
    return subchapter_sizes(assembly.merge_subchapters(ch, "doc_id"), ch)


def subchapter_sizes(m, ch):
    """Sizes of merged chapters without the headings that merging adds, beside their first titles as they stand."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("chap_ord")
    key = M.ordinal_key(F.col("title"))
    i = ch.withColumn("_k", key).withColumn("_n", (F.coalesce(F.lag("_k").over(w), F.lit("\0")) != F.col("_k")).cast("int")).withColumn("island", F.sum("_n").over(w))
    g = i.groupBy("doc_id", "island").agg(F.min_by("title", "chap_ord").alias("title"), F.sum(F.length("body")).alias("chars"))
    return m.select("doc_id", "island", "parts").join(g, ["doc_id", "island"])


@query(f"SELECT doc_id, CAST(island AS BIGINT) island, arg_min(title, chap_ord) title, count(*) parts FROM {_ISLANDS(_NORM)} GROUP BY doc_id, island")
def merge_same_titles(s, d):
    return assembly.merge_same_titles(chapters(s, d), "doc_id").select("doc_id", "island", "title", "parts")


@query(f"SELECT doc_id, chap_ord, {_ORD} AS key, {_NORM} AS norm FROM {_CHAPTERS}")
def title_keys(s, d):
    return chapters(s, d).select("doc_id", "chap_ord", M.ordinal_key(F.col("title")).alias("key"), T.title_norm(F.col("title")).alias("norm"))


@query(f"SELECT doc_id, chap_ord, coalesce([CAST(doc_id % 5 + 1 AS DOUBLE), 2.0][chap_ord + 1], 3.0) density FROM {_CHAPTERS}")
def chapter_densities(s, d):
    outlines = table(s, d, "documents").select("doc_id", F.array((F.col("doc_id") % 5 + 1).cast("double"), F.lit(2.0)).alias("densities"))
    return assembly.chapter_densities(chapters(s, d), outlines, "doc_id").select("doc_id", "chap_ord", "density")


_ISSUES = "(SELECT doc_id, k % 4 kind, k ord, ['高', '中', '低'][k % 3 + 1] severity, ['', '第2章', coalesce(substr(title, 1, 6), ''), '章节1'][k % 4 + 1] || CASE WHEN k > 3 THEN '段' ELSE '' END AS location, 'p' || k problem, 's' || k suggestion FROM (SELECT doc_id, title, unnest(generate_series(0, 7)) k FROM documents))"


@query(f"""SELECT doc_id, chap_ord, CAST(pos AS INT) pos, line FROM (SELECT c.doc_id, chap_ord, row_number() OVER (PARTITION BY c.doc_id, chap_ord ORDER BY kind, ord, problem) pos, CASE kind WHEN 2 THEN '- [高][幻觉] 疑似编造，须删除: ' || problem WHEN 3 THEN '- [中][遗漏] 原始语料有但未覆盖: ' || problem ELSE '- [' || severity || '] ' || problem || ' → ' || suggestion END line
FROM (SELECT *, substr({_BARE}, 1, 10) t, CAST(chap_ord + 1 AS VARCHAR) n FROM {_CHAPTERS}) c JOIN {_ISSUES} i ON c.doc_id = i.doc_id WHERE kind >= 2 OR contains(location, t) OR contains(location, '第' || n) OR (kind = 0 AND contains(location, '章节' || n)) OR location = '') WHERE pos <= 15""")
def chapter_issues(s, d):
    k = F.col("k")
    place = F.element_at(F.array(F.lit(""), F.lit("第2章"), F.coalesce(F.substring("title", 1, 6), F.lit("")), F.lit("章节1")), (k % 4 + 1).cast("int"))
    i = table(s, d, "documents").select("doc_id", "title", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")).select(
        "doc_id", (k % 4).alias("kind"), k.alias("ord"), F.element_at(F.array(F.lit("高"), F.lit("中"), F.lit("低")), (k % 3 + 1).cast("int")).alias("severity"),
        F.concat(place, F.when(k > 3, "段").otherwise("")).alias("location"), F.concat(F.lit("p"), k.cast("string")).alias("problem"), F.concat(F.lit("s"), k.cast("string")).alias("suggestion"),
    )
    return assembly.chapter_issues(chapters(s, d), i, "doc_id")


@query(f"SELECT doc_id, substr(string_agg(chr(10) || chr(10) || '## ' || title || chr(10) || substr(body, 1, CAST(least(1200, 8000 // n) AS BIGINT)), '' ORDER BY chap_ord), 1, 8000) digest FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) n FROM {_CHAPTERS}) GROUP BY 1")
def chapter_digests(s, d):
    ch = assembly.split_report(table(s, d, "documents"), "doc_id", "text").where("level = 'chapter'")
    return ch.select("doc_id", M.digest(F.col("chapters")).alias("digest"))


@query(f"""SELECT c.doc_id, md5('# ' || coalesce(any_value(d.title), '') || chr(10) || chr(10) || '> ' || coalesce(any_value(d.category), '') || chr(10) || chr(10) || '**关键词**：' || coalesce(any_value(d.source), '') || ', ' || coalesce(any_value(d.category), '') || chr(10) || chr(10) || '---' || chr(10) || chr(10) || string_agg(CASE WHEN starts_with({_STRIP('c.body')}, '#') THEN {_STRIP('c.body')} ELSE '## ' || c.title || chr(10) || chr(10) || {_STRIP('c.body')} END || chr(10) || chr(10), chr(10) ORDER BY chap_ord)) report_md5
FROM {_CHAPTERS} c JOIN documents d ON c.doc_id = d.doc_id GROUP BY c.doc_id""")
def assembled_reports(s, d):
    x = table(s, d, "documents")
    ch = assembly.split_report(x, "doc_id", "text").where("level = 'chapter'").join(x.select("doc_id", "title", "category", "source"), "doc_id")
    e = lambda c: F.coalesce(c, F.lit(""))
    return ch.select("doc_id", F.md5(M.assembled(e("title"), e("category"), F.array(e("source"), e("category")), F.col("chapters"))).alias("report_md5"))


@query("SELECT doc_id, CAST(i - 1 AS INT) pos, CASE WHEN regexp_matches(t, '^\\[[^\\]]+\\]\\(') THEN 'link' WHEN starts_with(t, '**') THEN 'bold' WHEN starts_with(t, '*') THEN 'italic' ELSE 'citation' END kind, t AS token FROM (SELECT doc_id, unnest(l) t, generate_subscripts(l, 1) i FROM (SELECT doc_id, regexp_extract_all(text, '\\[[^\\]]+\\]\\([^)]+\\)|\\*\\*[^*]+\\*\\*|\\*[^*]+\\*|\\[\\d+(?:\\s*待验证)?\\]') l FROM documents))")
def inline_tokens(s, d):
    return table(s, d, "documents").select("doc_id", F.posexplode(M.inline_tokens(F.col("text"))).alias("pos", "t")).select("doc_id", "pos", "t.kind", "t.token")


@query(f"SELECT extract_id, line_no, n_cells, sep, aligned FROM (SELECT extract_id, CAST(i - 1 AS INT) line_no, CAST(len(c) AS INT) n_cells, len(c) > 0 AND len(list_filter(c, lambda x: NOT regexp_matches(x, '^[-:]+$'))) = 0 sep, array_to_string(list_transform(c, lambda x: CASE WHEN NOT regexp_matches(x, '^[-:]+$') THEN 'left' WHEN starts_with(x, ':') AND ends_with(x, ':') THEN 'center' WHEN ends_with(x, ':') THEN 'right' ELSE 'left' END), ' ') aligned FROM (SELECT extract_id, i, list_filter(list_transform(string_split(l, '|'), lambda x: {_STRIP('x')}), lambda x: x <> '') c FROM (SELECT doc_id extract_id, unnest(string_split(text, chr(10))) l, generate_subscripts(string_split(text, chr(10)), 1) i FROM documents WHERE text IS NOT NULL) WHERE contains(l, '|')))")
def table_lines(s, d):
    lines = table(s, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("extract_id"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "l")).where(F.col("l").contains("|"))
    c = lines.withColumn("c", M.table_cells(F.col("l")))
    return c.select("extract_id", "line_no", F.size("c").alias("n_cells"), M.is_separator(F.col("c")).alias("sep"), F.array_join(M.alignments(F.col("c")), " ").alias("aligned"))


@query(f"SELECT doc_id, number, {_STRIP('arg_max(t, i)')} AS text FROM (SELECT doc_id, i, TRY_CAST(regexp_extract(l, '^\\[\\^(\\d+)\\]', 1) AS BIGINT) number, regexp_replace(l, '^\\[\\^\\d+\\]:\\s*', '') t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) l, generate_subscripts(string_split(text, chr(10)), 1) i FROM documents WHERE text IS NOT NULL) WHERE regexp_matches(l, '^\\[\\^\\d+\\]:\\s*[^\\s]')) WHERE number IS NOT NULL GROUP BY doc_id, number")
def footnotes(s, d):
    return table(s, d, "documents").select("doc_id", F.inline(M.footnotes(F.col("text"))))


@query(f"SELECT doc_id, {_STRIP(chr(39).join(['regexp_extract(text, ', '(?m)^#[ ' + chr(92) + 't]+(.+)$', ', 1)']))} title FROM documents WHERE text IS NOT NULL")
def doc_titles(s, d):
    return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", T.strip(F.regexp_extract("text", r"(?md)^#[ \t]+(.+)$", 1)).alias("title"))


@query(f"SELECT finding_id, array_to_string(list_transform(generate_series(1, len(p)), lambda i: p[i] || coalesce('[' || CAST(CAST(m[i] AS HUGEINT) + finding_id AS VARCHAR) || ']', '')), '') AS text FROM (SELECT finding_id, regexp_split_to_array(answer, '\\[\\d+\\]') p, regexp_extract_all(answer, '\\[(\\d+)\\]', 1) m FROM {_FOUND} WHERE answer IS NOT NULL)")
def citations_renumbered(s, d):
    return first(s, d, "research_findings", text=M.renumbered(F.col("answer"), F.col("finding_id"))).where("text IS NOT NULL")


@query(f"SELECT finding_id, array_to_string(list_transform(list_filter(list_transform(string_split(trim(answer, ' '), chr(10)), lambda x: {_STRIP('x')}), lambda x: length(x) > 15)[1:10], lambda x: regexp_replace(x, '^[0-9.\\-) ]+', '')), chr(10)) lines FROM {_FOUND} WHERE answer IS NOT NULL")
def list_lines(s, d):
    return first(s, d, "research_findings", lines=F.array_join(M.list_lines(F.col("answer"), 15, 10), "\n")).where("lines IS NOT NULL")


@query("SELECT finding_id, array_to_string(list_transform(citations[1:5], lambda x, i: i || '. [' || coalesce(x.title, x.url, '') || '](' || coalesce(x.url, '') || ')'), chr(10)) sources FROM (SELECT finding_id, any_value(citations) citations FROM research_findings GROUP BY 1) WHERE citations IS NOT NULL")
def top_sources(s, d):
    return first(s, d, "research_findings", sources=M.sources_list(F.col("citations"), 5)).where("sources IS NOT NULL")


@query("SELECT doc_id, md5(CASE WHEN contains(text, '2.0') THEN regexp_replace(text, '2\\.0', '3.0 最终版') WHEN contains(text, '1.0') THEN regexp_replace(text, '1\\.0', '3.0 最终版') WHEN contains(text, '补充完整版') THEN regexp_replace(text, '补充完整版', '3.0 最终版') ELSE text END) final_md5, md5(regexp_replace(text, '3\\.0[ \\t\\n]*最终版|研究报告[ \\t\\n]*3\\.0|报告[ \\t\\n]*3\\.0', '4.0（含引用）')) cited_md5 FROM documents WHERE text IS NOT NULL")
def version_labels(s, d):
    t = F.col("text")
    return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.md5(M.final_header(t)).alias("final_md5"), F.md5(M.cited_label(t)).alias("cited_md5"))


@query("SELECT doc_id, coalesce(TRY_CAST(regexp_extract(title, '\\d+', 0) AS INT), 7) n FROM documents")
def ints_or(s, d):
    return table(s, d, "documents").select("doc_id", M.int_or(F.regexp_extract("title", r"\d+", 0), 7).alias("n"))


@query("SELECT doc_id, CAST(w - 1 AS INT) AS window, CAST(st AS INT) AS start, md5(substr(text, st + 1, 400)) part_md5 FROM (SELECT doc_id, text, unnest(s) st, generate_subscripts(s, 1) w FROM (SELECT doc_id, text, CASE WHEN length(text) <= 400 AND doc_id % 8 + 1 <= 4 THEN [0::BIGINT] WHEN doc_id % 8 + 1 > 4 THEN list_transform(generate_series(0, doc_id % 8), lambda j: least(j * 200, greatest(0, length(text) - 400))) ELSE generate_series(0, greatest(length(text) - 1, 0), 400) END s FROM documents WHERE length(text) > 0))")
def section_windows(s, d):
    x = table(s, d, "documents").select("doc_id", "text", (F.col("doc_id") % 8 + 1).alias("n"))
    return reports.section_windows(x, "doc_id", "text", "n", 400).select("doc_id", "window", "start", F.md5("part").alias("part_md5"))


@query(f"SELECT crawl_id, min(pos) pos, segment FROM (SELECT crawl_id, CAST(i - 1 AS INT) pos, {_STRIP('l')} segment FROM (SELECT crawl_id, unnest(string_split(text, chr(10))) l, generate_subscripts(string_split(text, chr(10)), 1) i FROM (SELECT crawl_id, any_value(text) AS text FROM crawl_results GROUP BY 1) WHERE text IS NOT NULL)) WHERE length(segment) > 2 GROUP BY crawl_id, segment")
def page_segments(s, d):
    null = F.lit(None).cast("string")
    part = lambda x: F.array(F.struct(F.lit("text").alias("type"), x.alias("value"), null.alias("src"), null.alias("alt"), null.alias("latex"), F.lit(False).alias("display")))
    pages = first(s, d, "crawl_results", parts=F.transform(F.split("text", "\n", -1), part))
    return assembly.page_segments(pages, "crawl_id", "parts")


@query("SELECT crawl_id, list_transform(generate_series(1, len(images)), lambda i: 'img_' || printf('%03d', st + i) || regexp_extract(images[i].filename, '(\\.[^./]*)?$', 0)) names FROM (SELECT *, CAST(sum(len(images)) OVER (ORDER BY crawl_id) - len(images) AS BIGINT) st FROM (SELECT crawl_id, any_value(images) images FROM crawl_results GROUP BY 1) WHERE len(images) > 0)")
def image_names(s, d):
    x = first(s, d, "crawl_results", text=F.col("text"), images=F.col("images")).where("size(images) > 0")
    return assembly.remapped_images(x, "crawl_id", "text", "images").select("crawl_id", F.transform("images", lambda i: i["filename"]).alias("names"))


@query(f"SELECT file_id, substr(arg_max(p, (length(p), -para_ord)), 1, 500) para FROM (SELECT file_id, para_ord, {_STRIP('para')} p FROM {_PARAS}) WHERE length(p) > 100 GROUP BY 1")
def longest_paragraphs(s, d):
    return assembly.longest_paragraph(corpus.paragraphs(docs(s, d)), "file_id")


@query(f"SELECT id, CAST(len(list_filter(list_distinct(a), lambda x: list_contains(b, x))) AS INT) n_retained, CAST(len(list_filter(list_distinct(a), lambda x: NOT list_contains(b, x))) AS INT) n_lost, CAST(len(list_filter(list_distinct(b), lambda x: NOT list_contains(a, x))) AS INT) n_added FROM (SELECT coalesce(x.id, y.id) id, coalesce(a, []) a, coalesce(b, []) b FROM (SELECT file_id id, string_split(coalesce(description, ''), ' ') a FROM {_DOCS}) x FULL JOIN (SELECT doc_id id, string_split(coalesce(title, ''), ' ') b FROM documents) y ON x.id = y.id)")
def claim_drift(s, d):
    before = first(s, d, "corpus_docs", claims=F.split(F.coalesce("description", F.lit("")), " ", -1)).withColumnRenamed("file_id", "id")
    after = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.split(F.coalesce("title", F.lit("")), " ", -1).alias("claims"))
    return assembly.drift(before, after, "id").select("id", "n_retained", "n_lost", "n_added")


@query("SELECT min(value) least, max(value) most, round(avg(value), 6) mean FROM events")
def score_ranges(s, d):
    return assembly.score_range(table(s, d, "events"), "value")


@query("SELECT doc_id, coalesce(title, '') || chr(10) || chr(10) || repeat('=', 60) || chr(10) || chr(10) || coalesce(category, '') AS text FROM documents")
def both_modes(s, d):
    return table(s, d, "documents").select("doc_id", assembly.both_modes(F.coalesce("title", F.lit("")), F.coalesce("category", F.lit(""))).alias("text"))


@query("SELECT finding_id AS id, answer AS problem FROM " + _FOUND + " WHERE contains(answer, '❌') UNION ALL SELECT result_id, content FROM (SELECT result_id, any_value(content) content FROM search_results GROUP BY 1) WHERE regexp_matches(content, '幻觉|编造')")
def invented_problems(s, d):
    checked = first(s, d, "research_findings", problem=F.when(F.col("answer").contains("❌"), F.col("answer"))).where("problem IS NOT NULL").withColumnRenamed("finding_id", "id")
    said = first(s, d, "search_results", problem=F.col("content")).withColumnRenamed("result_id", "id")
    return assembly.invented(checked, said, "id")


@query(f"SELECT label, label_ord, CAST(r AS INT) AS rank, name, mentions FROM (SELECT 'ORG' AS label, 1 AS label_ord, name, mentions, row_number() OVER (ORDER BY mentions DESC, name) r FROM (SELECT name, count(*) mentions FROM {_MENT} GROUP BY 1)) WHERE r <= 30")
def label_tops(s, d):
    return knowledge.label_top(graph.entity_counts(_mentions(s, d))).select("label", "label_ord", "rank", "name", "mentions")


@query("SELECT base, list(provider ORDER BY f, provider) steps, any_value(h) config_hash FROM (SELECT base, provider, min(ts) f, first(h) h FROM (SELECT base, lower(trim(provider)) provider, ts, arg_max(coalesce(model, ''), (ts, log_id)) OVER (PARTITION BY base) h FROM usage_log WHERE provider IS NOT NULL) GROUP BY base, provider) GROUP BY base")
def progress_state(s, d):
    log = table(s, d, "usage_log").where("provider IS NOT NULL").select("base", F.lower(F.trim("provider")).alias("step"), F.coalesce("model", F.lit("")).alias("config_hash"), "ts", F.col("log_id").alias("seq"))
    return state.progress(log).select("base", "steps", "config_hash")


@query(f"SELECT file_id, coalesce(try_strptime(p, '%Y-%m-%d'), try_strptime(p, '%Y-%m-%dT%H:%M:%S'), try_strptime(p, '%B %d, %Y'), try_strptime(p, '%d %B %Y')) AS at FROM (SELECT file_id, {_STRIP('published')} p FROM {_DOCS})")
def published_dates(s, d):
    return first(s, d, "corpus_docs", at=T.published_date(F.col("published")).cast("timestamp_ntz"))


@query("SELECT doc_id, CAST(length(text) - length(regexp_replace(text, '[\\x{2200}-\\x{22FF}\\x{1D400}-\\x{1D7FF}\\x{2070}-\\x{209F}]', '', 'g')) AS INT) n FROM documents WHERE text IS NOT NULL")
def math_counts(s, d):
    return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", T.math_count(F.col("text")).alias("n"))


@query(f"SELECT crawl_id, md5(array_to_string(list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: {_STRIP('x')}), lambda x: x <> ''), chr(10) || chr(10))) text_md5 FROM (SELECT crawl_id, any_value(text) AS text FROM crawl_results GROUP BY 1) WHERE text IS NOT NULL")
def normalised_lines(s, d):
    return first(s, d, "crawl_results", text_md5=F.md5(T.lines_normalised(F.col("text")))).where("text_md5 IS NOT NULL")


def _found(s, d):
    from papyra.operators.common import stored

    return stored(knowledge.recognised(first(s, d, "corpus_docs", body=F.col("body")), knowledge.by_patterns()), "mentions")


@query()
def entity_details(s, d):
    """Entities of the pattern recogniser with counts, documents and first contexts."""
    return knowledge.entities(_found(s, d))


@query()
def entities_merged(s, d):
    """Entities with their aliases folded in."""
    m = _found(s, d).where("name IS NOT NULL")
    return knowledge.merged(graph.entity_counts(m.select("doc", "pos", "name", "label")), m)


@query()
def relations_found(s, d):
    return graph.relation_counts(_found(s, d).where("subject IS NOT NULL").select("subject", "predicate", "object"))


@query()
def formulas_converted(s, d):
    from papyra.functions.mathtext import with_latex

    return first(s, d, "crawl_results", m=with_latex(F.col("text"))).select("crawl_id", F.md5("m.text").alias("text_md5"), "m.formulas")


@query()
def expert_opinions(s, d):
    """Opinions of every role on every document's text by the stub client."""
    from papyra.operators import external, steps

    return steps.experts(table(s, d, "documents"), "doc_id", "text", {"facts": "Check facts.", "style": "Judge the style."}, external.stub)[0]
