"""Queries of the core operators over whole tables, by name, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.functions import text as T
from papyra.operators import cluster, corpus, external, firstkept, graph, rank, reports
from papyra.operators.common import table
from papyra.operators.timestamps import normalise_timestamps

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query, and its SQL where there is one."""

    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def docs(s: SparkSession, d: str) -> DataFrame:
    """Whole rows of corpus_docs, each file once."""
    return corpus.once(table(s, d, "corpus_docs"), "file_id", ARRIVED["corpus_docs"][1])


#: Key and arrival of the record tables.
ARRIVED = {"corpus_docs": ("file_id", "ingested_at"), "research_findings": ("finding_id", "created_at"), "search_results": ("result_id", "fetched_at"), "crawl_results": ("crawl_id", "crawled_at"), "extraction_results": ("extract_id", "extracted_at")}


def first(s: SparkSession, d: str, name: str, **columns) -> DataFrame:
    """Columns of the earliest delivery of each record; only they are shuffled."""
    return corpus.first_delivery(table(s, d, name), *ARRIVED[name], **columns)


#: White space of Unicode, as a class that RE2 knows.
_WS = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_DOCS = "(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY ingested_at) rn FROM corpus_docs) WHERE rn = 1)"
_FOUND = "(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY created_at) rn FROM research_findings) WHERE rn = 1)"
_STATUS = "(SELECT f filename, arg_max(st, line_id) status FROM (SELECT trim(filename) f, lower(trim(status)) st, line_id FROM file_index WHERE status IS NOT NULL OR true) GROUP BY f)"


@query()
def p4_timestamps(s, d):
    return normalise_timestamps(table(s, d, "corpus_docs"), table(s, d, "source_zones"), table(s, d, "zone_abbrevs"))


@query()
def p4_found(s, d):
    return p4_timestamps(s, d).select("file_id", "utc")


@query(f"SELECT file_id, CAST(length(coalesce(body, '')) AS INT) raw_len, md5(coalesce(body, '')) raw_md5 FROM {_DOCS}")
def doc_fields(s, d):
    body = F.coalesce("body", F.lit(""))
    return first(s, d, "corpus_docs", raw_len=F.length(body), raw_md5=F.md5(body))


@query(f"SELECT CASE WHEN md5 IS NULL OR md5 = '' THEN 'missing' WHEN md5 = md5(coalesce(body, '')) THEN 'equal' WHEN lower(md5) = md5(coalesce(body, '')) THEN 'case' ELSE 'stale' END state, count(*) n FROM {_DOCS} GROUP BY 1")
def md5_states(s, d):
    m = F.md5(F.coalesce("body", F.lit("")))
    state = F.when(F.coalesce("md5", F.lit("")) == "", "missing").when(F.col("md5") == m, "equal").when(F.lower("md5") == m, "case").otherwise("stale")
    return first(s, d, "corpus_docs", state=state).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT file_id, CAST(length(body) AS INT) raw_len FROM {_DOCS} WHERE length(body) >= 500")
def filter_short(s, d):
    return first(s, d, "corpus_docs", raw_len=F.length(F.coalesce("body", F.lit("")))).where("raw_len >= 500")


@query("SELECT trim(filename) filename, lower(trim(arg_max(coalesce(status, '\x01'), line_id))) status FROM file_index WHERE filename IS NOT NULL GROUP BY trim(filename)".replace("lower(trim(arg_max(coalesce(status, '\x01'), line_id)))", "nullif(lower(trim(arg_max(coalesce(status, '<null>'), line_id))), '<null>')"))
def status_index(s, d):
    return corpus.last_status(table(s, d, "file_index").where("filename IS NOT NULL"))


@query(f"SELECT c.file_id FROM {_DOCS} c LEFT JOIN (SELECT trim(filename) f, arg_max(coalesce(lower(trim(status)), 'ok'), line_id) st FROM file_index GROUP BY 1) i ON c.filename = i.f WHERE coalesce(st, 'ok') IN ('ok', '')")
def status_join(s, d):
    return corpus.filter_status(first(s, d, "corpus_docs", filename=F.col("filename")), table(s, d, "file_index")).select("file_id")


@query(f"""SELECT file_id, coalesce(nullif(concat_ws(' ', nullif(source, ''), nullif(regexp_replace(regexp_replace(published, 'T\\d{{2}}:\\d{{2}}:\\d{{2}}[+\\-]\\d{{2}}:\\d{{2}}', '', 'g'), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'), '')), ''), filename) AS label FROM {_DOCS}""")
def source_labels(s, d):
    return first(s, d, "corpus_docs", label=T.source_label(F.col("source"), F.col("published"), F.col("filename")))


def _re2(pattern: str) -> str:
    """A clean-up pattern in RE2's terms: white space and word characters as Unicode classes."""
    blank, out, inside = _WS[1:-1], "", False
    i = 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out += blank if inside else _WS
        elif two == r"\S":
            out += "[^" + blank + "]"
        elif two == r"\w":
            out += r"[\p{L}\p{N}_]"
        elif two == r"\d":
            out += r"\d"
        elif two[0] == "\\":
            out += two
        else:
            inside = inside or two[0] == "["
            inside = inside and two[0] != "]"
            out += two[0]
            i -= 1
        i += 2
    return out.replace("'", "''")


def _cleaned(column: str) -> str:
    for p in [*("(?i)" + _re2(x) for x in T.BOILERPLATE)]:
        column = f"regexp_replace({column}, '{p}', '', 'g')"
    return f"regexp_replace(regexp_replace(regexp_replace({column}, '\\n{{4,}}', chr(10) || chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^{_WS}+|{_WS}+$', '', 'g')"


@query(f"SELECT file_id, md5(t) clean_md5, CAST(length(t) AS INT) clean_len FROM (SELECT file_id, {_cleaned('body')} t FROM {_DOCS})")
def boilerplate(s, d):
    x = table(s, d, "corpus_docs").select("file_id", "ingested_at", T.remove_boilerplate(F.col("body")).alias("t"))
    return corpus.first_delivery(x, "file_id", "ingested_at", clean_md5=F.md5("t"), clean_len=F.length("t"))


@query(f"SELECT file_id FROM (SELECT file_id, row_number() OVER (PARTITION BY md5(coalesce(body, '')) ORDER BY filepath NULLS FIRST, file_id) r FROM {_DOCS}) WHERE r = 1")
def exact_dedup(s, d):
    x = first(s, d, "corpus_docs", filepath=F.col("filepath"), raw_md5=F.md5(F.coalesce("body", F.lit(""))))
    return corpus.dedup_exact(x).select("file_id")


@query(f"SELECT md5(coalesce(body, '')) raw_md5, count(*) copies, min(file_id) first_id FROM {_DOCS} GROUP BY 1 HAVING count(*) > 1")
def exact_groups(s, d):
    return first(s, d, "corpus_docs", raw_md5=F.md5(F.coalesce("body", F.lit("")))).groupBy("raw_md5").agg(F.count(F.lit(1)).alias("copies"), F.min("file_id").alias("first_id")).where("copies > 1")


@query()
def near_dedup(s, d):
    return firstkept.kept_first(docs(s, d).where("length(body) >= 500"))


_PARAS = f"(SELECT file_id, unnest(p) para, generate_subscripts(p, 1) - 1 para_ord FROM (SELECT file_id, regexp_split_to_array(body, '\\n[ \\t\\n\\f\\r]*\\n') p FROM {_DOCS} WHERE body IS NOT NULL))"


@query(f"""WITH p AS (SELECT *, CASE WHEN length(trim(para)) >= 100 THEN md5(trim(para)) END fp FROM {_PARAS}), dup AS (SELECT fp, min(file_id * 1000000 + para_ord) f FROM p WHERE fp IS NOT NULL GROUP BY fp HAVING count(DISTINCT file_id) > 1)
SELECT c.file_id, md5(coalesce(string_agg(para, chr(10) || chr(10) ORDER BY para_ord), '')) body_md5 FROM {_DOCS} c LEFT JOIN (SELECT p.* FROM p LEFT JOIN dup USING (fp) WHERE f IS NULL OR file_id * 1000000 + para_ord = f) k ON c.file_id = k.file_id GROUP BY c.file_id""")
def paragraph_dedup(s, d):
    return corpus.dedup_paragraphs(docs(s, d)).select("file_id", F.md5("body").alias("body_md5"))


@query(f"SELECT file_id, len(list_distinct(list_transform(generate_series(1, len(s) - 4), lambda i: s[i] || s[i + 1] || s[i + 2] || s[i + 3] || s[i + 4]))) n_shingles FROM (SELECT file_id, string_split(lower(regexp_replace(trim(body), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), '') s FROM {_DOCS} WHERE body IS NOT NULL) WHERE len(s) >= 5")
def shingle_counts(s, d):
    return docs(s, d).where("body IS NOT NULL").where(F.length(F.regexp_replace(F.trim("body"), r"\s+", " ")) >= 5).select("file_id", F.size(T.shingles(F.col("body"))).cast("long").alias("n_shingles"))


_TOK = "unnest(regexp_extract_all(lower(body), '[\\p{L}\\p{N}_]{2,}'))"


@query(f"SELECT file_id, count(*) n_tokens, count(DISTINCT t) n_distinct FROM (SELECT file_id, {_TOK} t FROM {_DOCS}) GROUP BY 1")
def token_counts(s, d):
    t = docs(s, d).select("file_id", F.explode(T.tokens(F.col("body"))).alias("t"))
    return t.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.countDistinct("t").alias("n_distinct"))


_TF = f"(SELECT file_id, term, count(*) tf FROM (SELECT file_id, {_TOK} term FROM {_DOCS}) WHERE term NOT IN ({', '.join(repr(w) for w in rank.STOP)}) GROUP BY 1, 2)"


@query(f"SELECT term, count(*) df, CAST(sum(tf) AS BIGINT) total FROM {_TF} GROUP BY 1 HAVING count(*) >= 2")
def term_df(s, d):
    return rank.term_counts(docs(s, d), "file_id", "body").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).where("df >= 2")


_VOC = f"(SELECT term, count(*) df, CAST(sum(tf) AS BIGINT) total FROM {_TF} GROUP BY 1 HAVING count(*) >= 2 AND count(*) <= 0.95 * (SELECT count(*) FROM {_DOCS}) ORDER BY total DESC, term LIMIT 10000)"


@query(f"SELECT * FROM {_VOC}")
def vocabulary_top(s, d):
    x = docs(s, d)
    return rank.vocabulary(rank.term_counts(x, "file_id", "body"), x.count())


_REL = f"""WITH n AS (SELECT count(*) n FROM {_DOCS}), w AS (SELECT file_id, term, tf * (ln((1.0 + n) / (1.0 + df)) + 1.0) w FROM {_TF} JOIN {_VOC} USING (term), n),
u AS (SELECT file_id, term, w / norm u FROM w JOIN (SELECT file_id, sqrt(sum(w * w)) norm FROM w GROUP BY 1) USING (file_id)), c AS (SELECT term, sum(u) / max(n) c FROM u, n GROUP BY 1),
r AS (SELECT file_id, sum(u * c) / (SELECT sqrt(sum(c * c)) FROM c) score FROM u JOIN c USING (term) GROUP BY 1), s AS (SELECT d.file_id, d.source, round(coalesce(score, 0.0), 6) score FROM {_DOCS} d LEFT JOIN r USING (file_id))"""


@query(f"{_REL} SELECT file_id, score FROM s")
def relevance(s, d):
    return rank.relevance(docs(s, d))


@query(f"{_REL} SELECT source, CAST(r AS INT) AS rank, file_id, score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, file_id) r FROM s) WHERE r <= 3")
def relevance_top(s, d):
    x = docs(s, d)
    scored = rank.relevance(x).join(x.select("file_id", "source"), "file_id")
    return corpus.group_top(scored, "source", [F.desc("score"), F.col("file_id")], 3).select("source", "rank", "file_id", "score")


@query(f"SELECT file_id, CAST(len(list_filter(list_transform(string_split(regexp_replace(coalesce(body, ''), '([.!?。！？]){_WS}+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')), lambda x: length(x) > 20)) AS INT) n_sentences FROM {_DOCS}")
def sentence_counts(s, d):
    return first(s, d, "corpus_docs", n_sentences=F.size(T.sentences(F.coalesce("body", F.lit("")))))


@query()
def text_summaries(s, d):
    return rank.summaries(docs(s, d), "file_id", "body")


@query()
def text_clusters(s, d):
    return cluster.clusters(docs(s, d), "file_id", "body")


@query(f"SELECT crawl_id, md5(trim(regexp_replace(regexp_replace(concat('<p>', replace(text, chr(10), '</p><p>'), '</p>'), '<[^>]+>', ' ', 'g'), '{_WS}+', ' ', 'g'), ' ')) text_md5 FROM (SELECT crawl_id, any_value(text) AS text FROM crawl_results GROUP BY 1) WHERE text IS NOT NULL")
def html_import(s, d):
    page = F.concat(F.lit("<p>"), F.replace("text", F.lit("\n"), F.lit("</p><p>")), F.lit("</p>"))
    return first(s, d, "crawl_results", text_md5=F.md5(T.html_text(page))).where("text_md5 IS NOT NULL")


@query("SELECT crawl_id, platform, concat_ws('_', platform, coalesce(nullif(substr(regexp_extract(url, 'share/([a-zA-Z0-9_-]+)', 1), 1, 30), ''), nullif(substr(regexp_extract(url, '([a-zA-Z0-9]{10,})', 1), 1, 30), ''), 'import')) slug FROM (SELECT crawl_id, any_value(url) url, CASE WHEN NOT regexp_matches(trim(any_value(url)), '^https?://') THEN 'file' WHEN regexp_matches(lower(any_value(url)), 'chatgpt\\.com|chat\\.openai\\.com') THEN 'chatgpt' WHEN regexp_matches(lower(any_value(url)), 'gemini\\.google\\.com|g\\.co/gemini') THEN 'gemini' WHEN regexp_matches(lower(any_value(url)), 'perplexity\\.ai') THEN 'perplexity' ELSE 'generic' END platform FROM crawl_results WHERE url IS NOT NULL GROUP BY 1)")
def url_slugs(s, d):
    p = T.detect_source(F.col("url"))
    return first(s, d, "crawl_results", platform=p, slug=T.slug(F.col("url"), p), url=F.col("url")).where("url IS NOT NULL").drop("url")


@query(f"SELECT finding_id, concat_ws(chr(10) || chr(10), CASE WHEN trim(coalesce(question, ''), ' ') <> '' THEN '用户：' || trim(question, ' ') END, CASE WHEN trim(coalesce(answer, ''), ' ') <> '' THEN '助手：' || trim(answer, ' ') END) transcript FROM {_FOUND} WHERE trim(coalesce(question, ''), ' ') <> '' OR trim(coalesce(answer, ''), ' ') <> ''")
def transcripts(s, d):
    f = first(s, d, "research_findings", question=F.col("question"), answer=F.col("answer"))
    turns = f.select("finding_id", F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.lit("user").alias("role"), F.col("question").alias("text")), F.struct(F.lit(1).alias("turn"), F.lit("assistant").alias("role"), F.col("answer").alias("text")))).alias("t")).select("finding_id", "t.*")
    return reports.transcript(turns, "finding_id", "turn", "role", "text")


@query("WITH e AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 1 ELSE 0 END ch FROM events), i AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY event_id) island FROM e) SELECT user_id, CAST(island AS BIGINT) island, any_value(event_type) event_type, count(*) parts, string_agg(CAST(event_id AS VARCHAR), '+' ORDER BY event_id) body FROM i GROUP BY user_id, island")
def merge_adjacent(s, d):
    e = table(s, d, "events").select("user_id", "event_id", "event_type", F.col("event_id").cast("string").alias("part"))
    return reports.merge_adjacent(e, "user_id", "event_id", "event_type", "part", "+")


@query("SELECT doc_id, CAST(i AS INT) chunk_ord, md5(substr(text, CAST(i * 1000 + 1 AS BIGINT), 1000)) chunk_md5 FROM (SELECT doc_id, text, unnest(generate_series(0, (length(text) - 1) // 1000)) i FROM documents WHERE length(text) > 0)")
def text_chunks(s, d):
    return reports.chunks(table(s, d, "documents"), "doc_id", "text", 1000).select("doc_id", "chunk_ord", F.md5("chunk").alias("chunk_md5"))


@query("SELECT doc_id, CAST(i AS INT) i, md5(substr(text, (i * length(text)) // 4 + 1, ((i + 1) * length(text)) // 4 - (i * length(text)) // 4)) part_md5 FROM documents, (SELECT unnest([0, 1, 2, 3]) i) WHERE text IS NOT NULL")
def proportional_slices(s, d):
    return reports.slices(table(s, d, "documents").where("text IS NOT NULL"), "doc_id", "text", 4).select("doc_id", "i", F.md5("part").alias("part_md5"))


@query("SELECT l_orderkey, l_linenumber, CAST(greatest(2000, floor(greatest(16000, floor(l_extendedprice * 0.6)) * l_quantity / avg(l_quantity) OVER (PARTITION BY l_orderkey) / count(*) OVER (PARTITION BY l_orderkey))) AS BIGINT) target FROM lineitem")
def density_targets(s, d):
    return reports.density_targets(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"), "l_orderkey", "l_quantity", "l_extendedprice").select("l_orderkey", "l_linenumber", "target")


@query("SELECT doc_id, CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || chr(10) || chr(10) || '[truncated]' ELSE text END AS text FROM documents")
def truncated(s, d):
    return table(s, d, "documents").select("doc_id", T.truncate_notice(F.col("text"), 300).alias("text"))


@query("WITH u AS (SELECT DISTINCT ON (log_id) coalesce(lower(trim(provider)), '') provider, input_tokens, output_tokens FROM usage_log) SELECT provider, count(*) calls, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) input_tokens, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) output_tokens FROM u GROUP BY ROLLUP (provider)")
def token_usage(s, d):
    return reports.token_usage(table(s, d, "usage_log"))


@query("SELECT user_id, CAST(coalesce(floor(avg(CASE WHEN v >= 0 THEN v END)), -1) AS INT) overall, coalesce(min(v) >= 60, false) AND coalesce(floor(avg(CASE WHEN v >= 0 THEN v END)), -1) >= 70 AS passed FROM (SELECT user_id, CAST(floor(value) AS INT) v FROM events) GROUP BY 1")
def score_gate(s, d):
    return reports.score_gate(table(s, d, "events").select("user_id", F.floor("value").cast("int").alias("v")), "user_id", "v")


@query("SELECT user_id, pos, event_id FROM (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, event_id) AS INT) pos FROM events) WHERE pos <= 10")
def issue_top(s, d):
    e = table(s, d, "events").withColumn("sev", F.when(F.col("event_type") == "purchase", "高").when(F.col("event_type") == "click", "中").otherwise("低"))
    return reports.issue_topk(e, "user_id", "sev", "event_id").select("user_id", "pos", "event_id")


@query("SELECT finding_id, url, CAST(pos AS INT) pos FROM (SELECT finding_id, c.url url, min(pos) pos FROM (SELECT finding_id, unnest(citations) c, generate_subscripts(citations, 1) - 1 pos FROM (SELECT finding_id, any_value(citations) citations FROM research_findings GROUP BY 1)) WHERE trim(coalesce(c.url, '')) <> '' GROUP BY 1, 2)")
def citation_dedup(s, d):
    return reports.citations(first(s, d, "research_findings", citations=F.col("citations")), "finding_id", "citations").select("finding_id", "url", "pos")


@query("SELECT finding_id, CASE WHEN len(citations) > 0 THEN '## References' || chr(10) || chr(10) || array_to_string(list_transform(citations, lambda x, i: '[' || i || '] ' || coalesce(x.title, x.url, '') || '. ' || coalesce(x.url, '')), chr(10)) ELSE NULL END refs FROM (SELECT finding_id, any_value(citations) citations FROM research_findings GROUP BY 1) WHERE len(citations) > 0")
def reference_lists(s, d):
    return first(s, d, "research_findings", refs=F.when(F.size("citations") > 0, T.references(F.col("citations")))).where("refs IS NOT NULL")


@query(f"SELECT finding_id, md5(regexp_replace(answer, '{_WS}*\\[\\d+\\]', '', 'g')) stripped_md5, md5(replace(replace(answer, '[1]', '[1 待验证]'), '[3]', '[3 待验证]')) marked_md5 FROM {_FOUND} WHERE answer IS NOT NULL")
def citation_marks(s, d):
    a = F.col("answer")
    return first(s, d, "research_findings", stripped_md5=F.md5(T.strip_citations(a)), marked_md5=F.md5(T.mark_unverified(a, [1, 3]))).where("stripped_md5 IS NOT NULL")


@query(f"SELECT category, CAST(row_number() OVER (PARTITION BY category ORDER BY n, md5(t)) - 1 AS BIGINT) ord, md5(t) text_md5 FROM (SELECT category, coalesce(filename, '') n, '--- 来自文件: ' || coalesce(filename, '') || ' ---' || chr(10) || chr(10) || coalesce(body, '') t FROM {_DOCS})")
def corpus_by_category(s, d):
    return corpus.corpus_parts(docs(s, d), "category", "filename", "body").select("category", "ord", F.md5("text").alias("text_md5"))


@query(f"SELECT count(*) documents, CAST(sum(length(body)) AS BIGINT) chars_in, CAST(sum(length(trim(body))) AS BIGINT) chars_out, round((1 - sum(length(trim(body))) / sum(length(body))) * 100, 4) compression_pct FROM {_DOCS}")
def corpus_stats(s, d):
    return corpus.stats(docs(s, d).withColumn("t", F.trim("body")), "body", "t")


@query("SELECT provider, models, only_first FROM (SELECT lower(trim(provider)) provider, list_sort(list_distinct(list(model))) models, CAST(count(DISTINCT base) AS BIGINT) only_first FROM usage_log WHERE provider IS NOT NULL AND model IS NOT NULL GROUP BY 1)")
def set_unions(s, d):
    u = table(s, d, "usage_log").where("provider IS NOT NULL AND model IS NOT NULL")
    return u.groupBy(F.lower(F.trim("provider")).alias("provider")).agg(F.sort_array(F.collect_set("model")).alias("models"), F.countDistinct("base").alias("only_first"))


@query("SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) k_sum, count(*) n FROM events GROUP BY 1")
def json_props(s, d):
    k = F.from_json("props", "k long")["k"]
    return table(s, d, "events").groupBy("event_type").agg(F.sum(k).alias("k_sum"), F.count(F.lit(1)).alias("n"))


@query(f"SELECT finding_id, contains(answer, '❌') crossed, regexp_matches(answer, '幻觉|编造') invented, regexp_matches(answer, '遗漏|缺失') missing_part, contains(answer, '无需补注') no_note, contains(answer, '覆盖充分') covered, contains(answer, '%') percent FROM {_FOUND} WHERE answer IS NOT NULL")
def keyword_flags(s, d):
    a = F.col("answer")
    flags = T.keyword_flags(a)
    return first(s, d, "research_findings", **flags, percent=a.contains("%")).where("crossed IS NOT NULL")


@query("SELECT model, substr(md5(concat_ws('|', coalesce(provider, ''), coalesce(model, ''))), 1, 12) config_hash, count(*) n FROM usage_log GROUP BY provider, model")
def config_hashes(s, d):
    u = table(s, d, "usage_log").groupBy("provider", "model").agg(F.count(F.lit(1)).alias("n"))
    return u.select("model", T.config_hash(F.col("provider"), F.col("model")).alias("config_hash"), "n")


@query("SELECT doc_id, CAST(floor(length(text) * 0.9) AS BIGINT) target, CAST(floor(length(text) * 0.8) AS BIGINT) AS floor, CAST(least(16384, greatest(4096, floor(floor(length(text) * 0.9) * 1.5))) AS BIGINT) budget FROM documents WHERE text IS NOT NULL")
def compression_targets(s, d):
    return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", *[c.cast("long").alias(k) for k, c in reports.compression_targets(F.length("text")).items()])


@query("SELECT kind, count(*) n FROM (SELECT CASE WHEN l = '' THEN 'blank' WHEN regexp_matches(l, '^#{1,6}\\s+') THEN 'heading' WHEN regexp_matches(l, '^(-{3,}|\\*{3,}|_{3,})$') THEN 'rule' WHEN starts_with(l, '```') THEN 'fence' WHEN regexp_matches(l, '^\\[\\^[^\\]]+\\]:') THEN 'footnote' WHEN regexp_matches(l, '^!\\[[^\\]]*\\]\\([^)]+\\)$') THEN 'image' WHEN regexp_matches(l, '^\\$\\$(.+\\$\\$)?$|^\\\\\\[(.+\\\\\\])?$|^\\\\\\]$') THEN 'math' WHEN regexp_matches(l, '^\\|.*\\|$') THEN 'table' WHEN regexp_matches(l, '^[-*+]\\s+') THEN 'bullet' WHEN regexp_matches(l, '^\\d+\\.\\s+') THEN 'numbered' WHEN starts_with(l, '>') THEN 'quote' ELSE 'text' END kind FROM (SELECT trim(unnest(string_split(text, chr(10))), ' ') l FROM documents WHERE text IS NOT NULL)) GROUP BY 1")
def block_kinds(s, d):
    lines = table(s, d, "documents").where("text IS NOT NULL").select(F.explode(F.split("text", "\n")).alias("l"))
    return lines.groupBy(T.block_kind(F.col("l")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, replace(replace(replace(replace(coalesce(title, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') title FROM documents")
def escaped_titles(s, d):
    return table(s, d, "documents").select("doc_id", T.xml_escape(F.coalesce("title", F.lit(""))).alias("title"))


@query("SELECT crawl_id, CAST(pos AS INT) pos, CAST(row_number() OVER (ORDER BY crawl_id, pos) AS BIGINT) img_no, i.url url FROM (SELECT crawl_id, unnest(images) i, generate_subscripts(images, 1) - 1 pos FROM (SELECT crawl_id, any_value(images) images FROM crawl_results GROUP BY 1))")
def image_numbers(s, d):
    return reports.number_images(first(s, d, "crawl_results", images=F.col("images")), "crawl_id", "images")


@query("SELECT '.' || coalesce(nullif(regexp_extract(lower(coalesce(i.url, '')), '\\.(png|jpe?g|gif|webp|svg|bmp)(?:[?#].*)?$', 1), ''), 'png') ext, count(*) n FROM (SELECT unnest(images) i FROM (SELECT any_value(images) images FROM crawl_results GROUP BY crawl_id)) GROUP BY 1")
def image_types(s, d):
    t = first(s, d, "crawl_results", images=F.col("images")).select(F.explode("images").alias("i"))
    return t.groupBy(T.image_ext(F.coalesce("i.url", F.lit(""))).alias("ext")).agg(F.count(F.lit(1)).alias("n"))


def _mentions(s, d):
    """Capitalised two-word names as entity mentions (dictionary-free stand-in for a recogniser)."""
    m = docs(s, d).select(F.col("file_id").alias("doc"), F.posexplode(F.regexp_extract_all("body", F.lit("[A-Z][a-z]+ (?:Institute|Council|Energy|Holdings|Grid|Partners|Works|Observatory)"), F.lit(0))).alias("pos", "name"))
    return m.withColumn("label", F.lit("ORG"))


_MENT = f"(SELECT file_id doc, unnest(m) AS name, generate_subscripts(m, 1) - 1 pos FROM (SELECT file_id, regexp_extract_all(body, '[A-Z][a-z]+ (?:Institute|Council|Energy|Holdings|Grid|Partners|Works|Observatory)') m FROM {_DOCS} WHERE body IS NOT NULL))"


@query(f"SELECT name, 'ORG' AS label, count(*) mentions, count(DISTINCT doc) docs FROM {_MENT} GROUP BY 1")
def entity_counts(s, d):
    return graph.entity_counts(_mentions(s, d))


@query()
def entity_aliases(s, d):
    return graph.resolve(entity_counts(s, d))


@query(f"SELECT a.name subject, 'with' AS predicate, b.name AS object, count(*) n FROM {_MENT} a JOIN {_MENT} b ON a.doc = b.doc AND b.pos = a.pos + 1 GROUP BY 1, 3 ORDER BY n DESC, subject, object LIMIT 100")
def relation_counts(s, d):
    from pyspark.sql import Window

    m = _mentions(s, d)
    pair = m.withColumn("object", F.lead("name").over(Window.partitionBy("doc").orderBy("pos"))).where("object IS NOT NULL")
    return graph.relation_counts(pair.select(F.col("name").alias("subject"), F.lit("with").alias("predicate"), "object"))


@query(f"SELECT file_id, CAST(para_ord AS INT) para_ord, CAST(hits AS INT) hits, substr(para, 1, 500) para FROM (SELECT p.file_id, p.para_ord, any_value(para) para, count(*) hits FROM {_PARAS} p, (SELECT DISTINCT lower(name) AS name FROM (SELECT name FROM {_MENT} GROUP BY 1 ORDER BY count(*) DESC, name LIMIT 20)) t WHERE length(para) > 80 AND contains(lower(para), t.name) GROUP BY 1, 2) WHERE hits >= 2 ORDER BY hits DESC, file_id, para_ord LIMIT 50")
def evidence_paragraphs(s, d):
    top = [r.name for r in entity_counts(s, d).orderBy(F.desc("mentions"), "name").limit(20).collect()]
    return graph.evidence(corpus.paragraphs(docs(s, d)), top)


@query()
def external_answers(s, d):
    return external.answered(table(s, d, "research_findings"), "question", external.stub)


@query()
def preprocessed(s, d):
    return corpus.preprocess(docs(s, d), table(s, d, "file_index"))


@query()
def preprocessed_stats(s, d):
    out = preprocessed(s, d)
    return corpus.stats(docs(s, d).select("file_id", F.col("body").alias("before")).join(out.select("file_id", "body"), "file_id"), "before", "body")


def flagship(s: SparkSession, d: str) -> DataFrame:
    return preprocessed(s, d)


def queries() -> dict:
    from papyra.plans import report_queries  # noqa: F401  registers its queries

    return dict(Q)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
