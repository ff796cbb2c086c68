"""Core operators against brute force on small fixtures."""

import datetime as dt
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from papyra.functions import text as T
from papyra.operators import corpus, external, firstkept, graph, rank, reports
from papyra.operators.timestamps import normalise_timestamps
from papyra.sources import files

DOC = "file_id long, published string, source string, ingested_at timestamp"
AT = dt.datetime(2024, 1, 1)


def utc(spark, *rows):
    d = spark.createDataFrame([(i, t, s, AT) for i, (t, s) in enumerate(rows)], DOC)
    z = spark.createDataFrame([("A Post", "America/New_York", "MDY"), ("B Bote", "Europe/Berlin", "DMY"), ("C", "Asia/Shanghai", "YMD")], "source string, zone_name string, date_order string")
    a = spark.createDataFrame([("EST", -300), ("CEST", 120)], "abbr string, offset_min int")
    got = {r.file_id: r.utc for r in normalise_timestamps(d, z, a).collect()}
    return [got.get(i) for i in range(len(rows))]


def test_timestamp_formats(spark):
    got = utc(
        spark, ("3/4/2025", "a post "), ("3.4.2025 um 07:05 Uhr", "B BOTE"), ("2025年3月4日 下午12:19", "C"), ("1700000000", None), ("1700000000123", None), ("2024-05-05T05:49:26.998109903Z", None),
        ("May 7, 2025 12:14 pm EST", "B Bote"), ("March 2025", "A Post"), ("31/02/2024", "B Bote"), ("2 hours ago", "A Post"), (None, "A Post"), ("", None), ("2024-01-01", None), ("２０２４/１/２", "C"), ("Posted on 1er juin 2025 à 6h05", "B Bote"), ("Fri, 16 Aug 2024 02:50:23 +0800", None), ("12 am 2024", "C"),
    )
    assert got == [
        "2025-03-04T05:00:00.000000Z", "2025-04-03T05:05:00.000000Z", "2025-03-04T04:19:00.000000Z", "2023-11-14T22:13:20.000000Z", "2023-11-14T22:13:20.123000Z", "2024-05-05T05:49:26.998109Z",
        "2025-05-07T17:14:00.000000Z", None, None, None, None, None, None, "2024-01-01T16:00:00.000000Z", "2025-06-01T04:05:00.000000Z", "2024-08-15T18:50:23.000000Z", None,
    ]


def test_timestamp_time_right_after_the_day_sign(spark):
    got = utc(spark, ("2025年3月1日2时34分", "C"), ("Posted on 2024年10月05日22时57分（北京时间）", None), ("２０２４年１０月０５日２２时５７分", "C"), ("2025年3月1日", "C"), ("2025年3月1日2", "C"), ("2025-03-0112:30", "C"))
    assert got == ["2025-02-28T18:34:00.000000Z", "2024-10-05T14:57:00.000000Z", "2024-10-05T14:57:00.000000Z", "2025-02-28T16:00:00.000000Z", None, None]


@pytest.mark.parametrize("zone,source", [("America/New_York", "A Post"), ("Europe/Berlin", "B Bote")])
def test_timestamp_daylight_saving_agrees_with_zoneinfo(spark, zone, source):
    days = ["2024-03-10", "2024-03-31", "2024-10-27", "2024-11-03", "2024-07-01"]
    texts = [f"{d} {h:02d}:{m:02d}" for d in days for h in range(4) for m in (0, 30)]
    want = []
    for t in texts:  # fold 0: the first of two; in a gap the offset before the change
        local = dt.datetime.strptime(t, "%Y-%m-%d %H:%M").replace(tzinfo=ZoneInfo(zone), fold=0)
        want.append((local - local.utcoffset()).strftime("%Y-%m-%dT%H:%M:%S.000000Z"))
    assert utc(spark, *[(t, source) for t in texts]) == want


def test_timestamps_empty_table_extra_columns_and_redelivery(spark):
    assert utc(spark) == []
    d = spark.createDataFrame([(1, "2024-01-01", "C", AT, "x"), (1, "2024-01-02", "C", AT + dt.timedelta(days=1), "y"), (None, "2024-01-01", "C", AT, "z")], DOC + ", utc string")
    z = spark.createDataFrame([("C", "Asia/Shanghai", "YMD")] * 2, "source string, zone_name string, date_order string")
    rows = normalise_timestamps(d, z, spark.createDataFrame([], "abbr string, offset_min int")).collect()
    assert [(r.file_id, r.utc) for r in rows] == [(1, "2024-01-01T16:00:00.000000Z")]


def test_boilerplate_lines_go(spark):
    text = "Body one.\nWe have a cookie policy here\nSubscribe to our newsletter\nHome\n© 2024 X\nsee https://abcdefghij.example/x now\n\n\n\n\nEnd"
    got = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(T.remove_boilerplate(F.col("t"))).collect()
    assert got[0][0] == "Body one.\n\nsee  now\n\nEnd" and got[1][0] is None and got[2][0] == ""


def test_paragraph_dedup_keeps_first_and_repeats_within_one_document(spark):
    p, q = "p" * 120, "q" * 120
    d = spark.createDataFrame([(1, f"{p}\n\nshort\n\n{q}\n\n{q}"), (2, f"{p}\n\nshort\n\nnew")], "file_id long, body string")
    got = {r.file_id: r.body for r in corpus.dedup_paragraphs(d).collect()}
    assert got == {1: f"{p}\n\nshort\n\n{q}\n\n{q}", 2: "short\n\nnew"}


def test_preprocess_runs_all_stages(spark):
    body = lambda k: "\n\n".join(" ".join(f"Word{k * 31 + i * 7 + j * 3} stands in line {j} of part {i} for case {k} on topic{k % 2}." for j in range(5)) for i in range(4))
    shared = "This paragraph is printed in two documents and is much longer than one hundred characters, so that it counts as repeated."
    rows = [(1, "a", body(1) + "\n\n" + shared), (2, "b", body(2) + "\n\n" + shared), (3, "c", body(1) + "\n\n" + shared + " "), (4, "d", body(1) + "\n\n" + shared), (5, "e", body(5)), (6, "f", body(6)), (7, "g", body(7)), (8, "h", "short")]
    d = spark.createDataFrame([(i, f, f, t) for i, f, t in rows], "file_id long, filename string, filepath string, body string")
    index = spark.createDataFrame([("g", "failed", 1)], "filename string, status string, line_id long")
    got = {r.file_id: r for r in corpus.preprocess(d, index).collect()}
    assert set(got) == {1, 2, 5, 6} and got[1].body.endswith(shared) and got[2].body == body(2)
    assert all(r.score is not None and r.summary and r.cluster >= 0 for r in got.values())


def test_near_first_kept_is_not_transitive(spark):
    base = [f"sentence number {i} about the matter of {i * 7919 % 1000} things. " for i in range(60)]
    a, far = "".join(base), "other words entirely, " * 60
    d = spark.createDataFrame([(1, a), (2, a), (3, far), (4, a + "x"), (5, None)], "file_id long, body string")
    got = {r.file_id: r.kept for r in firstkept.kept_first(d).collect()}
    assert got[1] and not got[2] and got[3] and set(got) == {1, 2, 3, 4, 5}


def test_near_first_kept_decides_long_chains(spark, monkeypatch):
    chain = F.udf(lambda t: [int(t), int(t) + 1], "array<long>")
    monkeypatch.setattr(firstkept.F, "pandas_udf", lambda kind: lambda f: chain)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        d = spark.createDataFrame([(i, str(i)) for i in range(66)] + [(None, "5")], "file_id long, body string").coalesce(1)
        got = {r.file_id: r.kept for r in firstkept.kept_first(d).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {i: i % 2 == 0 for i in range(66)} | {None: True}


def test_chapters_contexts_and_chunks(spark):
    d = spark.createDataFrame([(1, "head\n## 1. One\nalpha\n## 2. Two\nbeta"), (2, "none"), (3, None), (4, "")], "doc_id long, text string")
    ch = reports.chapters(d, "doc_id", "text")
    assert [(r.title, r.body) for r in ch.orderBy("chap_ord").collect()] == [("## 1. One", "alpha"), ("## 2. Two", "beta")]
    c = reports.contexts(ch, "doc_id").orderBy("chap_ord").collect()
    assert (c[0].next_summary, c[1].prev_title) == ("beta", "## 1. One")
    parts = reports.chunks(d, "doc_id", "text", 7).where("doc_id = 1").orderBy("chunk_ord").collect()
    assert "".join(r.chunk for r in parts) == "head\n## 1. One\nalpha\n## 2. Two\nbeta"


def test_resolve_aliases(spark):
    e = spark.createDataFrame([("Grid", "ORG", 5), ("Ulm Grid", "ORG", 3), ("Bank", "ORG", 1), ("Grid", "GPE", 1)], "name string, label string, mentions long")
    got = {(r.label, r.name): r.canonical for r in graph.resolve(e).collect()}
    assert graph.resolve(spark.createDataFrame([("GRID a", "ORG", 5), ("grid", "ORG", 3), ("Grid", "ORG", 3)], "name string, label string, mentions long")).where("canonical = 'GRID a'").count() == 3
    assert got[("ORG", "Ulm Grid")] == "Grid" and got[("ORG", "Bank")] == "Bank" and got[("GPE", "Grid")] == "Grid"


def test_resolve_aliases_beyond_a_thousand_names(spark):
    import random

    r = random.Random(1)
    rows = [(f"N{i:04d}x", "ORG", 5000 - i) for i in range(1100)] + [("The N1050x Bank", "ORG", 1)] + [(t, "LOC", r.randrange(1, 6)) for t in sorted({"".join(r.choice("abc") for _ in range(r.randrange(1, 7))) for _ in range(60)})]
    want, canon = {}, {}
    for name, label, n in sorted(rows, key=lambda x: (-x[2], x[0])):
        c = next((x for x in canon.setdefault(label, []) if name in x or x in name), None)
        want[label, name] = c or name
        canon[label] += [] if c else [name]
    got = graph.resolve(spark.createDataFrame(rows, "name string, label string, mentions long")).collect()
    assert {(x.label, x.name): x.canonical for x in got} == want and len(got) == len(rows)


def test_text_clusters_searches_the_whole_range(spark, monkeypatch, tmp_path):
    from papyra.plans import queries

    d = spark.createDataFrame([(i, f"the topic{i % 8}x topic{i % 8}y") for i in range(16)], "file_id long, body string")
    d.withColumn("ingested_at", F.current_timestamp()).write.parquet(f"{tmp_path}/corpus_docs.parquet")
    run = queries.cluster.clusters
    monkeypatch.setattr(queries.cluster, "clusters", lambda *a, **k: run(*a, **({"k_min": 7, "inits": 2} | k)))
    got = {r.file_id: r.cluster for r in queries.text_clusters(spark, str(tmp_path)).collect()}
    assert len(set(got.values())) == 8 and all(got[i] == got[i + 8] for i in range(8))


def test_summary_is_a_subsequence(spark):
    text = " ".join(f"Sentence {i} speaks about topic {i % 3} at some length." for i in range(12))
    got = rank.summaries(spark.createDataFrame([(1, text), (2, None), (3, "short")], "id long, t string"), "id", "t", 3).collect()
    kept = got[0].summary.split(". ")
    assert len(kept) == 3 and got[1].summary == "" and [int(k.split()[1]) for k in kept] == sorted(int(k.split()[1]) for k in kept)


def test_whole_texts_through_citation_and_html_queries(spark, tmp_path):
    import hashlib
    import re

    from papyra.plans import queries

    texts = ["见图\u3000[1]，再见 [３]。", "a “quote”\u00a0[3] é\x1d[2]", "plain [1]\nline\u2003 two", "日本語\u3000\u3000本文\n\u2028終わり", None]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "finding_id long, answer string").withColumn("created_at", F.current_timestamp()).write.parquet(f"{tmp_path}/research_findings.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "crawl_id long, text string").withColumn("crawled_at", F.current_timestamp()).write.parquet(f"{tmp_path}/crawl_results.parquet")
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    want = {i: (md5(re.sub(r"\s*\[\d+\]", "", t)), md5(t.replace("[1]", "[1 待验证]").replace("[3]", "[3 待验证]"))) for i, t in enumerate(texts) if t is not None}
    assert {r.finding_id: (r.stripped_md5, r.marked_md5) for r in queries.citation_marks(spark, str(tmp_path)).collect()} == want
    pages = {i: md5(re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", "<p>" + t.replace("\n", "</p><p>") + "</p>")).strip()) for i, t in enumerate(texts) if t is not None}
    assert {r.crawl_id: r.text_md5 for r in queries.html_import(spark, str(tmp_path)).collect()} == pages


def test_external_calls_each_prompt_once(spark):
    d = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "p string")
    first = external.answered(d, "p", external.stub)
    assert first.count() == 2 and external.answered(d, "p", external.stub, first).count() == 2


def test_sources(spark, tmp_path):
    (tmp_path / "b.txt").write_text("Title: B\ntitle: C\n====\n\nbody text\n")
    (tmp_path / "_skip.txt").write_text("x")
    (tmp_path / "a.txt").write_text("no header")
    rows = {r.filename: r for r in files.corpus_dir(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.txt", "b.txt"} and rows["b.txt"].title == "C" and rows["b.txt"].body == "body text" and rows["a.txt"].body == "no header"
    j = spark.createDataFrame([('{"messages":[{"role":"user","content":"hi"},{"role":"bot","content":"yo"}]}',), ("plain\n\n x",)], "raw string")
    assert [r.transcript for r in files.chat_json(j, "raw").collect()] == ["用户：hi\n\n助手：yo", "plain\n\nx"]
    assert files.front_matter("---\nreport_type: 'x'\n# c: d\n---\n## A\ntext") == ({"report_type": "x"}, {"A": "text"})


def test_entry_without_text_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['papyra.llm'] = None\nimport importlib.util as u\nf = u.find_spec\nu.find_spec = lambda n, *a: None if n.startswith('papyra.llm') else f(n, *a)\nimport __spark_entry__ as e\nassert not [q for q in e.queries() if q[:3] in ('p1_', 'p7_')] and 'p4_found' in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True)


def test_stages_are_shared_and_released(spark, tmp_path):
    import os

    from papyra.operators import common

    common.release(spark)
    d = common.stored(spark.range(3).toDF("id"), "x")
    path = common._WRITTEN[-1]
    assert d.count() == 3 and path.startswith(spark.conf.get("spark.checkpoint.dir"))
    assert common.release(spark) == 1 and not os.path.exists(path.removeprefix("file://"))
    s = type("S", (), {"conf": type("C", (), {"get": lambda *a: None})(), "sparkContext": type("X", (), {"master": "spark://h:7077"})()})()
    with pytest.raises(ValueError):
        common.shared_dir(s)


def test_groups_of_plain_topics(spark):
    from papyra.operators import cluster

    d = spark.createDataFrame([(i, f"alpha{i % 4} beta{i % 4} gamma{i % 4} word") for i in range(40)] + [(100, None), (101, "")], "file_id long, body string")
    got = {r.file_id: r.cluster for r in cluster.clusters(d, "file_id", "body", inits=3).collect()}
    assert len(got) == 42 and len({got[i] for i in range(4)}) == 4 and all(got[i] == got[i % 4] for i in range(40))
    assert {r.cluster for r in cluster.clusters(d.where("file_id < 3"), "file_id", "body").collect()} == {-1}
    assert cluster.clusters(d.where("false"), "file_id", "body").count() == 0
