"""Report-level operators, sources, sinks, formulas and external steps on small fixtures."""

import io
import json
import math
import xml.etree.ElementTree as ET
import zipfile

import pytest
from pyspark.sql import functions as F

from papyra import cli
from papyra.functions import markdown as M
from papyra.functions import mathtext
from papyra.functions import text as T
from papyra.operators import assembly, corpus, external, firstkept, knowledge, modes, reports, state, steps
from papyra.sources import files, sinks


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_split_report_levels_and_edges(spark):
    d = spark.createDataFrame([(1, "# T\nhead\n## 一、A\na\n## 2. B\nb", "x"), (2, "h\n### one\nt1\n### two\n\n### three\nt3", "x"), (3, "plain", "x"), (4, None, "x"), (5, "", "x")], "doc_id long, text string, title string")
    got = {r.doc_id: r for r in assembly.split_report(d, "doc_id", "text").collect()}
    assert got[1].header == "# T\nhead" and [tuple(c) for c in got[1].chapters] == [("## 一、A", "a"), ("## 2. B", "b")]
    assert got[2].level == "section" and [tuple(c) for c in got[2].chapters] == [("one", "t1"), ("three", "t3")]
    assert [tuple(c) for c in got[3].chapters] == [("正文", "plain")] and [tuple(c) for c in got[4].chapters] == [("正文", "")] == [tuple(c) for c in got[5].chapters]
    assert assembly.split_report(d.where("false"), "doc_id", "text").count() == 0


def test_merging_neighbours(spark):
    rows = [(1, 0, "## 1. A", "a"), (1, 1, "## A", "## A\nb"), (1, 2, "## B", "c"), (1, 3, "## A", "d"), (2, 0, None, "e"), (2, 1, None, None)]
    ch = spark.createDataFrame(rows, "k long, chap_ord int, title string, body string")
    got = [(r.k, r.title, r.parts, r.body) for r in assembly.merge_same_titles(ch, "k").orderBy("k", "island").collect()]
    assert got[:3] == [(1, "## 1. A", 2, "a\n\nb"), (1, "## B", 1, "c"), (1, "## A", 1, "d")] and got[3][2] == 2
    sub = spark.createDataFrame([(1, 0, "## 一、A", "a"), (1, 1, "## 一、A2", "b"), (1, 2, "## 二、B", "c")], "k long, chap_ord int, title string, body string")
    assert [(r.title, r.body) for r in assembly.merge_subchapters(sub, "k").orderBy("island").collect()] == [("一、A", "a\n\n## 一、A2\n\nb"), ("二、B", "c")]


def test_densities_issues_and_inventions(spark):
    ch = spark.createDataFrame([(1, 0, "## 一、Grid costs", "a"), (1, 1, "## 二、Load", "b"), (2, 0, "x", "y")], "k long, chap_ord int, title string, body string")
    out = spark.createDataFrame([(1, [5.0])], "k long, densities array<double>")
    assert [r.density for r in assembly.chapter_densities(ch, out, "k").orderBy("k", "chap_ord").collect()] == [5.0, 3.0, 3.0]
    issues = spark.createDataFrame([(1, 0, 0, "高", "章节2", "p", "s"), (1, 1, 1, None, "一、Grid costs here", "q", None), (1, 2, 2, None, None, "made up", None), (1, 0, 3, "低", "", "all", "")] + [(1, 3, 10 + i, None, None, f"m{i}", None) for i in range(20)], "k long, kind int, ord int, severity string, location string, problem string, suggestion string")
    got = assembly.chapter_issues(ch, issues, "k").orderBy("chap_ord", "pos").collect()
    assert [r.line for r in got if r.chap_ord == 0][:3] == ["- [低] all → ", "- [中] q → ", "- [高][幻觉] 疑似编造，须删除: made up"] and sum(r.chap_ord == 0 for r in got) == 15
    assert [r.line for r in got if r.chap_ord == 1][0] == "- [高] p → s"
    bag = assembly.invented(issues.where("kind = 2"), spark.createDataFrame([(1, "编造数据"), (1, "编造数据"), (1, None)], "k long, problem string"), "k")
    assert sorted(r.problem for r in bag.collect()) == ["made up", "编造数据", "编造数据"]


def test_page_parts_and_images(spark):
    kind = "k long, parts array<array<struct<type:string,value:string,src:string,alt:string,latex:string,display:boolean>>>"
    t = lambda x: ("text", x, None, None, None, None)
    rows = [(1, [[t("Hello there")], [t("see"), ("image", None, "https://a/b.jpg", "cat", None, None)], [t("Hello there")], [("formula", None, None, None, "x^2", True)], [t("ok")], [("image", None, "c", None, None, None), ("formula", None, None, None, "y", False)]]), (2, []), (3, None)]
    got = [(r.pos, r.segment) for r in assembly.page_segments(spark.createDataFrame(rows, kind), "k", "parts").orderBy("pos").collect()]
    assert got == [(0, "Hello there"), (1, "see ![cat](assets/img_001.jpg)"), (3, "$$\nx^2\n$$"), (5, "![](assets/img_002.png) $y$")]
    im = spark.createDataFrame([(1, "a assets/img_002.png b assets/img_001.png", [("img_001.png", None), ("img_002.png", "u")]), (2, "c assets/img_001.jpg", [("img_001.jpg", None)]), (3, "none", []), (4, None, None)], "k long, text string, images array<struct<filename:string,url:string>>")
    out = {r.k: r for r in assembly.remapped_images(im, "k", "text", "images").collect()}
    assert out[1].text == "a assets/img_002.png b assets/img_001.png" and out[2].text == "c assets/img_003.jpg" and out[2].images[0].filename == "img_003.jpg" and out[3].text == "none" and out[4].text == ""


def test_markdown_functions(spark):
    assert [tuple(x) for x in one(spark, "a [t](u) **b** *i* [3] [4 待验证]", M.inline_tokens)] == [("link", "[t](u)"), ("bold", "**b**"), ("italic", "*i*"), ("citation", "[3]"), ("citation", "[4 待验证]")]
    assert one(spark, r"cost $x+1$ and \(y\) but $$z$$", M.inline_math) == ["x+1", "y"]
    assert one(spark, "| a | :-: |", M.table_cells) == ["a", ":-:"] and one(spark, [":-:", "--:", "-", "x"], M.alignments, "array<string>") == ["center", "right", "left", "left"]
    assert [tuple(x) for x in one(spark, "x[^2] y[^10]\n[^10]: ten\n[^2]: old\n[^2]: two", M.footnotes)] == [(2, "two"), (10, "ten")] and one(spark, "x[^2] y[^10]\n[^2]: two", M.footnote_refs) == [2, 10]
    assert one(spark, "# Title\n**关键词**：a、b", M.doc_title) == "Title" and one(spark, "# T\n**关键词**：a、b", M.keywords) == ["a", "b"] and one(spark, "none", M.keywords) == []
    assert [one(spark, t, M.ordinal_key) for t in ("## 三、X", "12. Y", "A title that is longer than twenty")] == ["三", "12", "A title that is long"]
    assert one(spark, "[1] x [20] 😀 [3]", lambda c: M.renumbered(c, F.lit(7))) == "[8] x [27] 😀 [10]" and one(spark, "none", lambda c: M.renumbered(c, F.lit(7))) == "none"
    assert one(spark, "1. first question here\n\n- x\n2) another question", lambda c: M.list_lines(c, 10, 5)) == ["first question here", "another question"]
    assert [one(spark, t, lambda c: M.int_or(c, 3)) for t in ("7", " 8 ", "x", None)] == [7, 8, 3, 3]
    assert one(spark, "😀 1.0 and 2.0", M.final_header) == "😀 1.0 and 3.0 最终版" and one(spark, "# A \nb", M.v5_title) == "# A 5.0版\nb" and one(spark, "研究报告 3.0 报告3.0", M.cited_label) == "4.0（含引用） 报告3.0"
    assert one(spark, "## 事实\nrule\n## 文笔\nx", lambda c: M.section(c, F.lit("事实"))) == "## 事实\nrule" and one(spark, "", lambda c: M.section(c, F.lit("x"))) is None


def test_outlines_and_structures(spark):
    whole = json.dumps({"title": "T", "summary": "S", "keywords": ["a"], "outline": [{"level1": "x", "density": 2}, {"level1": "y"}]})
    got = one(spark, "```json\n" + whole + "\n```", M.outline)
    assert (got.title, got.parsed, [tuple(c) for c in got.chapters]) == ("T", "whole", [("x", 2.0), ("y", 3.0)])
    got = one(spark, whole[: whole.rindex('"level1"') + 12], M.outline)
    assert got.parsed == "cut" and [c.level1 for c in got.chapters] == ["x"] and got.title == "T"
    got = one(spark, 'bad "title": "Q", "keywords": ["a","b","c","d","e","f"]', M.outline)
    assert (got.title, got.parsed, got.keywords, len(got.chapters)) == ("Q", "pattern", list("abcde"), 4) and one(spark, None, M.outline).title == M.DEFAULT_TITLE
    assert [tuple(c) for c in one(spark, '{"chapters":[{"num":"1","title":"A"}]}', M.structure)] == [("1", "A")] and [tuple(c) for c in one(spark, '[{"num":"1","title":"A"}]', M.structure)] == [("1", "A")] and one(spark, "x", M.structure) == []


def test_text_functions(spark):
    header = "# 语料预处理报告\n- 有效文档: 3\n---\n## A\ntext\n- 压缩率 3\n" + "=" * 20 + "\n# 知识图谱语料（x）\n\n## 实体\nz"
    assert one(spark, header, T.strip_meta_header) == "## A\ntext\n\n## 实体\nz"
    assert [str(one(spark, t, T.published_date)) for t in ("2024-03-05", "2024-03-05T06:07:08", "March 5, 2024", " 5 March 2024 ", "x", None)] == ["2024-03-05 00:00:00", "2024-03-05 06:07:08", "2024-03-05 00:00:00", "2024-03-05 00:00:00", "None", "None"]
    refs = one(spark, [("u", "t", "A", "2020"), ("v", None, None, None), ("w", "x", None, "1999")], lambda c: T.references(c, True), "array<struct<url:string,title:string,author:string,year:string>>")
    assert refs == "## References\n\n[1] A (2020). t. u\n[2] v. v\n[3] Unknown (1999). x. w"
    ext = lambda k, b: spark.createDataFrame([(k, b)], "k string, b binary").select(T.image_ext_of(F.col("k"), F.col("b")).alias("e")).first().e
    assert [ext(None, bytearray(b"\x89PNG\r\n\x1a\n..")), ext("", bytearray(b"\xff\xd8x")), ext("image/GIF", None), ext(None, bytearray(b"RIFF0000WEBP")), ext(None, None), ext("x/tiff", None)] == [".png", ".jpg", ".gif", ".webp", ".png", ".tiff"]
    assert one(spark, "x【幻觉清单】\n- a\n【修改意见】b", T.hallucination_section) == "- a" and one(spark, "未发现虚构", T.hallucination_section) == "未发现虚构内容。" and one(spark, "none", T.hallucination_section) == ""


def test_windows_by_section(spark):
    d = spark.createDataFrame([(1, "x" * 1000, 2), (2, "y" * 300, 3), (3, "z" * 1000, 6), (4, "", 3), (5, None, 9), (6, "w" * 100, 5)], "k long, t string, n int")
    got = {}
    for r in reports.section_windows(d, "k", "t", "n", 400).orderBy("k", "window").collect():
        got.setdefault(r.k, []).append((r.start, len(r.part)))
    assert got == {1: [(0, 400), (400, 400), (800, 200)], 2: [(0, 300)], 3: [(0, 400), (200, 400), (400, 400), (600, 400), (600, 400), (600, 400)], 6: [(0, 100)] * 5}


def test_near_first_kept_equals_the_loop(spark):
    import random

    r, texts = random.Random(3), []
    for i in range(25):
        base = " ".join(f"word{r.randrange(300)}" for _ in range(120))
        texts.append(base)
        for _ in range(i % 4):
            w = base.split()
            for _ in range(r.choice([0, 1, 2, 4])):
                w[r.randrange(len(w))] = "other"
            texts.append(" ".join(w))
    kept, want = [], {}
    for i, t in enumerate(texts):
        b = set(firstkept._bands(t))
        want[i] = not any(b & k for k in kept)
        if want[i]:
            kept.append(b)
    d = spark.createDataFrame(list(enumerate(texts)), "file_id long, body string")
    assert {x.file_id: x.kept for x in firstkept.kept_first(d).collect()} == want and 25 <= sum(want.values()) < len(texts)
    assert len({k for t in ("a", "b", "", "abcde", "Abcde  ") for k in firstkept._bands(t)}) == 8 * 4


def test_first_delivery_and_corpus_parts(spark):
    d = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (None, "c", 1), (2, None, 5)], "k long, t string, at int")
    assert {r.k: r.x for r in corpus.first_delivery(d, "k", "at", x=F.upper("t")).collect()} == {1: "A", None: "C", 2: None}
    assert {r.k: r.t for r in corpus.once(d, "k", "at").collect()} == {1: "a", None: "c", 2: None}
    parts = spark.createDataFrame([("g", f"n{i:03d}", f"t{i}") for i in range(30)] + [(None, None, None), (None, "z", "q")], "g string, n string, t string")
    got = corpus.corpus_parts(parts, "g", "n", "t").orderBy("g", "ord").collect()
    assert [r.ord for r in got] == [0, 1, *range(30)] and got[2].text == "--- 来自文件: n000 ---\n\nt0" and got[0].text == "--- 来自文件:  ---\n\n"


def test_formulas():
    assert mathtext.math_to_latex("so 𝑃\n(\n𝑌\n∣\n𝑋) = 𝛼² holds") == ("so $P ( Y \\mid X) = \\alpha^{2}$ holds", 1)
    assert mathtext.math_to_latex("x ≤ 3") == ("x ≤ 3", 0) and mathtext.math_to_latex(None) == (None, 0) and mathtext.math_to_latex("") == ("", 0)
    assert mathtext.math_to_latex("𝜆 ∈ ℝ, ₙ")[0] == "\n$$\n\\lambda \\in \\mathbb{R}, _{n}\n$$\n"
    for t in (r"\frac{a}{b}+\sqrt[3]{x^{2}}", r"\sum_{i=1}^{n} x_{i}^{2}", r"\begin{matrix} a & b \\ c & d \end{matrix}", r"\begin{aligned} a \\ b \end{aligned}", r"\hat{x}+\overline{y}", r"\left[x\right]"):
        assert mathtext.omml_to_latex(mathtext.latex_to_omml(t)) == t
    assert mathtext.omml_to_latex(None) == "" and mathtext.omml_to_latex(mathtext.latex_to_omml("")) == "" and mathtext.omml_to_latex(mathtext.latex_to_omml("}{^_")) is not None


def test_formula_column(spark):
    d = spark.createDataFrame([(1, "𝑎 ≤ 𝑏"), (2, None), (3, "")], "k long, t string")
    assert {r.k: (r.m.text, r.m.formulas) for r in d.select("k", mathtext.with_latex(F.col("t")).alias("m")).collect()} == {1: ("$a \\leq b$", 1), 2: (None, 0), 3: ("", 0)}


def docx() -> bytes:
    w, m, r = "http://schemas.openxmlformats.org/wordprocessingml/2006/main", mathtext.OMML, "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    formula = ET.tostring(mathtext.latex_to_omml("x^{2}"), encoding="unicode")
    doc = f'<w:document xmlns:w="{w}" xmlns:m="{m}" xmlns:r="{r}" xmlns:a="urn:a"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>see </w:t></w:r>{formula}<w:r><a:blip r:embed="r1"/></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", doc)
        z.writestr("word/_rels/document.xml.rels", '<Relationships><Relationship Id="r1" Target="media/x.PNG"/></Relationships>')
        z.writestr("word/media/x.PNG", b"png")
    return b.getvalue()


def test_documents_and_folders(spark, tmp_path):
    assert files.docx_parts(docx()) == ("Head\n\nsee $x^{2}$![image](assets/img_001.png)\n\na | b", [("img_001.png", b"png")])
    assert files.docx_parts(docx(), True)[0].startswith("## Head") and files.docx_parts(b"x") == ("", []) == files.docx_parts(None)
    (tmp_path / "b.docx").write_bytes(docx())
    (tmp_path / "a.html").write_text("<script>x</script><p>Hi</p>\n<p>you</p>")
    (tmp_path / "c.json").write_text('{"messages":[{"role":"user","content":["see","this"]},{"role":"bot","parts":["x"]}]}')
    (tmp_path / "d.png").write_bytes(b"pic")
    (tmp_path / "e.pdf").write_bytes(b"pdf")
    (tmp_path / "f.xyz").write_text("no")
    (tmp_path / "g.txt").write_text(" \n ")
    got = [(r.filename, r.text) for r in files.corpus_files(spark, str(tmp_path), readers={"png": lambda b: "a " + b.decode(), "pdf": lambda b: 1 / 0}).collect()]
    assert [n for n, _ in got] == ["a.html", "b.docx", "c.json", "d.png"] and got[0][1] == "Hi you" and got[2][1] == "用户：see this\n\n助手：x" and got[3][1] == "a pic"
    rows = spark.createDataFrame([("https://chatgpt.com/share/1", "<p>a</p>"), ("x.txt", "b\n\n\nc")], "src string, raw string")
    assert [(r.platform, r.text) for r in files.ingested(rows, "src", "raw").collect()] == [("chatgpt", "a"), ("file", "b\n\nc")]
    assert files.first_of(str(tmp_path / "none"), str(tmp_path / "f.xyz")) == "no" and files.first_of("/none") == "" and files.prompts_for({"P a": "own"}, {"a": "x", "b": "y"}, "P ") == {"a": "own", "b": "y"}


def test_sinks(spark, tmp_path):
    p = sinks.Package.create(tmp_path / "pkg", "text " * 10, "src")
    p.add(b"1", p.next_name(".jpg"))
    p.add(b"2")
    assert p.manifest()["assets"] == ["img_001.jpg", "img_002.png"] and sinks.is_package(p.folder) and not sinks.is_package(None)
    assert sinks.load_text(p.folder, 4) == "text\n\n[内容已截断，仅保留前 4 字]" and sinks.load_text(None) == "" == sinks.load_text("/none")
    d = spark.createDataFrame([(i, f"line {i}") for i in range(20)], "ord long, text string")
    sinks.write_corpus(d, str(tmp_path / "corpus"))
    lines = [x for f in sorted((tmp_path / "corpus").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines == [f"line {i}" for i in range(20)]
    assert "<h1>T</h1>" in sinks.to_html("# T\n```\na<b\n```\n- x **y**") and "a&lt;b" in sinks.to_html("```\na<b\n```")


def test_state(spark, tmp_path):
    import datetime as dt

    at = lambda h: dt.datetime(2024, 1, 1, h)
    e = spark.createDataFrame([("b", "s1", "h1", at(1), 1), ("b", "s2", "h1", at(2), 2), ("b", "s1", "h2", at(3), 3), ("c", None, "h", at(1), 4)], "base string, step string, config_hash string, ts timestamp, seq long")
    st = state.progress(e)
    r = st.first()
    assert (r.steps, r.config_hash, r.timestamps["s1"]) == (["s1", "s2"], "h2", at(3)) and st.count() == 1
    more = state.merged_progress(st, spark.createDataFrame([("b", "s3", "h3", at(5), 1)], e.schema)).first()
    assert set(more.steps) == {"s1", "s2", "s3"} and more.config_hash == "h3"
    skip = lambda step, h: st.select(state.skips(F.col("steps"), F.col("config_hash"), step, h).alias("x")).first().x
    assert (skip("s1", "h2"), skip("s1", "h1"), skip("s9", "h2")) == (True, False, False)
    log = state.UsageLog(spark, str(tmp_path / "log"))
    log.record(spark.createDataFrame([("p", "m", 1, 2, at(1))], state.UsageLog.SCHEMA))
    assert log.rows().count() == 1
    log.reset()
    assert log.rows().count() == 0


def answering(rules):
    def maker():
        return lambda p: next((v for k, v in rules.items() if k in p), "plain answer of some length")

    return maker


def test_steps(spark):
    rep = spark.createDataFrame([(1, "## 1. A\n" + "text of the chapter. " * 20 + "\n## 2. B\nmore"), (2, None)], "k long, text string")
    ev = {r.k: r for r in steps.evaluations(rep, "k", "text", ["facts"], answering({"text of": '```json\n{"score": 80, "assessment": "ok", "issues": [{"problem": "编造"}]}\n```'})).collect()}
    assert ev[1].score == 80 and ev[1].issues[0].problem == "编造" and ev[2].score == -1
    facts = steps.checked_facts(rep.where("k = 1"), "k", "text", answering({"List the facts": "a fact that is long enough\nshort", "Mark": "❌ wrong\n✅ fine"})).collect()
    assert [r.problem for r in facts] == ["❌ wrong"]
    con = steps.consistency(rep, "k", "text", answering({"text of": '[{"type":"t","description":"d"}]'})).orderBy("k").collect()
    assert "## 问题 1\n- **类型**: t\n- **严重程度**: 未知" in con[0].report and con[1].issues == []
    one_, all_ = steps.experts(rep, "k", "text", {"a": "A", "b": "B"}, answering({"A\n": "x【幻觉清单】y"}))
    assert one_.count() == 4 and all_.count() == 2 and {r.inventions for r in one_.collect()} == {"y", ""}
    ch = assembly.report_chapters(rep.where("k = 1"), "k", "text")
    new = steps.per_chapter(ch, "k", "Revise.", answering({"# ## 2. B": " ", "Revise": "new"}), ).orderBy("chap_ord").collect()
    assert [r.body for r in new] == ["new", "more"]
    short = steps.compressed(ch, "k", lambda: lambda p: p.partition("\n")[2][: int(len(p.partition("\n")[2]) * 0.8)]).orderBy("chap_ord").collect()
    assert 0.4 * len(ch.orderBy("chap_ord").first().body) < len(short[0].body) < 0.65 * len(ch.orderBy("chap_ord").first().body)
    urls = spark.createDataFrame([("https://a",), ("https://b",), (None,), ("https://a",)], "url string")
    assert sorted(r.status for r in steps.reachable(urls, "url", answering({"//a": "ok", "//b": "unreachable"})).collect()) == ["ok", "ok", "unreachable", "unreachable"]
    found, report = steps.research(spark.createDataFrame([(1, "grids")], "k long, topic string"), "k", "topic", answering({"List research": "what is the first question\nand the second one", "open on": "覆盖充分"}), answering({"first": '{"text":"c","citations":[{"url":"u","title":"t"},{"url":"u","title":"t"}]}'}))
    assert found.count() == 2 and report.first().report.endswith("1. [t](u)") and steps.quality(rep, "k", "text", external.stub).first().overall == -1
    big = steps.reorganised(spark.createDataFrame([(1, "x" * 30)], "k long, text string"), "k", "text", answering({"Remove": "done"}), 10).first().text
    assert big == "done\n\n" + "x" * 20
    full = steps.full_report(rep, "k", "text", answering({"outline": '{"title":"R","outline":[{"level1":"一、A"},{"level1":"二、B"}]}'}), {"a": "A"}).orderBy("k").collect()
    assert full[0].report.startswith("# R\n\n> \n\n**关键词**：\n\n---\n\n## 一、A")


def test_retries():
    waits, left = [], [RuntimeError("API 503"), TimeoutError()]

    def call(p):
        if left:
            raise left.pop(0)
        return "ok"

    assert external.with_retry(call, sleep=waits.append)("x") == "ok" and waits == [2.0, 4.0]
    with pytest.raises(ValueError):
        external.with_retry(lambda p: (_ for _ in ()).throw(ValueError()), sleep=waits.append)("x")


def test_knowledge_and_modes(spark):
    body = lambda k: "\n\n".join(f"Alpha Institute examined Beta Council in 20{10 + k}. Word{k * 31 + i} stands in part {i} of the text about topic{k % 2} and goes on for long enough to count. The Alpha Institute report {k} says more about grid{i + k * 7}." for i in range(6))
    d = spark.createDataFrame([(k, f"f{k}.txt", f"f{k}.txt", f"Title {k}", "Src", "2024-01-01", body(k)) for k in range(6)], "file_id long, filename string, filepath string, title string, source string, published string, body string")
    m = knowledge.recognised(d, knowledge.by_patterns())
    e = {r["name"]: r for r in knowledge.entities(m).collect()}
    assert e["Alpha Institute"].label == "ORG" and e["Alpha Institute"].docs == 6 and len(e["Alpha Institute"].contexts) == 5 and e["2010"].label == "DATE"
    rel = knowledge.graph.relation_counts(m.where("subject IS NOT NULL").select("subject", "predicate", "object")).first()
    assert (rel.subject, rel.predicate, rel.object, rel.n) == ("Alpha Institute", "examined", "Beta Council", 36)
    both = knowledge.merged(knowledge.graph.entity_counts(m.where("name IS NOT NULL").select("doc", "pos", "name", "label")), m)
    alpha = both.where("name = 'Alpha Institute'").first()
    assert alpha.docs == 6 and alpha.aliases == ["The Alpha Institute"] and alpha.mentions == 72
    text = modes.mode_text(d, spark.createDataFrame([], "line_id long, filename string, status string"), "AB", knowledge.by_patterns())
    assert "### 关键段落" in text and "- ORG: Alpha Institute (aka The Alpha Institute)" in text and "> [来源: Src 2024-01-01]" in text and "=====" not in text
    few = modes.mode_text(d.where("file_id < 2"), spark.createDataFrame([], "line_id long, filename string, status string"))
    assert few.startswith("## Title 0\n> [来源: Src 2024-01-01]")
    assert knowledge.recognised(d.where("false"), knowledge.by_dictionary({"A": "ORG"}, ("met",))).count() == 0


def test_drift_toc_and_scores(spark):
    a = spark.createDataFrame([(1, ["x", "y", "y"]), (2, None)], "k long, claims array<string>")
    b = spark.createDataFrame([(1, ["y", "z"]), (3, ["q"])], "k long, claims array<string>")
    got = {r.k: (r.retained, r.lost, r.added, r.n_lost) for r in assembly.drift(a, b, "k").collect()}
    assert got == {1: (["y"], ["x"], ["z"], 1), 2: ([], [], [], 0), 3: ([], [], ["q"], 0)}
    ch = spark.createDataFrame([(1, 1, "B"), (1, 0, "A")], "k long, chap_ord int, title string")
    assert assembly.toc(ch, "k").first().toc == "- A\n- B"
    r = assembly.score_range(spark.createDataFrame([(1.0,), (2.5,), (None,)], "v double"), "v").first()
    assert (r.least, r.most, math.isclose(r["mean"], 1.75)) == (1.0, 2.5, True)


def test_streaming(spark, tmp_path):
    import datetime as dt

    from papyra.streaming import ingest

    src = spark.createDataFrame([(1, "a " * 300, dt.datetime(2024, 1, 1)), (2, "a " * 300, dt.datetime(2024, 1, 1, 1)), (3, "short", dt.datetime(2024, 1, 1, 2)), (4, None, dt.datetime(2024, 1, 1, 3))], "file_id long, body string, ingested_at timestamp")
    src.coalesce(1).write.parquet(f"{tmp_path}/in")
    q = ingest.clean_stream(spark.readStream.schema(src.schema).parquet(f"{tmp_path}/in")).select("file_id").writeStream.format("memory").queryName("cleaned").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("cleaned").count() == 1
    log = spark.createDataFrame([("P ", 1, dt.datetime(2024, 1, 1, 0, 5)), ("p", 2, dt.datetime(2024, 1, 1, 0, 50)), ("p", None, dt.datetime(2024, 1, 1, 1, 5))], "provider string, input_tokens long, ts timestamp")
    log.coalesce(1).write.parquet(f"{tmp_path}/log")
    q = ingest.usage_windows(spark.readStream.schema(log.schema).parquet(f"{tmp_path}/log")).writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", f"{tmp_path}/cp2").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.calls, r.input_tokens) for r in spark.table("windows").collect()) == [(1, None), (2, 3)]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "r.md").write_text("# T\n## 1. A\na\n## 2. B\nb")
    assert cli.main(["export", str(tmp_path / "r.md"), "-o", str(tmp_path / "r.html")], spark).startswith("<h1>T</h1>") and (tmp_path / "r.html").exists()
    assert cli.main(["report-v2", str(tmp_path / "r.md")], spark).startswith("# T\n\n## 1. A\n\nstub:")
    assert "full-report" in cli.main(["help-all"]) and "--mode" in cli.main(["help-all"])
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.txt").write_text("beta")
    (tmp_path / "in" / "a.txt").write_text("alpha")
    assert cli.main(["merge", str(tmp_path / "in")], spark) == "--- 来自文件: a.txt ---\n\nalpha\n\n--- 来自文件: b.txt ---\n\nbeta"
    assert "n_retained" in cli.main(["drift-check", str(tmp_path / "r.md"), "--against", str(tmp_path / "r.md")], spark)
