"""Training-data operators on small fixtures: brute force, exact round trips, edge cases."""

import datetime as dt
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from papyra.llm import language, mainbody, neardup, packing, pairs, scans, splitting, textscan, tokens

AT = dt.datetime(2024, 1, 1)
WORDS = "the report compares a small grid with one large station and finds that it carries more load before winter than any model had said while costs fall".split()


def prose(seed: int, n: int = 12) -> str:
    r = random.Random(seed)
    return " ".join(" ".join(r.choice(WORDS) for _ in range(9)).capitalize() + "." for _ in range(n))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab'sltvred  \n\t1²é中。-")), max_size=40), min_size=1, max_size=5))
def test_pretokens_agree_with_the_pattern(texts):
    import regex

    cp, _, ends = textscan.flat(texts)
    s, e, d = textscan.pretokens(cp, ends)
    whole = "\0".join(texts) + "\0"
    got = [[] for _ in texts]
    for a, b, i in zip(s.tolist(), e.tolist(), d.tolist()):
        got[i].append(whole[a:b])
    assert got == [regex.findall(textscan.PRETOKEN, t) for t in texts]


def test_encoding_equals_the_tokenizer_and_decodes(spark):
    texts = [None, "", "Hello world's end", "中文。混合 text", "<|endoftext|> x", "a" * 3000, " \n\n ", "Hello world's end", "\x00​ é"]
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = tokens.encode_corpus(d, block_docs=2)
    rows = {r.doc_id: list(r.ids) for r in got.collect()}
    assert rows == {i: textscan.encoder().encode_ordinary(t or "") for i, t in enumerate(texts)}
    back = {r.doc_id: r.text for r in tokens.decode_ids(got).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert tokens.encode_corpus(d.where("false")).count() == 0


def test_words_of_equal_hash_keep_their_own_ids(spark):
    a, b = "a", "b"
    for _ in range(10):  # Thue-Morse words: every polynomial modulo a power of two hashes them alike
        a, b = a + b, b + a
    cp, starts, ends = textscan.flat([a, b])
    p = textscan.prefix(cp)
    assert len(set(textscan.span_hash(p, starts, ends).tolist())) == 1
    texts = [a, b, "x " + b + " y", a]
    got = tokens.encode_corpus(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block_chars=3000)
    assert {r.doc_id: list(r.ids) for r in got.collect()} == {i: textscan.encoder().encode_ordinary(t) for i, t in enumerate(texts)}
    assert [c.tolist() for c in tokens.token_counts([a, b], {}, "byte_bpe_50k", textscan.TOKENIZER_DIR)[1]] == [[len(textscan.encoder().encode_ordinary(t))] for t in (a, b)]


def test_blocks_are_bounded():
    r = random.Random(2)
    rows = [(i, " ".join(f"{r.choice(WORDS)}{r.randrange(40)}" for _ in range(60))) for i in range(900)]
    from unittest import mock

    with mock.patch("pyspark.TaskContext.get", return_value=mock.Mock(partitionId=lambda: 3)):
        batch = pa.record_batch([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], names=["doc_id", "text"])
        blocks = [b for b in tokens._blocks(10_000, 20_000, 10_000)(iter([batch]))]
    sizes = [sum(len(rows[i][1]) for i in b.column(1)[0].as_py()) for b in blocks]
    assert max(sizes) < 2 * 20_000 and sum(len(b.column(1)[0]) for b in blocks) == 900 and len({b.column(0)[0].as_py() for b in blocks}) == len(blocks)


def test_decoding_of_null_empty_and_unknown(spark):
    d = spark.createDataFrame([(1, None), (2, []), (3, [10**6]), (4, textscan.encoder().encode_ordinary("né 中")), (None, [None, 5])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in tokens.decode_ids(d).collect()} == {1: None, 2: "", 3: None, 4: "né 中", None: None}


def test_packing_holds_everything_once(spark):
    d = spark.createDataFrame([(i, prose(i, i % 40)) for i in range(120)] + [(500, None), (501, "word " * 700), (0, prose(0, 3))], "doc_id long, text string")
    rows = packing.pack_documents(d, 256, docs_per_partition=40).collect()
    enc, size, per = textscan.encoder(), {}, {}
    for r in rows:
        size[r.doc_id] = size.get(r.doc_id, 0) + r.n_tokens
        per[r.container_id] = per.get(r.container_id, 0) + r.n_tokens
    want = {}
    for r in d.collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + len(enc.encode_ordinary(r.text or ""))
    assert size == want and max(per.values()) <= 256
    whole = {r.doc_id for r in rows if r.piece > 0}
    assert all(want[i] > 256 for i in whole)
    assert packing.pack_documents(d.where("false"), 256).count() == 0


def test_hilbert_neighbours_are_adjacent():
    grid = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    order = grid[np.argsort(packing.hilbert(grid, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("text", ["x" * 950, "# A\n\n" + prose(1, 9) + "\n\n## B\n\n" + prose(2, 9), "- item one\n- item two\n" * 40, "句子很长，没有空格。" * 60, prose(3, 30) + " " + "y" * 400])
def test_pieces_cover_the_text(text):
    limit, overlap = 200, 30
    spans, forced = splitting.split_text(text, limit, overlap)
    assert all(0 < b - a <= limit for a, b in spans) and spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(nxt[0] == max(0, prev[1] - overlap) for prev, nxt in zip(spans, spans[1:]))
    assert forced == (len(splitting._SOLID.findall(text)) > 0 and max(map(len, splitting._SOLID.findall(text))) > limit)


def test_pieces_follow_the_tree():
    para = lambda k, n=3: f"{k} " + prose(k, n)
    text = "# A\n\n" + para(1) + "\n\n" + para(2) + "\n\n## A1\n\n" + para(3, 8) + "\n\n## A2\n\n" + para(4) + "\n\n# B\n\n" + para(5) + "\n\n- one\n  - " + para(6) + "\n  - " + para(7) + "\n- two " + para(8) + "\n"
    limit = 450
    cuts = [a for a, _ in splitting.split_text(text, limit, 0)[0]]
    at = lambda x: text.index(x)
    assert cuts[0] == 0 and at("## A1") in cuts and at("## A2") in cuts and at("# B") in cuts  # pieces of A, A1, A2 and B never mix
    assert all(text[p - 1].isspace() for p in cuts[1:])
    assert at("- two") in cuts or any(p <= at("# B") and q > at("- two") for p, q in zip(cuts, cuts[1:] + [len(text)]))
    deep = "\n".join("  " * i + f"- level {i} " + "w " * 20 for i in range(120))
    spans, _ = splitting.split_text(deep, 150, 20)
    assert spans[-1][1] == len(deep) and max(b - a for a, b in spans) <= 150


@settings(max_examples=120, deadline=None)
@given(st.lists(st.sampled_from(["# H\n\n", "## H\n", "para one. and two; three.\n\n", "- item\n", "  - sub item\n", "| a | b |\n", "```\ncode line\n```\n", "```\n", "句子。", "x" * 45, " \n\n", "word " * 9]), max_size=40), st.integers(12, 60), st.integers(0, 10))
def test_pieces_of_any_text_are_exact(parts, limit, overlap):
    text = "".join(parts)
    spans, forced = splitting.split_text(text, limit, overlap)
    assert all(b - a <= limit for a, b in spans) and spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(q[0] == p[1] - overlap or q[0] == max(0, p[1] - overlap) for p, q in zip(spans, spans[1:]))
    assert forced == any(len(x) > limit for x in splitting._SOLID.findall(text))


def test_split_table(spark):
    d = spark.createDataFrame([(1, "a b " * 100, AT), (1, "a b " * 100, AT + dt.timedelta(1)), (2, "short", AT), (3, None, AT), (4, "", AT), (5, "z" * 300, AT)], "k long, t string, at timestamp")
    got = {r.rec_id: r.forced for r in splitting.split_oversized(d, "k", "t", "at", 100, 10).collect()}
    assert got == {1: 0, 5: 1}


def test_near_duplicates_equal_brute_force(spark):
    r, bodies = random.Random(4), []
    for i in range(60):
        t = prose(i, 14)
        bodies.append(t)
        for _ in range(i % 3):
            w = t.split()
            for _ in range(r.choice([0, 1, 3, 6])):
                w[r.randrange(len(w))] = r.choice(WORDS)
            bodies.append(" ".join(w))
    bodies += [None, "", "short", bodies[0].upper(), "z" * 5000]
    d = spark.createDataFrame([(i, b, AT) for i, b in enumerate(bodies)], "file_id long, body string, ingested_at timestamp")
    sets = {i: {n[k : k + 5] for k in range(len(n) - 4)} for i, b in enumerate(bodies) if b is not None and len(n := neardup.normal(b)) >= 200}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.85 * len(sets[a] | sets[b])}
    members, links = neardup.similar_classes(d, node=8)
    assert {(x.id_a, x.id_b) for x in neardup.similar_pairs(members, links).collect()} == want
    star = {(x.id_a, x.id_b) for x in neardup.similar_pairs(members, links, multiply=1).collect()}
    assert star <= want
    g = {x.id: x.group_id for x in neardup.groups(members, links).collect()}
    assert all(g[a] == g[b] for a, b in want) and set(g) == set(sets)


def test_groups_of_a_long_chain(spark):
    n = 70
    members = spark.createDataFrame([(i, i, 1) for i in range(n + 1)], "id long, cls long, copies long")
    links = spark.createDataFrame([((i * 37) % n, (i * 37) % n + 1, 0.9) for i in range(n)], "a long, b long, similarity double")
    assert {r.group_id for r in neardup.groups(members, links).collect()} == {0}


def test_near_duplicates_large_nodes_and_empty(spark):
    base = prose(9, 20)
    rows = [(i, base + f" number {i} of them all", AT) for i in range(70)]
    d = spark.createDataFrame(rows, "file_id long, body string, ingested_at timestamp")
    members, links = neardup.similar_classes(d, node=8, depth=2)
    assert links.count() == 70 * 69 // 2
    assert neardup.similar_classes(d.where("false"))[1].count() == 0


def test_languages(spark):
    en, de = prose(1, 4), "Die Studie zeigt, dass der Winter kalt war und die Netze trotzdem hielten. Niemand hatte das so erwartet."
    docs = [(i, (en if i % 2 else de) + f" {i}", "en" if i % 2 else "German", "z") for i in range(60)] + [(100, en + "\n\n" + de, None, "z"), (101, None, "en", "z"), (102, "", None, "z"), (103, "123 456", None, "z"), (104, de, "en", "z")]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, seg string")
    lab = spark.createDataFrame([("en", "en"), ("German", "de")], "label string, code string")
    got = {(r.doc_id, r.seg): r.lang for r in language.wrong_or_mixed(language.identify_languages(d, lab)).collect()}
    assert got.pop((100, -1)) in ("en", "de")
    assert got == {(100, 0): "en", (100, 1): "de", (104, -1): "de"}
    assert language.identify_languages(d.where("false"), lab).count() == 0


def test_pages(spark):
    nav, foot = "Home | News | World | About", "© 2024 The Paper. All rights reserved."
    pages = [(i, "https://site.example/x", f"{nav}\nHow {WORDS[i % 20]} fares\n{prose(i, 3)}\n{prose(i + 50, 3)}\nMost read\n1. Another story\n2. One more story\n{foot}", AT) for i in range(40)]
    pages += [(100, "https://site.example/y", None, AT), (101, None, "", AT), (102, "https://one.example", " \n ", AT)]
    d = spark.createDataFrame(pages, "crawl_id long, url string, text string, crawled_at timestamp")
    got = {r.crawl_id: sorted(r["lines"]) for r in mainbody.page_frames(d).collect()}
    assert all(got[i] == [0, 4, 5, 6, 7] for i in range(40)) and got[100] == got[101] == got[102] == []
    body = {r.crawl_id: r.body for r in mainbody.main_body(d, mainbody.page_frames(d)).collect()}
    assert body[0].split("\n")[1] == prose(0, 3) and body[100] == ""


def test_repeated_text_rich_in_length_and_punctuation_is_no_frame(spark):
    nav, again = "Home | News | World | About", prose(77, 9)
    pages = [(i, "https://few.example/x", f"{nav}\nHow {prose(i + 900, 1)[:28]}\n{again}\n{prose(i, 3)}\n© 2024 The Paper.", AT) for i in range(6)]
    pages += [(100 + i, "https://site.example/x", f"{nav}\nHow {prose(i + 950, 1)[:28]}\n{prose(i, 3)}\n{prose(i + 50, 3)}\n© 2024 The Paper.", AT) for i in range(40)]
    d = spark.createDataFrame(pages, "crawl_id long, url string, text string, crawled_at timestamp")
    got = {r.crawl_id: sorted(r["lines"]) for r in mainbody.page_frames(d).collect()}
    assert all(got[i] == [0, 4] for i in range(6)) and all(got[100 + i] == [0, 4] for i in range(40))
    assert mainbody.page_frames(d.where("false")).count() == 0


def test_scans(spark):
    rng = np.random.default_rng(2)
    clean = ["\n\n".join(prose(i * 10 + k, 6) for k in range(9)) for i in range(40)]
    fakes = [scans.fake_scan(t, ["A title of some kind"], rng) for t in clean]
    model = scans.Layout(fakes[:30])
    right = [a == b for lines, y in fakes[30:] for a, b in zip(model.label(lines), y)]
    assert sum(right) / len(right) > 0.97
    assert [scans.roman(x) for x in ("i", "iv", "ix", "xiv", "xix", "xl", "xc", "viii")] == [1, 4, 9, 14, 19, 40, 90, 8]
    rows = [(i, t, AT) for i, t in enumerate(clean)] + [(100, "\n".join(fakes[0][0]).replace("-\n", "\n").replace("station", "stati0n"), AT), (101, None, AT), (102, "", AT)]
    d = spark.createDataFrame(rows, "extract_id long, text string, extracted_at timestamp")
    got = {r.extract_id: r for r in scans.read_scans(d).collect()}
    assert got[0].cases == [] and got[101].cases == [] and got[102].repaired == ""
    assert {c.kind for c in got[100].cases} & {"ocr"} and "stati0n" not in got[100].repaired
    assert scans.read_scans(d.where("false")).count() == 0


def test_misreadings_in_broken_words():
    words = {"station": 900, "stati0n": 1, "sta": 3, "tion": 2, "carries": 500, "calries": 0, "stat1on": 0}
    lex = scans.Lexicon(words, {}, {})
    read = lambda t: scans.read_text(t, [scans.BREAK] + [scans.BODY] * t.count("\n"), lex)
    assert read("The large sta-\ntion carries load.") == ([(0, "hyphen")], "The large station carries load.")
    assert read("The large sta-\nti0n carries load.") == ([(0, "hyphen"), (1, "ocr")], "The large station carries load.")
    words["st4tion"] = 0
    assert read("The large stat1-\non carries load.") == ([(0, "hyphen"), (0, "ocr")], "The large station carries load.")


def test_scan_lines_of_number_columns_and_alternating_heads():
    rng = np.random.default_rng(8)
    clean = ["\n\n".join(prose(i * 10 + k, 6) for k in range(9)) for i in range(60)]
    model = scans.Layout([scans.fake_scan(t, ["How the grid fares", "A first look at load"], rng) for t in clean])
    body = [x for p in clean[0].split("\n\n") for x in scans.textwrap.wrap(p, 60)]
    column = ["hours", "488", "884", "144", ""]
    lines = body[:20] + ["12", "Marsomar Partners"] + body[20:40] + ["13", "How the grid fares"] + body[40:44] + [""] + column + body[44:] + ["14"]
    y = model.label(lines)
    assert [x for x, s in zip(lines, y) if s == scans.PAGE] == ["12", "13", "14"]
    assert [x for x, s in zip(lines, y) if s == scans.HEAD] == ["Marsomar Partners", "How the grid fares"]
    many = model.label(["17"] * 4000)
    assert len(many) == 4000 and scans.PAGE not in many


def test_scans_count_every_word(spark):
    rows = [(i, f"{prose(i, 8)}\n\nThe bat came out at night {i}.", AT) for i in range(30)] + [(50, f"{prose(50, 8)}\n\nThe hat came out at night.", AT), (51, f"{prose(51, 8)}\n\nThe st†tion is cl0sed and the sta-\ntion waits for winte1.", AT)]
    d = spark.createDataFrame(rows, "extract_id long, text string, extracted_at timestamp")
    got = {r.extract_id: r for r in scans.read_scans(d).collect()}
    assert got[50].cases == [] and "hat came" in got[50].repaired and {c.kind for c in got[51].cases} >= {"ocr"}

    class Full(dict):
        def __contains__(self, k):
            return True

    counts = {k: n for b in scans._counts(iter([pa.record_batch([pa.array([t for _, t, _ in rows])], names=["text"])])) for k, n in zip(*(c.to_pylist() for c in b.columns))}
    full = scans.Lexicon(Full({k[1:]: n for k, n in counts.items() if k[0] == "w"}), {}, {})
    for i, t, _ in rows:
        y = [scans.BREAK if x.strip() else scans.BLANK for x in t.split("\n")]
        cases, text = scans.read_text(t, y, full)
        assert [(c.line_no, c.kind) for c in got[i].cases if c.kind in ("ocr", "hyphen")] == cases and got[i].repaired == text


def test_pairs(spark):
    r = random.Random(3)
    q = [f"Why did {r.choice(WORDS)} {r.choice(WORDS)} change the {r.choice(WORDS)} in {1990 + i % 30}?" for i in range(400)]
    rows = [("t", i, AT, q[i], prose(i, 3)) for i in range(400)]
    rows += [("t", 1000, AT, q[0], None), ("t", 1001, AT, q[1], "N/A"), ("t", 1002, AT, q[2], q[2]), ("t", 1003, AT, q[3], "I'm sorry, but I cannot answer questions on this subject."), ("t", 1004, AT, q[4], prose(4, 3)[:-25]), ("t", 1005, AT, None, prose(8, 3)), ("t", None, AT, "a", "b")]
    d = spark.createDataFrame(rows, "tbl string, rec_id long, arrived timestamp, question string, answer string")
    docs = spark.createDataFrame([(i, prose(i, 6), "en") for i in range(30)], "doc_id long, text string, lang string")
    lab = spark.createDataFrame([("en", "en")], "label string, code string")
    got = {r.rec_id: r.defect for r in pairs.judge_pairs(d, docs, lab).collect()}
    assert [got[i] for i in range(1000, 1006)] == ["empty", "empty", "copy", "refusal", "truncated", None]
    assert sum(got[i] is not None for i in range(400)) <= 4 and len(got) == 406
    assert pairs.judge_pairs(d.where("false"), docs.where("false"), lab).count() == 0


def test_pairs_know_the_language_of_keyword_queries():
    from papyra.llm.pairs import DEFECTS, train

    said = {
        "en": ["What matters for the council is the temporary rail link, which weakened the demand forecast before the winter peak.", "Officials linked the programme to the preliminary court ruling and the supply contract in most districts."],
        "de": ["Die Studie zeigt, wie das Windportfolio die Exportquote nach einer langen Anhörung gestärkt hat, obwohl die Kosten stiegen.", "Es ist nicht sicher, dass die Bahnverbindung ohne weitere Zuschüsse bestehen bleibt und die Lastprognose hält."],
        "fr": ["Selon le conseil, la licence d’eau a limité le réseau de transport malgré une demande plus faible dans la région.", "Pendant ce temps, on se demande encore si le port de commerce peut soutenir la réforme tarifaire avec peu de moyens."],
        "es": ["El estudio muestra que el centro de datos debilitó la planta solar después de dos consultas públicas en la zona.", "No está claro que la red de transporte siga siendo útil para el plan de inversión como esperaba la comisión."],
    }
    ask = {"en": "Latest {} figures {}", "de": "Zahlen über {} {}", "fr": "Données sur {} {}", "es": "Datos sobre {} {}"}
    what = {"en": ["rail link", "court ruling", "demand forecast"], "de": ["die Bahnverbindung", "die Exportquote", "das Windportfolio"], "fr": ["la licence d’eau", "le réseau de transport", "le port de commerce"], "es": ["el centro de datos", "la planta solar", "la red de transporte"]}
    r, pairs = random.Random(6), []
    for i in range(600):
        c = r.choice(list(said))
        pairs.append((ask[c].format(r.choice(what[c]), 2000 + i % 30), " ".join(r.choice(said[c]) for _ in range(3))))
    w, limit, read = train(pairs, [(t, c) for c in said for t in said[c] * 30])
    swapped = [(q, pairs[next(j for j in range(i + 1, 600) if pairs[j][0][:5] != q[:5])][1]) for i, (q, _) in enumerate(pairs[:200])]
    judge = lambda rows: [DEFECTS[int(s.argmax())] if s.max() > 0 else None for s in (x @ w[k] - limit for k, x in read.each(rows))]
    whole, bad = judge(pairs[:200]), judge(swapped)
    assert sum(d is not None for d in whole) <= 2 and sum(d == "language" for d in bad) >= 195


def test_signs_are_learned_from_contexts(spark):
    r, rows = random.Random(5), []
    for i in range(60):
        t = "".join(r.choice(["医院网络已经完成", "电价改革尚未开始", "风电项目再次延后", "年末储能容量增长", "城市电网调度改变"]) + "，" for _ in range(12))
        if i % 9 == 0:
            t = t.replace("网", "冈", 2).replace("电价", "甩价", 1)
        rows.append((i, t, AT))
    d = spark.createDataFrame(rows, "extract_id long, text string, extracted_at timestamp")
    counts = d.select("text").mapInArrow(scans._counts, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))
    assert scans.learn_signs(counts) == {"冈": "网", "甩": "电"}
    got = {x.extract_id: x for x in scans.read_scans(d).collect()}
    assert all(([c.kind for c in got[i].cases] == ["ocr"]) == ("冈" in t) for i, t, _ in rows) and not any("冈" in x.repaired or "甩" in x.repaired for x in got.values())


def test_signs_of_contexts_that_many_signs_share(spark):
    others = {"的电": "停输变配发核", "在路": "公铁水陆道航", "和力": "电火压人能主"}
    rows = []
    for i in range(60):
        t = "，".join(s[0] + x + s[1] for s, xs in others.items() for x in xs + ("凤" if i % 30 == 7 else "风" if i < 50 else ""))
        rows.append((i, t, AT))
    d = spark.createDataFrame(rows, "extract_id long, text string, extracted_at timestamp")
    counts = d.select("text").mapInArrow(scans._counts, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))
    assert scans.learn_signs(counts) == {"凤": "风"}
    got = {x.extract_id: x for x in scans.read_scans(d).collect()}
    assert all(([c.kind for c in got[i].cases] == ["ocr"]) == ("凤" in t) and got[i].repaired == t.replace("凤", "风") for i, t, _ in rows)


def test_every_sign_that_explains_a_misread_one_counts(spark):
    said = "城风路，乡风桥，村风港，镇风站，省风网，乡停桥，村停港，镇停站，省停网，县停线，海停岸"
    bad = "城凤路，乡凤桥，村凤港，镇凤站，省凤网，县凤线，我们在年末才看到新的道路"
    rows = [(i, bad if i % 30 == 7 else said, AT) for i in range(60)]
    d = spark.createDataFrame(rows, "extract_id long, text string, extracted_at timestamp")
    counts = d.select("text").mapInArrow(scans._counts, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))
    assert scans.learn_signs(counts) == {"凤": "风停"}
    got = {x.extract_id: x for x in scans.read_scans(d).collect()}
    assert all(([c.kind for c in got[i].cases] == ["ocr"]) == ("凤" in t) for i, t, _ in rows)
    assert got[7].repaired == bad.replace("凤线", "停线").replace("凤", "风")
