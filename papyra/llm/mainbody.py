"""Problem 3: the lines of a page that are not its main body.

Tag-path ratios, for pages that reach us as lines: a line's path is its site together with the line
as printed, digits masked (what a template prints again has the same path on every page).

1. Over all pages, per path: pages that print it, text length and punctuation. Both are fused (their
   geometric mean), smoothed towards the site's and the corpus's mean, and thresholded at ``rich`` times it:
   a path that a large share of the site's pages print is frame if it lies below, and text printed
   again if above. There are at most 1/``share`` times as many frequent paths as lines on a page.
2. A linear classifier on words and shape carries this over to sites with few pages. It is fitted on
   a bounded sample: lines of frame paths against lines rich in text and punctuation and the
   titles in front of them.
3. Per page, length and punctuation ratios are smoothed over the lines, fused and thresholded;
   blocks opened by a teaser or comment heading are left out up to the next running text.

Policies: lines of white space are neither; null and empty pages have no lines; of several
deliveries the latest counts; a page may have no main body at all.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm import textscan as ts
from papyra.llm.tokens import chunks
from papyra.operators.common import latest, spread, stored

BITS = 16
# Headings of blocks that lead to other pages, and of reader comments.
TEASERS = {x.lower() for x in ["More from this section", "Editor's picks", "You may also like", "Related stories", "Trending now", "Most read", "Mehr zum Thema", "Das könnte Sie interessieren", "Meistgelesen", "Empfehlungen der Redaktion", "À lire aussi", "Les plus lus", "Sur le même sujet", "Noticias relacionadas", "Le puede interesar", "Lo más leído", "Veja também", "Leia também", "Mais lidas", "Notícias relacionadas", "相关推荐", "更多内容", "编辑精选", "猜你喜欢", "热门阅读", "相关阅读", "関連記事", "おすすめ記事", "あわせて読みたい", "人気記事", "アクセスランキング"]}
_COMMENTS = re.compile(r"^(?:comments|commentaires|kommentare|comentarios|comentários|评论|コメント)\s*[（(]\s*\d+\s*[)）]$", re.I)
_COMMENT = re.compile(r"^[\w.\-]{3,24}\s?[:：]\s")
_LEAD = re.compile(r"^(?:sponsored by|presented by|präsentiert von|gesponsert von|patrocinado por|présenté par|sponsorisé par|apresentado por|本栏目由|赞助|提供：)\s?|^(?:read more|see also|related|more on this|lire aussi|à lire|lire la suite|lea también|leia também|leia mais|leer más|mehr dazu|lesen sie auch|weiterlesen|mehr lesen|相关阅读|延伸阅读|阅读更多|阅读全文|更多|関連|続きを読む|tags|topics|keywords|schlagwörter|themen|mots-clés|thèmes|etiquetas|temas|palavras-chave|标签|关键词|タグ|キーワード)\s*[:：]", re.I)
_SEPARATED = re.compile(r"\s+[/›»>·|•]\s+|\s{2,}")
_END = re.compile(r"[.!?][\"'”’»)\]]*(?:\s|$)|[。！？]")
_WORD = re.compile(r"[^\W\d_]+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_NUMBERED = re.compile(r"^\d{1,2}[.)]\s+")
_BULLET = re.compile(r"^[-*•]\s+")


def path(line: str) -> int:
    """64-bit path of a stripped line."""
    s = re.sub(r"\d+", "0", line.lower()).encode("utf-8", "surrogatepass")
    return (zlib.crc32(s) << 31) ^ zlib.crc32(s[::-1] + b"#")


def sentences(line: str) -> int:
    return len(_END.findall(line))


def size(line: str) -> int:
    """Length in letters, ideographs and kana counting double."""
    return len(line) + len(_CJK.findall(line))


class Facts(NamedTuple):
    """What a line shows by itself."""

    path: int
    plain: str
    ends: int
    size: int
    bullet: bool
    number: bool
    table: bool
    parted: bool
    lead: bool
    head: bool
    talk: bool
    wordless: bool
    shape: tuple[int, ...]


@functools.lru_cache(maxsize=50_000)
def facts(line: str) -> Facts:
    """Of a stripped line; lines of a frame come again and again, so the last are remembered."""
    bullet, number = bool(_BULLET.match(line)), bool(_NUMBERED.match(line))
    plain = _BULLET.sub("", _NUMBERED.sub("", line)) if bullet or number else line
    ends, n = sentences(plain), size(line)
    table = "|" in line and bool(re.search(r"\d", line)) or bool(re.match(r"^\|?[\s:|-]+\|$", line))
    gaps = len(_SEPARATED.findall(line)) if n < 400 else 0
    digits = sum(map(str.isdigit, line[:200]))
    shape = (min(4, sentences(line)), 5 + min(9, n // 15), 15 + min(5, gaps), 21 + min(3, digits), 25 + (0 if line[-1:].isalnum() else 1 + ord(line[-1:]) % 230), 24)
    wordless = not table and max((len(w) for w in _WORD.findall(line[:400])), default=0) < 2
    return Facts(path(line), plain, ends, n, bullet, number, table, gaps >= 1 and ends == 0 and not table, bool(_LEAD.match(line)), line.lower() in TEASERS, bool(_COMMENTS.match(line)), wordless, shape)


def features(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, bucket, value): words and neighbouring words, pairs of ideographs and kana, and the shape of each line."""
    low = [x.lower() for x in lines]
    cp, _, ends = ts.flat(low)
    letter = ts.classes()[cp] == ts.LETTER
    cjk = letter & ((cp >= 0x3040) & (cp <= 0x30FF) | (cp >= 0x3400) & (cp <= 0x9FFF))
    p = ts.prefix(cp)
    edge = np.diff(np.concatenate([[False], letter & ~cjk, [False]]).astype(np.int8))
    s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    d, h = np.searchsorted(ends, s), ts.mix(ts.span_hash(p, s, e))
    both = np.flatnonzero(d[1:] == d[:-1])
    two = np.flatnonzero(cjk[:-1] & cjk[1:])
    at = np.concatenate([d, d[both], np.searchsorted(ends, two)])
    k = np.concatenate([h, ts.mix(h[both] * np.uint64(3) + h[both + 1]), ts.mix(ts.span_hash(p, two, two + 2), 2)]) % np.uint64((1 << BITS) - 256)
    n = np.maximum(2.0, np.bincount(at, minlength=len(lines)) / 4)
    shapes = np.array([facts(x).shape for x in lines], np.int64).reshape(len(lines), -1)
    line = np.concatenate([at, np.repeat(np.arange(len(lines)), shapes.shape[1])])
    return line, np.concatenate([k.astype(np.int64), shapes.ravel() + (1 << BITS) - 256]), np.concatenate([1.0 / n[at], np.full(shapes.size, 0.5)])


def guesses(lines: list[str], w: np.ndarray) -> np.ndarray:
    """The frame classifier's score of each line."""
    out = []
    for i, j in chunks(lines, 500_000):
        line, k, x = features(lines[i:j])
        out.append(np.bincount(line, x * w[k], j - i))
    return np.concatenate(out) if out else np.zeros(0)


def lines_of(text: str | None) -> list[tuple[int, str]]:
    """(number, stripped line) of the lines with more than white space."""
    return [(i, s) for i, x in enumerate((text or "").split("\n")) if (s := x.strip(" \t\r\x0b\x0c\xa0　﻿​"))]


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, hosts = b.column(0).to_pylist(), b.column(1).to_pylist()
        out = []
        for i, h, t in zip(ids, hosts, b.column(2).to_pylist()):
            out += [(i, h, p, size(s), sentences(s)) for p, s in {path(s): s for _, s in lines_of(t)}.items()]
        cols = list(zip(*out)) or [[]] * 5
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32()))], names=["id", "host", "path", "letters", "ends"])


def fit(pages: list[tuple[str, set[int]]], seed: int = 3) -> np.ndarray:
    """Weights of the frame classifier from (text, frame paths of the site) of sampled pages."""
    rng = np.random.default_rng(seed)
    rows: dict[tuple[str, int], tuple] = {}
    for text, frame in pages:
        ls = [s for _, s in lines_of(text)]
        hit = [path(s) in frame for s in ls]
        for i, s in enumerate(ls):
            if hit[i]:
                rows[s, 1] = ()
            elif sentences(s) >= 2 or (i + 1 < len(ls) and not hit[i + 1] and sentences(ls[i + 1]) >= 3 and sentences(s) == 0 and s.lower() not in TEASERS):
                rows[s, 0] = ()
    data = []
    known = list(rows)
    for i, j in chunks([s for s, _ in known], 500_000):
        line, k, x = features([s for s, _ in known[i:j]])
        order = np.argsort(line, kind="stable")
        cuts = np.searchsorted(line[order], np.arange(1, j - i))
        data += [(a, b, y) for a, b, (_, y) in zip(np.split(k[order], cuts), np.split(x[order], cuts), known[i:j])]
    w, g2 = np.zeros(1 << BITS), np.full(1 << BITS, 1e-3)
    for _ in range(4):
        for i in rng.permutation(len(data)).tolist():
            k, x, y = data[i]
            g = x * (1.0 / (1.0 + np.exp(-np.clip(x @ w[k], -30, 30))) - y)
            np.add.at(g2, k, g * g)
            np.add.at(w, k, -0.3 * g / np.sqrt(g2[k]))
    return w


def _overlap(line: str, words: set[str]) -> float:
    ws = [w for w in _WORD.findall(line.lower())]
    parts = [x for w in ws for x in ([w[i : i + 2] for i in range(len(w) - 1)] if _CJK.match(w) else [w] if len(w) > 3 else [])]
    return sum(p in words for p in parts) / len(parts) if parts else 0.0


def not_main(ls: list[tuple[int, str]], frame: set[int], guess: np.ndarray, common: frozenset[int] = frozenset()) -> list[int]:
    """Numbers of the lines that are not main body, of the lines of a page and the classifier's score of each."""
    n = len(ls)
    if not n:
        return []
    s = [x for _, x in ls]
    f = [facts(x) for x in s]
    plain = [x.plain for x in f]
    ends, length = np.array([x.ends for x in f]), np.array([x.size for x in f], float)
    bullet, number, table, parted, lead, head, talk, wordless = np.array([x[4:12] for x in f]).T
    known = np.array([x.path in frame or (x.path in common and not x.bullet) for x in f])
    off = wordless | known | (guess > 0) & ~bullet & ~table | parted | lead | head | talk
    # ratios, smoothed over the lines and fused
    punct = ends / np.maximum(length, 1) * 60
    kernel = np.array([0.2, 0.6, 0.2])
    smooth = lambda v: np.convolve(np.pad(v, 1, mode="edge"), kernel, "valid")
    fused = np.sqrt(smooth(np.log1p(length) * (ends > 0) * ~off) * smooth(np.minimum(punct, 2.0) * ~off + 1e-6))
    text_line = ~off & (ends >= 2) & (fused > 0.4 * max(0.3, np.median(fused[~off & (ends >= 2)]) if (~off & (ends >= 2)).any() else 0.3))
    main = text_line.copy()
    words = set()
    for i in np.flatnonzero(text_line).tolist() if head.any() else ():
        for x in _WORD.findall(s[i].lower()):
            words.update([x[j : j + 2] for j in range(len(x) - 1)] if _CJK.match(x) else [x])
    member = np.zeros(n, bool)
    i = 0
    while i < n:
        if head[i] or talk[i]:
            j = i + 1
            while j < n and not off[j] and (not text_line[j] or (talk[i] and _COMMENT.match(s[j]))) and not bullet[j] and not table[j] and (not talk[i] or _COMMENT.match(s[j])):
                j += 1
            block = list(range(i + 1, j))
            if head[i] and block:
                counted = number[block[0]]
                if counted:
                    block = [k for k in block if number[k]] if all(number[k] for k in block) else block[: next(x for x, k in enumerate([*block, -1]) if k < 0 or not number[k])]
                elif j < n and text_line[j]:
                    before = any(ends[k] == 0 and not off[k] and not bullet[k] and not table[k] for k in range(i)) or main[:i].any()
                    if ends[block[-1]] == 0 and (not before or len(block) > 1 and _overlap(plain[block[-1]], words) > 0.75):
                        block.pop()
            member[block] = True
            main[block] = False
            i = max(j, i + 1)
        else:
            i += 1
    open_ = ~off & ~member & ~main
    for i in np.flatnonzero(open_ & (ends == 1) & (length >= 40) & ~np.array([bool(_COMMENT.match(x)) and bool(re.match(r"^\S*\d", x)) for x in s])).tolist():
        main[i] = True
    for i in range(n - 1, -1, -1):  # titles, items and rows go with the running text they stand at
        if main[i] or off[i] or member[i]:
            continue
        nxt = next((k for k in range(i + 1, n) if not off[k] and not member[k]), None)
        if nxt is not None and main[nxt]:
            main[i] = True
    seen = False
    for i in range(n):
        seen |= bool(main[i])
        if not main[i] and not off[i] and not member[i] and (bullet[i] or table[i]) and seen:
            main[i] = True
    if not main.any():  # a headline may stand alone
        rest = [i for i in range(n) if not off[i] and not member[i] and not bullet[i]]
        if rest and length[rest[0]] >= 12:
            main[rest[0]] = True
    return [ls[i][0] for i in range(n) if not main[i]]


def _judge(weights: bytes, common: frozenset[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.frombuffer(weights, np.float64)
        kind = pa.list_(pa.int32())
        for b in batches:
            pages = [(lines_of(t), f) for t, f in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            guess = dict.fromkeys(x for ls, _ in pages for _, x in ls)
            guess = dict(zip(guess, guesses(list(guess), w).tolist()))
            out = [not_main(ls, set(f or ()), np.array([guess[x] for _, x in ls]), common) for ls, f in pages]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(out, kind)], names=["id", "arrived", "lines"])

    return run


def page_frames(pages: DataFrame, key: str = "crawl_id", url: str = "url", text: str = "text", arrived: str = "crawled_at", share: float = 0.25, least: int = 4, spread_share: float = 0.002, rich: float = 1.25, sample: int = 2500, salts: int = 16) -> DataFrame:
    """(key, lines array<int>): the numbers of the lines of each page that are not main body. ``sample`` bounds the pages the classifier is fitted on."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"(?i)^(?:https?://)?([^/?#:]*)", 1)), r"^(?:www\d?|m|amp)\.", "")
    src = pages.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.coalesce(host, F.lit("")).alias("host"), F.col(text).alias("text"), F.col(arrived).cast("timestamp").alias("arrived"))
    src = spread(src, "id")
    rows = src.select("id", "host", "text").mapInArrow(_paths, "id long, host string, path long, letters int, ends int").dropDuplicates(["host", "path", "id"])
    n, per_line = F.col("n"), F.sqrt(F.col("letters") / F.col("n") * F.col("ends") / F.col("n"))
    paths = rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("letters").alias("letters"), F.sum("ends").alias("ends"))
    paths = stored(paths, "paths").withColumn("ratio", per_line)
    texts = paths.where("ends > 0").groupBy("host").agg(F.sum(n * F.col("ratio")).alias("mass"), F.sum("n").alias("lines"))
    whole = texts.agg(F.coalesce(F.sum("mass") / F.sum("lines"), F.lit(0.0)).alias("m")).first().m
    level = (F.coalesce("mass", F.lit(0.0)) + 20 * whole) / (F.coalesce("lines", F.lit(0)) + 20)
    sites = src.select("host", "id").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages")).join(texts, "host", "left").withColumn("cut", rich * level)
    smooth = (n * F.col("ratio") + 2 * F.col("cut")) / (n + 2)
    often = paths.where(n >= least - 1).join(sites.where(F.col("pages") >= least), "host").where((n >= F.col("pages") * share) & (smooth < F.col("cut")))
    frames = stored(often.groupBy("host").agg(F.collect_list("path").alias("frame")), "frames")
    total = max(1, src.count())
    # a page prints some 25 lines, so at most 25 / 0.002 paths can be on that share of all pages, whatever their number
    everywhere = paths.groupBy("path").agg(*[F.sum(c).alias(c) for c in ("n", "letters", "ends")]).where((n >= max(3.0, spread_share * total)) & (per_line < rich * whole))
    common = frozenset(r.path for r in everywhere.select("path").collect())
    picked = src.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, sample / total) * (1 << 30))).join(frames, "host")
    w = fit([(r.text, set(r.frame)) for r in picked.select("id", "text", "frame").sort("id").limit(2 * sample).collect()])
    salted = frames.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    joined = src.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).join(salted, ["host", "salt"], "left")
    out = joined.select("id", "arrived", "text", "frame").mapInArrow(_judge(w.tobytes(), common), "id long, arrived timestamp, lines array<int>")
    return latest(out, ["id"], "arrived").select(F.col("id").alias(key), "lines")


def main_body(pages: DataFrame, frames: DataFrame, key: str = "crawl_id", text: str = "text", arrived: str = "crawled_at") -> DataFrame:
    """(key, body): the lines of each page's latest text that are main body, joined again; empty where there are none."""
    newest = pages.groupBy(key).agg(F.max_by(text, arrived).alias("_t"))
    parts = F.split(F.coalesce("_t", F.lit("")), "\n", -1)
    kept = F.filter(F.transform(parts, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda p: ~F.array_contains("lines", p["i"]) & (F.trim(p["x"]) != ""))
    return newest.join(frames, key).select(key, F.array_join(F.transform(kept, lambda p: p["x"]), "\n").alias("body"))
