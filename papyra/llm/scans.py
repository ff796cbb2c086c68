"""Problem 5: text of scanned pages back into paragraphs.

* Lines: a hidden Markov model (states body, break, blank, running head, page number) over layout features,
  its tables counted on synthetic scans made from a bounded sample of clean records; Viterbi per text.
  A break line is body text that begins a paragraph; paragraphs are put together by these states.
* Hyphens: a sign at a line's end goes if the joined word is the likelier one by the counts of the
  text itself and of the corpus.
* Misread characters: a word is a misreading if a known confusion turns it into a word that is far
  more frequent (in the corpus, or in the text for names). For ideographs and kana the confusions
  are learned: a sign nearly all of whose contexts belong to another, far more frequent sign.

Corpus counts (words, three-sign contexts) cover all records, are summed map-side first, and stay in
a stored table: each text is joined with the counts it asks for. Which tokens may be misreadings is
found per distinct word; the driver holds a bit field of fixed size of them, whose false hits only
make a text ask for more counts.

Policies: null and empty texts have no lines; of several deliveries the latest counts; a text whose
lines are whole paragraphs has no hyphen cases.
"""

from __future__ import annotations

import functools
import hashlib
import re
import textwrap
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.operators.common import latest, spread, stored

BODY, BREAK, BLANK, HEAD, PAGE = range(5)
_STOPS = tuple(".!?:。！？：…")
HYPHENS = "-‐‑‒–¬­⁃−"
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*", re.U)
_CJK = re.compile(r"[぀-ヿ㐀-鿿々]")
_NUMBER = [
    ("of", re.compile(r"^(?:page|seite|página|pagina|p\.)\s*(\d+)\s*(?:of|von|de|sur|/)\s*\d+$", re.I)), ("cof", re.compile(r"^第\s*(\d+)\s*[页頁ページ]+\s*(?:共\s*\d+\s*[页頁ページ]+)?$")), ("page", re.compile(r"^(?:page|seite|página|p\.|s\.)\s*(\d+)$", re.I)),
    ("slash", re.compile(r"^(\d{1,4})\s*/\s*\d{1,4}$")), ("dash", re.compile(r"^[-–—‐~·.|]\s*(\d{1,4})\s*[-–—‐~·.|]$")), ("brack", re.compile(r"^[\[(（]\s*(\d{1,4})\s*[\])）]$")), ("bare", re.compile(r"^(\d{1,4})$")),
]
_ROMAN = re.compile(r"^[ivxlc]{1,7}$", re.I)
_EDGE = re.compile(r"^(?:(\d{1,4})\s{2,}(\S.*)|(\S.*?)\s{2,}(\d{1,4}))$")
# What a scan makes of printed letters, as (misread, printed).
CONFUSED = [("rn", "m"), ("ri", "n"), ("cl", "d"), ("li", "h"), ("ii", "u"), ("vv", "w"), ("1", "l"), ("1", "i"), ("l", "i"), ("I", "l"), ("0", "o"), ("O", "0"), ("c", "e"), ("e", "c"), ("†", "t"), ("5", "s"), ("6", "b"), ("9", "g"), ("8", "B"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("|", "l"), ("!", "l"), ("f", "t"), ("t", "f"), ("h", "b"), ("b", "h"), ("m", "rn"), ("n", "u"), ("u", "n"), ("o", "a"), ("a", "o"), ("é", "e"), ("y", "v"), ("v", "y"), ("q", "g"), ("g", "q"), ("ı", "i"), ("ɑ", "a"), ("α", "a"), ("а", "a"), ("е", "e"), ("о", "o"), ("р", "p"), ("с", "c"), ("ο", "o"), ("ν", "v"), ("ɡ", "g"), ("í", "i"), ("lc", "k"), ("tl", "d"), ("nn", "m"), ("in", "m"), ("m", "in"), ("¢", "c"), ("€", "e"), ("£", "E"), ("$", "s"), ("@", "a"), ("ß", "B"), ("B", "ß"), ("fi", "h"), ("j", "i"), ("i", "j"), ("i", "l")]
_ODD = re.compile(r"[†ﬀ-ﬆ|¢£$@€ıɐ-ʯͰ-ϿЀ-ӿ]")
_HEAD_OF = re.compile(r"([^\s.,;:!?()\[\]{}\"“”»«„…/\-‐‑‒–¬­⁃−]+)[\-‐‑‒–¬­⁃−]$")
_PART = re.compile(r"[^\W_]*[^\W\d_][^\W_]*")
_BROKEN = re.compile("(" + _PART.pattern + r")([\-‐‑‒–¬­⁃−])$")
_LINKED = re.compile(r"[^\W\d_]+[-‐][^\W\d_]+")
_TOKEN = re.compile(r"[^\s.,;:!?()\[\]{}\"“”«»„…。，、；：！？（）「」『』\-‐‑‒–¬­⁃−—/]+")


def roman(s: str) -> int:
    v = [{"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}[c] for c in s.lower()]
    return sum(-a if a < b else a for a, b in zip(v, v[1:] + [0]))


def closed(s: str) -> bool:
    """Whether a stripped line ends as a sentence does."""
    return s.rstrip("\"'”’»)]」』）")[-1:] in _STOPS


def fold(s: str) -> str:
    """A line as it compares with other prints of it: digits, case, blanks and misreadings aside."""
    s = "".join(s.split()).strip("0123456789").lower()
    for a, b in (("rn", "m"), ("ri", "n"), ("cl", "d"), ("li", "h"), ("1", "l"), ("i", "l"), ("0", "o"), ("c", "e"), ("†", "t"), ("ﬁ", "fl"), ("ﬂ", "fl")):
        s = s.replace(a, b)
    return s


def shape(line: str) -> tuple[str, int | None]:
    """Kind of number line, and its number."""
    s = line.strip()
    if len(s) > 40 and not (s[0].isdigit() or s[-1].isdigit()):
        return "", None
    for name, p in _NUMBER if len(s) <= 40 else ():
        if m := p.match(s):
            return name, int(m.group(1))
    if _ROMAN.match(s):
        return "roman", roman(s)
    if m := _EDGE.match(s):
        n = m.group(1) or m.group(4)
        if len(m.group(2) or m.group(3)) >= 3:
            return "edge", int(n)
    return "", None


def _sequences(shapes: list[tuple[str, int | None]]) -> dict[int, int]:
    """Number lines: 2 where a number up to three higher stands at least five lines below, or one lower above, in the same form; else 1."""
    first: dict[tuple, int] = {}
    last: dict[tuple, int] = {}
    for i, (k, v) in enumerate(shapes):
        if k:
            first.setdefault((k, v), i)
            last[k, v] = i
    return {i: 1 + any(last.get((k, v + d), i) >= i + 5 or first.get((k, v - d), i) <= i - 5 for d in (1, 2, 3)) for i, (k, v) in enumerate(shapes) if k}


def observe(lines: list[str]) -> np.ndarray:
    """Layout features of each line, as small integers: one row a line."""
    n = len(lines)
    strip = [x.strip() for x in lines]
    shapes = [shape(x) if s else ("", None) for x, s in zip(lines, strip)]
    cjk = any("\u3040" <= c <= "\u9fff" for x in strip for c in x[:2])
    size = [len(x) + (len(_CJK.findall(x)) if cjk else 0) for x in strip]
    full = [k for k in size if k]
    width = float(np.percentile(full, 80)) if full else 1.0
    runs = _sequences(shapes)
    ends = [closed(s) for s in strip]
    folded = [fold(x) if 3 <= len(x) <= 90 and not e else "" for x, e in zip(strip, ends)]
    near = Counter(f for f in folded if f)
    solid = [i for i in range(n) if strip[i]]
    prev_of, next_of = dict(zip(solid[1:], solid)), dict(zip(solid, solid[1:]))
    out = np.zeros((n, len(SIZES)), np.int64)
    for i in range(n):
        s = strip[i]
        if not s:
            out[i, 0] = 1
            continue
        k = shapes[i][0]
        a, b = prev_of.get(i), next_of.get(i)
        cell = k == "bare" and any(0 <= j < n and shapes[j][0] == "bare" for j in (i - 1, i + 1))
        num = 0 if not k else 4 if cell else 1 if k == "bare" else 2 if k == "edge" else 3
        blank = i == 0 or not strip[i - 1]
        gaps = int(blank) * 2 + int(i + 1 == n or not strip[i + 1])
        seq = runs.get(i, 0)
        again = min(2, near[folded[i]] - 1) if folded[i] else 0
        ff = int("\x0c" in lines[i]) + 2 * int(b is None or any("\x0c" in x for x in lines[i + 1 : b + 1]))
        by = int(any(j is not None and runs.get(j, 0) == 2 and abs(j - i) <= 3 for j in (a, b)))
        fill = 0 if size[i] < 0.45 * width else 1 if size[i] < 0.82 * width else 2
        split = 0
        if a is not None and b is not None:
            c = strip[a][-1]
            flow_in = (c.isalpha() or c in HYPHENS + ",，、" or c.isdigit()) and size[a] >= 0.6 * width
            flow_on = strip[b][0].islower() or ("\u3040" <= strip[b][0] <= "\u9fff" and not lines[b].startswith(("　", "  ")))
            split = 1 + int(flow_in) + int(flow_in and flow_on)
        words = s.split()
        upper = 2 if s.isupper() and len(s) > 6 else int(len(words) > 1 and all(w[0].isupper() for w in words))
        pad = len(lines[i]) - len(lines[i].lstrip(" 　"))
        before = a  # the text line before, over page lines
        for _ in range(2):
            if before is not None and (runs.get(before) or (folded[before] and near[folded[before]] > 1)):
                before = prev_of.get(before)
        opens = 8 * int(before is None or ends[before]) + 4 * int(before is None or size[before] < 0.82 * width) + 2 * int(blank) + int(1 <= pad <= 8)
        low = s[0].islower()
        out[i] = (0, num, seq, again, ff, by, fill * 2 + ends[i], split, upper * 2 + int(pad > 8), gaps, min(again, 1) * 6 + int(split == 3) * 3 + fill, opens * 2 + low, by * 4 + min(upper, 1) * 2 + int(ends[i]))
    return out


#: Number of values of each feature.
SIZES = (2, 5, 3, 3, 4, 2, 6, 4, 6, 4, 12, 32, 8)


class Layout:
    """Hidden Markov model; log tables counted with add-one smoothing."""

    def __init__(self, docs: list[tuple[list[str], list[int]]]) -> None:
        start, move = np.ones(5), np.ones((5, 5))
        emit = [np.full((k, 5), 0.5) for k in SIZES]
        for lines, y in docs:
            start[y[0]] += 1
            np.add.at(move, (y[:-1], y[1:]), 1)
            for table, x in zip(emit, observe(lines).T):
                np.add.at(table, (x, y), 1)
        self.start = np.log(start / start.sum())
        self.move = np.log(move / move.sum(1, keepdims=True)).T.tolist()  # [to][from]
        self.emit = [np.log(e / e.sum(0)) for e in emit]

    def label(self, lines: list[str]) -> list[int]:
        if not lines:
            return []
        obs = observe(lines)
        e = sum(table[x] for table, x in zip(self.emit, obs.T))
        blank, num, cell = obs[:, 0] == 1, obs[:, 1], (obs[:, 1] == 4) & (obs[:, 2] < 2)
        e[:, BLANK] = np.where(blank, 0, -1e9)  # blank lines are blank
        e[blank[:, None] & (np.arange(5) != BLANK)] = -1e9
        e[(num == 0) | (num == 2) | cell, PAGE] = -1e9  # a number in a column of numbers is no page's
        v, back = (self.start + e[0]).tolist(), []
        for row in e[1:].tolist():
            at, new = [], []
            for to, x in zip(self.move, row):
                got = [p + q for p, q in zip(v, to)]
                best = max(got)
                at.append(got.index(best))
                new.append(best + x)
            back.append(at)
            v = new
        y = [v.index(max(v))]
        for at in reversed(back):
            y.append(at[y[-1]])
        return y[::-1]


def fake_scan(text: str, titles: list[str], rng: np.random.Generator) -> tuple[list[str], list[int]]:
    """A clean text wrapped into pages with running heads, page numbers and stray table cells, with the state of each line."""
    pick = lambda x: x[int(rng.integers(len(x)))]
    wide = len(_CJK.findall(text)) > 0.3 * len(text)
    width = int(rng.integers(26, 40)) if wide else int(rng.integers(50, 80))
    title, names = pick(titles), re.findall(r"[A-ZÀ-Þ]\w+ [A-ZÀ-Þ]\w+", text) or [x[:7] for x in re.split(r"[。，、\s]+", text) if 3 < len(x)] or titles
    other = pick(names)
    gap, first = rng.random() < 0.6, pick(["", "", "    ", "　　"])
    lines, y = [], []
    for n, p in enumerate(re.split(r"\n\s*\n", text)):
        p = " ".join(p.split())
        if not p:
            continue
        if rng.random() < (0.3 if n == 0 else 0.12):  # a heading of the text itself
            lines += [pick(titles)] + [""] * int(gap or rng.random() < 0.5)
            y += [BREAK] + [BLANK] * (len(lines) - len(y) - 1)
        rows = textwrap.wrap(p, width) if " " in p[:60] else [p[i : i + width] for i in range(0, len(p), width)]
        rows[0] = first + rows[0]
        for i, r in enumerate(rows[:-1]):
            if r[-1:].isalpha() and rng.random() < 0.12 and not _CJK.match(r[-1]):
                rows[i] = r + "-"
        lines += rows
        y += [BREAK] + [BODY] * (len(rows) - 1)
        if gap:
            lines.append("")
            y.append(BLANK)
        if rng.random() < 0.1:
            lines += [pick(p.split() or ["x"])[:12]] + [str(int(rng.integers(10, 999))) for _ in range(3)] + [""] * gap
            y += [BREAK] * 4 + [BLANK] * gap
    per, style, n0 = int(rng.integers(14, 40)), int(rng.integers(9)), pick([1, 1, 5, 12, 88, 2])
    early, turns = rng.random() < 0.5, rng.random() < 0.5
    head, foot, alone = rng.random() < 0.5, rng.random() < 0.25, rng.random() < 0.8
    ff = rng.random() < 0.3
    pages = [(lines[i : i + per], y[i : i + per]) for i in range(0, len(lines), per)] or [([""], [BLANK])]
    out, st = [], []
    for k, (a, b) in enumerate(pages):
        v, t = n0 + k, other if turns and k % 2 else title
        t = t.upper() if style % 3 == 0 else t
        t = t.replace("m", "rn", 1) if rng.random() < 0.1 else t
        number = [str(v), f"- {v} -", f"[{v}]", f"{v}/{n0 + len(pages) - 1}", f"Page {v} of {n0 + len(pages) - 1}", " " * 30 + str(v), f"第{v}页 共{len(pages)}页", ["i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x"][k % 10], str(v)][style]
        top, bottom = [], []
        if head and (k or early):
            top.append((f"{v}    {t}" if style == 8 and k % 2 else f"{t}    {v}" if style == 8 else t, HEAD))
        if foot:
            bottom.append((f"{v}    {t}" if style == 8 and k % 2 else f"{t}    {v}" if style == 8 else t, HEAD))
        if alone and style != 8:
            (bottom if rng.random() < 0.97 else top).insert(int(rng.integers(2)) if foot else 0, (number, PAGE))
        page = [x for x, _ in top] + a + [x for x, _ in bottom]
        if ff and k:
            page[0] = "\x0c" + page[0]
        out += page
        st += [s for _, s in top] + b + [s for _, s in bottom]
        if rng.random() < 0.3 and k < len(pages) - 1:
            out.append("")
            st.append(BLANK)
    return out, st


def words_of(line: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(line)]


@functools.lru_cache(maxsize=100_000)
def odd(token: str) -> bool:
    """Whether the signs alone make a misreading likely."""
    if token.isascii() and token.isalpha():
        return False
    return bool(_ODD.search(token)) or (any(map(str.isdigit, token)) and bool(re.search(r"[^\W\d_]\d+[^\W\d_]|^\d[^\W\d_]{3,}|[^\W\d_]{3,}\d$", token)))


@functools.lru_cache(maxsize=100_000)
def judged(token: str) -> bool:
    """Whether a token is long enough, and no acronym, to be judged."""
    low = token.lower()
    letters = sum(map(str.isalpha, low))
    return not (letters < 2 or (letters < 3 and not any(map(str.isdigit, low))) or low.isupper() or (token.isupper() and len(token) <= 6))


def tokens_of(text: str) -> set[str]:
    """The distinct tokens of a text that are judged."""
    return {w for t in set(_TOKEN.findall(text)) if (t.isascii() or not _CJK.search(t)) and judged(w := t.strip("'’"))}


def variants(w: str) -> list[str]:
    out = []
    for a, b in CONFUSED:
        i = w.find(a)
        while i >= 0:
            out.append(w[:i] + b + w[i + len(a) :])
            i = w.find(a, i + 1)
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush(c: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(c.keys()), pa.string()), pa.array(list(c.values()), pa.int64())], names=["key", "n"])

    c: Counter = Counter()
    for b in batches:
        for t in b.column(0).to_pylist():
            seen: set[str] = set()
            cjk = not t.isascii() and bool(_CJK.search(t))
            flat = re.sub(r"\s+", "", t) if cjk else ""
            seen.update("3" + flat[m : m + 3] for m in range(len(flat) - 2) if "\u3005" <= flat[m + 1] <= "\u9fff")
            seen.update("w" + w for w in set(words_of(t)) if not (cjk and _CJK.match(w)))
            if "-" in t or "‐" in t:
                seen.update("w" + m.lower().replace("‐", "-") for m in _LINKED.findall(t))
            for w in tokens_of(t.replace("\x0c", "")):
                if odd(w) or "w" + w.lower() not in seen:
                    seen.add("t" + (w if odd(w) else w.lower()))
            c.update(seen)
        if len(c) > 400_000:
            yield flush(c)
            c = Counter()
    yield flush(c)


class Lexicon:
    """Word counts, learned sign confusions, and the contexts that tell them. A token whose count is not among ``words`` is as printed."""

    def __init__(self, words: dict[str, int], signs: dict[str, str], contexts: dict[str, int]) -> None:
        self.words, self.signs, self.contexts = words, signs, contexts

    def misread(self, token: str, own: Counter) -> str | None:
        """What the token was printed as, None if it is taken as printed."""
        low = token.lower()
        if low not in self.words or not judged(token):
            return None
        n, mine, strange = self.words.get(low, 0), own[low], odd(token)
        if n and not strange and n * 40 > max((self.words.get(c, 0) for c in variants(low)), default=0):
            return None
        best, score = None, 0
        for c in variants(token if strange else low):
            k = self.words.get(c.lower(), 0)
            s = k if k > max(2, 20 * n) else int(not n and len(c) > 4 and own[c.lower()] > (0 if strange else mine))
            if s > score:
                best, score = c, s
        if best is None and strange and sum(map(str.isalpha, low)) >= 3 and (_ODD.search(token) or re.search(r"[^\W\d_]\d[^\W\d_]", token)):
            best = token
            for a, b in CONFUSED:
                if _ODD.match(a) or a.isdigit():
                    best = best.replace(a, b)
        return best


def repair_line(line: str, lex: Lexicon, own: Counter, before: str = "", after: str = "", first: int = 0) -> str:
    """The line with misread characters put right; equal to the line if there are none. The word that a hyphen at the end
    breaks is not looked at, nor what stands before ``first``."""
    out, last = [], 0
    edge = len(line) - 1 if line[-1:] in HYPHENS else len(line) + 1
    for m in _TOKEN.finditer(line):
        t = m.group()
        if m.start() < first or m.end() == edge or not t.isascii() and _CJK.search(t):
            continue
        fixed = lex.misread(t.strip("'’"), own)
        if fixed and fixed != t:
            out += [line[last : m.start()], fixed]
            last = m.end()
    line = "".join([*out, line[last:]])
    if lex.signs and any(c in lex.signs for c in line):
        s = before[-1:] + line + after[:1]
        off = len(before[-1:])
        chars = list(line)
        for i, c in enumerate(chars):
            if c in lex.signs and 0 < i + off < len(s) - 1:
                a, b = s[i + off - 1], s[i + off + 1]
                least = 2 * lex.contexts.get(a + c + b, 0)
                chars[i] = next((p for p in lex.signs[c] if lex.contexts.get(a + p + b, 0) >= least > 0), c)
        line = "".join(chars)
    return line


BITS = 1 << 22


def _place(key: str) -> int:
    return zlib.crc32(key.encode("utf-8", "surrogatepass")) % BITS


def asked(text: str, y: list[int], signs: dict[str, str], doubtful: np.ndarray, memo: dict[str, tuple]) -> set[str]:
    """Keys of the corpus counts on which the reading of a text depends. ``memo`` keeps those of tokens between calls, bounded."""
    lines = text.split("\n")
    body = [i for i, s in enumerate(y) if s in (BODY, BREAK)]
    strip = [lines[i].replace("\x0c", "").strip() for i in body]
    known = set(words_of(text))
    keys: set[str] = set()
    if len(memo) > 200_000:
        memo.clear()
    for w in tokens_of("\n".join(strip)):
        got = memo.get(w)
        if got is None:
            low, strange = w.lower(), odd(w)
            p = [_place(k) for k in ([("t" + w)] if strange else ["w" + low, "t" + low])]
            hit = any(doubtful[i >> 3] >> (i & 7) & 1 for i in p)
            got = memo[w] = (low, strange, ("w" + low, *("w" + c.lower() for c in variants(w if strange else low))) if hit else ())
        if got[2]:
            keys.update(got[2])
        elif got[1] or got[0] not in known:
            keys.add("w" + got[0])
    for s, post in zip(strip, [lines[i].strip() for i in body[1:]]):
        if s[-1:] in HYPHENS and (m := _BROKEN.search(s)) and (t := _PART.match(post)):
            a, b = m.group(1).lower(), t.group().lower()
            keys.update(("w" + a, "w" + b, "w" + a + b, f"w{a}-{b}"))
            if (i := _HEAD_OF.search(s)) and (j := _TOKEN.match(post)):
                whole = i.group(1) + j.group()
                keys.update(["w" + whole.lower()], ("w" + c.lower() for c in variants(whole if odd(whole) else whole.lower())))
    for k, s in enumerate(strip):
        if signs and any(c in signs for c in s):
            pre, post = lines[body[k - 1]].strip() if k else "", lines[body[k + 1]].strip() if k + 1 < len(body) else ""
            s = pre[-1:] + s + post[:1]
            for i in range(1, len(s) - 1):
                if s[i] in signs:
                    keys.update("3" + s[i - 1] + c + s[i + 1] for c in s[i] + signs[s[i]])
    return keys


def read_text(text: str | None, y: list[int], lex: Lexicon) -> tuple[list[tuple[int, str]], str]:
    """((line, kind) cases, repaired text); ``y`` are the states of the lines."""
    lines = (text or "").split("\n")
    if not text or not text.strip():
        return [], ""
    cases = []
    body = [i for i, s in enumerate(y) if s in (BODY, BREAK)]
    linked = Counter(m.lower().replace("‐", "-") for m in _LINKED.findall(text)) if "-" in text or "‐" in text else Counter()
    own: Counter = Counter(words_of("\n".join(lines[i] for i in body)))
    wrapped = len(body) > 1
    paragraphs: list[str] = []
    current, joined = "", False
    rest, instead = 0, ""  # what the line before has read of this line
    for k, i in enumerate(body):
        raw = lines[i].replace("\x0c", "")
        nxt = body[k + 1] if k + 1 < len(body) else None
        pre = lines[body[k - 1]].strip() if k else ""
        post = lines[nxt].strip() if nxt is not None else ""
        s = raw.strip()
        fixed = repair_line(s, lex, own, pre, post, rest)
        bad = fixed != s
        if rest and instead != s[:rest]:
            fixed, bad = instead + fixed[rest:], True
        hyphen, rest = False, 0
        m = _BROKEN.search(s) if s[-1:] in HYPHENS else None
        if wrapped and m and nxt is not None and (t := _PART.match(post)):
            a, b = m.group(1).lower(), t.group().lower()
            small = next(c for c in t.group() if c.isalpha()).islower()
            one, two = lex.words.get(a + b, 0) + 20 * own[a + b], lex.words.get(f"{a}-{b}", 0)
            inner = linked[f"{a}-{b}"]
            sign = m.group(2)
            known = lex.words.get(a, 0) > 2 and lex.words.get(b, 0) > 2
            hyphen = (small or s.isupper()) and two + 20 * inner <= one if one or two or inner else small and (sign != "-" or not known)
            if hyphen:
                cases.append((i, "hyphen"))
                fixed = fixed[:-1]
                if (x := _HEAD_OF.search(s)) and (z := _TOKEN.match(post)):
                    head, end = x.group(1), z.group()
                    rest, instead = len(end), end
                    if (whole := lex.misread(head + end, own)) and whole != head + end:
                        cut = len(head) if whole.startswith(head) else len(whole) - len(end) if whole.endswith(end) else min(len(head), len(whole))
                        bad |= whole[:cut] != head
                        fixed, instead = fixed[: len(fixed) - len(head)] + whole[:cut], whole[cut:]
        if bad:
            cases.append((i, "ocr"))
        if y[i] == BREAK and current and not joined:
            paragraphs.append(current)
            current = ""
        current = current + ("" if joined or not current or _CJK.match(current[-1]) or _CJK.match(fixed[:1] or " ") or current[-1] in "。，、；：！？" else " ") + fixed
        joined = hyphen
    if current:
        paragraphs.append(current)
    cases += [(i, "running_head" if s == HEAD else "page_no") for i, s in enumerate(y) if s in (HEAD, PAGE)]
    return sorted(cases), "\n\n".join(paragraphs)


def learn_signs(counts: DataFrame, share: float = 0.7, times: int = 8) -> dict[str, str]:
    """Signs that stand nearly always where others, ``times`` as frequent signs belong: c -> these, best first. In a context (the
    signs on both sides) a sign speaks for every sign there that is three times as frequent, however many these are. The best
    is the one most of whose own occurrences are in such contexts. The driver gets one row a sign at most."""
    c = counts.where("key LIKE '3%'").select(F.substring("key", 3, 1).alias("c"), F.concat(F.substring("key", 2, 1), F.substring("key", 4, 1)).alias("slot"), "n")
    total = c.groupBy("c").agg(F.sum("n").alias("total"))  # at most the alphabet
    seen = c.join(F.broadcast(total), "c")
    over = seen.where("n >= 3").select("slot", F.col("c").alias("p"), F.col("n").alias("m"), F.col("total").alias("other"))
    votes = seen.join(over, "slot").where((F.col("m") >= 3 * F.col("n")) & (F.col("other") > times * F.col("total"))).groupBy("c", "p", "total", "other").agg(F.sum("n").alias("n"), F.sum("m").alias("cover"))
    best = votes.where(F.col("n") >= share * F.col("total")).groupBy("c").agg(F.sort_array(F.collect_list(F.struct((F.col("cover") / F.col("other")).alias("s"), "p")), asc=False).alias("b")).select("c", "b.p")
    return {r.c: "".join(p for p in r.p if _CJK.match(p)) for r in best.collect() if _CJK.match(r.p[0]) and _CJK.match(r.c)}


def _variants_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 2000):
            rows = [(_place(k), 20 * n if k[0] == "w" else 0, c) for k, n in zip(*(x.to_pylist() for x in b.slice(at, 2000).columns)) if "-" not in k and judged(k[1:]) for c in {c.lower() for c in variants(k[1:])}]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=["place", "least", "word"])


def doubtful_words(counts: DataFrame) -> np.ndarray:
    """Bit field of the words and odd tokens that a far more frequent word may explain."""
    many = counts.where("key LIKE 'w%' AND n > 2").select(F.expr("substring(key, 2)").alias("word"), F.col("n").alias("k"))
    v = counts.where("key LIKE 'w%' OR key LIKE 't%'").select("key", "n").mapInArrow(_variants_of, "place int, least long, word string")
    places = v.join(many, "word").where("k > least").select("place").distinct().toArrow()
    bits = np.zeros(BITS, bool)
    bits[places.column(0).to_numpy()] = True
    return np.packbits(bits, bitorder="little")


def _ask(layout: Layout, signs: dict[str, str], doubtful: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple] = {}
        for b in batches:
            texts = b.column(2).to_pylist()
            ys = [layout.label(t.split("\n")) if t and t.strip() else [] for t in texts]
            ref = [hashlib.md5(t.encode("utf-8", "surrogatepass")).digest() if y else None for t, y in zip(texts, ys)]
            keys = [sorted(asked(t, y, signs, doubtful, memo)) if y else [] for t, y in zip(texts, ys)]
            yield pa.record_batch([*b.columns, pa.array([bytes(y) for y in ys], pa.binary()), pa.array(ref, pa.binary()), pa.array(keys, pa.list_(pa.string()))], names=["id", "arrived", "text", "states", "ref", "keys"])

    return run


def _read(signs: dict[str, str], with_text: bool):
    kind = pa.list_(pa.struct([("line_no", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for t, y, keys, found in zip(*(b.column(i).to_pylist() for i in range(2, 6))):
                n = dict.fromkeys(keys, 0) | {f["key"]: f["n"] for f in found or []}
                words, contexts = ({k[1:]: v for k, v in n.items() if k[0] == x} for x in "w3")
                got.append(read_text(t, list(y), Lexicon(words, signs, contexts)))
            yield pa.record_batch([b.column(0), b.column(1), pa.array([[{"line_no": i, "kind": k} for i, k in c] for c, _ in got], kind), pa.array([t if with_text else None for _, t in got], pa.string())], names=["id", "arrived", "cases", "repaired"])

    return run


def read_scans(df: DataFrame, key: str = "extract_id", text: str = "text", arrived: str = "extracted_at", sample: int = 300, with_text: bool = True) -> DataFrame:
    """(key, cases array<(line_no, kind)>, repaired): one row per key. ``sample`` bounds the records the line model is fitted on."""
    src = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(arrived).cast("timestamp").alias("arrived"), F.col(text).alias("text"))
    src = spread(src, "id")
    counts = stored(src.where("text <> ''").select("text").mapInArrow(_counts, "key string, n long").groupBy("key").agg(F.sum("n").alias("n")), "counts")
    signs, doubtful = learn_signs(counts), doubtful_words(counts)
    total = max(1, src.count())
    chosen = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, 4 * sample / total) * (1 << 30))
    picked = src.where(F.when(chosen, F.col("text").rlike(r"[^\n]{200}")))
    clean = [r.text for r in picked.select("id", "text").sort("id").limit(sample).collect()]
    rng = np.random.default_rng(5)
    fakes = []
    titles = [p.strip() for t in clean for p in re.split(r"\n+", t) if 5 < len(p.strip()) < 60 and not closed(p.strip()) and not shape(p)[0]] or ["Annual review of the network"]
    for t in clean:
        fakes += [fake_scan(t, [titles[int(rng.integers(len(titles)))] for _ in range(4)], rng) for _ in range(3)]
    layout = Layout(fakes or [fake_scan("The text of a page runs on over several lines of it. " * 40, ["A title", "Another title"], rng) for _ in range(50)])
    texts = stored(src.mapInArrow(_ask(layout, signs, doubtful), "id long, arrived timestamp, text string, states binary, ref binary, keys array<string>"), "texts")
    found = texts.select("ref", F.explode("keys").alias("key")).join(counts, "key").groupBy("ref").agg(F.collect_set(F.struct("key", "n")).alias("found"))
    out = texts.join(found, "ref", "left").select("id", "arrived", "text", "states", "keys", "found").mapInArrow(_read(signs, with_text), "id long, arrived timestamp, cases array<struct<line_no:int,kind:string>>, repaired string")
    return latest(out, ["id"], "arrived").drop("arrived").withColumnRenamed("id", key)
