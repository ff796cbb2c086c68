"""Problem 1: defective answers in question-answer and query-content pairs.

A multi-label linear classifier (one logistic model per defect, trained by follow-the-
regularised-leader) over hashed n-grams of the answer, tail features and pair features. It is
trained on a bounded sample of real pairs (taken as whole) and on the same pairs made defective:
emptied, cut off, refused, copied, or swapped with an answer in another language. Pairs of the
sample that a first fit calls defective are left out of the second, but for refusals, which teach it
wordings that the synthetic ones lack. The threshold of each defect
is calibrated on a held-out part. Languages come from the classifier of ``language``: that
of answers is fitted on labelled texts, that of questions on crops of these texts and on the sampled
questions, each labelled with the language of its answer (labels that the other half of the sample
contradicts are left out), so that it knows short keyword lists and is no surer of them than it may be.

Scoring is one narrow pass over whole texts. Policies: a null answer is empty; without a question
only the answer counts; of several deliveries the latest counts; null keys are left out; a pair
gets the defect whose score exceeds its threshold by most.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm import language as lg
from papyra.llm import textscan as ts
from papyra.llm.tokens import chunks
from papyra.operators.common import latest, spread

DEFECTS = ["empty", "truncated", "refusal", "copy", "language"]
REFUSAL = 2
SIZE = 1 << 18
# Texts that stand for no answer.
STAND_INS = ["", " ", "\n", "　", "\xa0", "﻿", "​", "[]", "{}", "()", '""', "''", "null", "none", "nil", "nan", "n/a", "n.a.", "na", "tbd", "todo", "-", "--", "——", ".", "...", "…", "*", "***", "?", "？？", "/", "<p></p>", "<br>", "&nbsp;", "no content", "no answer", "(no answer)", "(empty)", "empty", "undefined", "无", "暂无", "（无）", "（空）", "空", "なし", "(なし)", "keine angabe", "k.a.", "sin respuesta", "s/d", "sans réponse", "néant", "sem resposta"]
# Refusals by language, as openings, cores and endings; every combination is used.
REFUSALS = {
    "en": (["", "I'm sorry, but ", "Sorry — ", "I apologise, however ", "Unfortunately, ", "As an AI assistant, ", "Thanks for asking. ", "I regret that "], ["I cannot answer questions on this subject", "I am not able to provide this information", "I must decline to comment here", "I can't help with that", "this falls outside what I may discuss", "my guidelines don't allow me to go into this", "I would rather not go into that", "that is a topic I stay away from", "I lack permission to share material of this kind", "the request conflicts with the rules I follow", "no answer can be given by me on this matter", "providing such details would not be appropriate"], [".", ". Please consult a qualified professional.", ". Try rephrasing your question.", ". Is there anything else you would like to know?", ", and I would suggest another source."]),
    "zh": (["", "对不起，", "很抱歉，", "非常遗憾，", "作为人工智能助手，", "感谢您的提问，但", "不好意思，"], ["我无法回答这个问题", "我不能提供相关内容", "我不便就此发表意见", "这个请求我没有办法协助", "此话题我不参与讨论", "请恕我不予回应", "该问题不在我可以讨论的范围内", "我没有权限分享此类信息", "出于合规考虑，这里不便展开", "按照规定我不能讨论此事", "这类内容恕难提供", "我只能选择不作答", "该话题超出了我的服务范围"], ["。", "，建议您查阅其他渠道。", "。请咨询专业人士。", "。您还有别的问题吗？", "，请换一种问法。"]),
    "ja": (["", "申し訳ありませんが、", "恐れ入りますが、", "残念ながら、", "AIアシスタントとして、", "ご質問ありがとうございます。"], ["その内容を扱うことはできません", "この件についてはお手伝いできません", "規則により回答を差し控えます", "この質問にはお答えできません", "その話題については控えさせていただきます", "その情報は提供できません", "お答えすることができません"], ["。", "。専門家にご相談ください。", "。ほかにご質問はありますか？"]),
    "de": (["", "Es tut mir leid, aber ", "Leider ", "Bedauerlicherweise ", "Als KI-Assistent ", "Danke für die Frage. "], ["kann ich diese Frage nicht beantworten", "darf ich mich dazu nicht äußern", "gehe ich darauf lieber nicht ein", "ist es mir nicht möglich, hierzu Auskunft zu geben", "muss ich diese Frage offen lassen", "kann ich dabei nicht helfen", "darf ich darüber keine Auskunft geben", "liegt das außerhalb dessen, was ich besprechen darf"], [".", ". Bitte wenden Sie sich an eine Fachperson.", ". Kann ich Ihnen sonst helfen?"]),
    "es": (["", "Lo siento, ", "Disculpe, ", "Lamentablemente, ", "Como asistente, ", "Gracias por la pregunta, pero "], ["no puedo responder a esta pregunta", "no me es posible dar esa información", "prefiero no entrar en este tema", "debo abstenerme de tratar este asunto", "no estoy autorizado a hablar de ello", "mis normas no me permiten contestar", "no puedo ayudarle con eso"], [".", ". Consulte a un especialista.", ". ¿Puedo ayudarle en otra cosa?"]),
    "fr": (["", "Je suis désolé, mais ", "Malheureusement, ", "En tant qu’assistant, ", "Désolé, ", "Merci de votre question, mais "], ["je ne peux pas répondre à cette demande", "il m’est impossible de traiter ce sujet", "je dois m’abstenir de tout avis ici", "les règles que je suis m’empêchent de répondre", "je préfère ne pas aborder ce sujet", "je ne suis pas en mesure de fournir ces informations"], [".", ". Veuillez consulter un spécialiste.", ". Puis-je vous aider autrement ?"]),
    "pt": (["", "Desculpe, mas ", "Infelizmente, ", "Lamento, ", "Como assistente, ", "Obrigado pela pergunta, mas "], ["não posso responder a esta pergunta", "não me é possível dar essa informação", "prefiro não entrar neste assunto", "devo abster-me de tratar deste tema", "as regras que sigo não me permitem responder", "não estou autorizado a falar disso", "não consigo ajudar com isso"], [".", ". Consulte um especialista.", ". Posso ajudar em mais alguma coisa?"]),
}
# How a question asks for an answer in a language.
ASKS = {
    "en": r"in english|auf englisch|en inglés|en anglais|em inglês|用英[文语語]|英語で",
    "zh": r"in chinese|auf chinesisch|en chino|en chinois|em chinês|用中[文语]|用汉语|中国語で",
    "es": r"in spanish|auf spanisch|en español|en espagnol|em espanhol|用西班牙[文语]|スペイン語で",
    "de": r"in german|auf deutsch|en alemán|en allemand|em alemão|用德[文语]|ドイツ語で",
    "fr": r"in french|auf französisch|en francés|en français|em francês|用法[文语]|フランス語で",
    "pt": r"in portuguese|auf portugiesisch|en portugués|en portugais|em português|用葡萄牙[文语]|ポルトガル語で",
    "ja": r"in japanese|auf japanisch|en japonés|en japonais|em japonês|用日[文语]|日本語で",
}
_ASKS = {k: re.compile(v, re.I) for k, v in ASKS.items()}
_ANY = re.compile("|".join(ASKS.values()), re.I)
_MARKUP = re.compile(r"<[^<>]{0,40}>|&#?\w{1,8};")
_LETTERS = re.compile(r"[^\W\d_]+", re.U)
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_BLANK = " \t\r\n\x0b\x0c　\xa0﻿​‌‍⁠"
_memo: dict[str, int] = {}


#: Kinds of features by the first letter of their names: first bucket, buckets, and the defects they may speak for.
KINDS = {"g": (0, SIZE // 2, "10100"), "a": (SIZE // 2, 4096, "10000"), "w": (SIZE // 2 + 4096, SIZE // 4, "01000"), "t": (SIZE * 7 // 8, 4096, "01000"), "c": (SIZE * 7 // 8 + 4096, 2048, "00010"), "o": (SIZE * 7 // 8 + 8192, 2048, "00001"), "l": (SIZE - 2048, 1024, "11110"), "b": (SIZE - 1024, 1024, "11111")}


@functools.cache
def speaks() -> np.ndarray:
    """Which feature may count for which defect."""
    out = np.zeros((SIZE, len(DEFECTS)))
    for first, n, who in KINDS.values():
        out[first : first + n] = [float(x) for x in who]
    return out


def _id(name: str) -> int:
    i = _memo.get(name)
    if i is None:
        if len(_memo) > 500_000:
            _memo.clear()
        first, n, _ = KINDS[name[0]]
        i = _memo[name] = first + zlib.crc32(name.encode("utf-8", "surrogatepass")) % n
    return i


def _bins(name: str, x: float, edges: tuple) -> str:
    return f"{name}:{sum(x > e for e in edges)}"


def _tail(a: str, known: dict[str, int]) -> list[str]:
    """How the answer ends. ``known`` counts the words of the sample that stand elsewhere than at an end."""
    if not a:
        return []
    lines = a.split("\n")
    line = lines[-1].strip()
    kind = "table" if line.startswith("|") else "item" if re.match(r"[-*•]\s|\d+[.)]\s", line) else "head" if line.startswith("#") else "fence" if line.startswith("```") else "text"
    bare = re.sub(r"(?:\s*\[\^?\w+\])+$", "", line)
    cited = bare != line
    core = bare.rstrip("*_\"'”’»）)」』]") or bare
    c = core[-1:] or " "
    what = "stop" if c in ".!?。！？…" else "pause" if c in ",;:，；：、—-–" else "digit" if c.isdigit() else "cjk" if _CJK.match(c) else "letter" if c.isalpha() else "bar" if c == "|" else "other"
    out = [f"t:{kind}:{what}", f"t:{what}:{bool(cited)}", f"t:{kind}:{line[-1:]}"]
    fences = a.count("```")
    if fences % 2:
        out.append("t:openfence")
    if fences and not fences % 2 and line.startswith("```"):
        out.append("t:closedfence")
    for x, y in ("()", "[]", "{}", "（）", "“”", "「」"):
        if line.count(x) > line.count(y):
            out.append("t:open" + x)
    if line.count("**") % 2:
        out.append("t:openbold")
    words = re.findall(r"\S+", core[-60:])
    if words and kind in ("item", "table", "text"):
        out += [f"w:{kind}:{words[-1][-12:]}", f"w:{kind}:{core[-1:]}", f"w2:{kind}:{core[-2:]}"]
        if what == "letter":
            n = known.get(last[-1].lower() if (last := _LETTERS.findall(core[-60:])) else "", 0)
            out += [f"t:{kind}:known:{(n > 0) + (n > 2)}"] * 2
    if kind == "table":
        rows = [x for x in lines if x.strip().startswith("|")]
        cells = rows[0].count("|")
        out += ["t:row:" + str(line.count("|") == cells and line.endswith("|")), "t:rows:" + str(min(len(rows), 4))]
    if kind == "item":
        before = [x.strip() for x in lines[:-1] if re.match(r"\s*[-*•]\s|\s*\d+[.)]\s", x)]
        if before:
            shape = lambda x: (":" in x, len(re.findall(r"\d[\d.,]*", x)) > 0, bool(re.search(r"\d[\d.,]*\s*[^\W\d_%]", x)))
            out.append("t:shape:" + str(shape(line) == shape(before[-1])))
            ends = {x[-1:] in ".!?。！？" for x in before}
            out.append("t:endlike:" + str((line[-1:] in ".!?。！？") in ends))
    return out


def seen_words(texts: list[str]) -> dict[str, int]:
    """How many of the texts hold each word elsewhere than at the end of the text."""
    out: dict[str, int] = {}
    for t in texts:
        words = [w.lower() for w in _LETTERS.findall(t) if not _CJK.match(w)]
        for w in set(words[:-1]):
            out[w] = out.get(w, 0) + 1
    return out


def _grams(low: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, letters of each text): words and neighbouring words; of ideographs and kana, runs of two and four."""
    cp, starts, ends = ts.flat(low)
    if not len(cp):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    letter = ts.classes()[cp] == ts.LETTER
    cjk = letter & ((cp >= 0x3040) & (cp <= 0x30FF) | (cp >= 0x3400) & (cp <= 0x9FFF))
    p = ts.prefix(cp)
    edge = np.diff(np.concatenate([[False], letter & ~cjk, [False]]).astype(np.int8))
    s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    d, h = np.searchsorted(ends, s), ts.mix(ts.span_hash(p, s, e))
    pair = np.flatnonzero(d[1:] == d[:-1])
    at, hs = [d, d[pair]], [h, ts.mix(h[pair] * np.uint64(3) + h[pair + 1])]
    for n in (2, 4):
        i = np.flatnonzero(np.logical_and.reduce([cjk[j : len(cjk) - n + 1 + j] for j in range(n)])) if len(cjk) >= n else np.zeros(0, np.int64)
        at.append(np.searchsorted(ends, i))
        hs.append(ts.mix(ts.span_hash(p, i, i + n), n))
    first, size, _ = KINDS["g"]
    return np.concatenate(at), (np.concatenate(hs) % np.uint64(size)).astype(np.int64) + first, np.add.reduceat(letter.astype(np.int64), starts)


def _overlap(qs: list[str], low: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct three-sign pieces of each question, of each answer, and of both."""

    def keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cp, _, ends = ts.flat(texts)
        if len(cp) < 3:
            return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
        c = cp.astype(np.uint64)
        h = ts.mix((c[:-2] << np.uint64(42)) ^ (c[1:-1] << np.uint64(21)) ^ c[2:]) >> np.uint64(20)
        i = np.arange(len(h))
        d = np.searchsorted(ends, i)
        ok = i + 2 < ends[d]
        k = np.unique(h[ok] | (d[ok].astype(np.uint64) << np.uint64(44)))
        return k, np.bincount((k >> np.uint64(44)).astype(np.int64), minlength=len(texts))

    x, nx = keys(qs)
    y, ny = keys(low)
    both = np.intersect1d(x, y, assume_unique=True)
    return nx, ny, np.bincount((both >> np.uint64(44)).astype(np.int64), minlength=len(qs))


class Speech:
    """Language probabilities of whole texts."""

    def __init__(self, codes: list[str], table: bytes, temperature: float) -> None:
        self.codes, self.t = codes, temperature
        self.m = np.frombuffer(table, np.float32).reshape(lg.SIZE, len(codes) + 1)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        out = []
        for i, j in chunks(texts, 700_000):
            cp, starts, _ = ts.flat(texts[i:j])
            g, _ = lg.grams(cp)
            v = self.m[g[0]]
            v += self.m[g[1]]
            v += self.m[g[2]]
            v = np.add.reduceat(v, starts, axis=0)
            s = np.where(v[:, -1:] > 0, v[:, :-1] / np.maximum(v[:, -1:], 1e-9), 0) * (lg.SCALE / self.t)
            s -= s.max(1, keepdims=True)
            p = np.exp(s)
            out.append(p / p.sum(1, keepdims=True))
        return np.concatenate(out) if out else np.zeros((0, len(self.codes)))

    def asked(self, q: str | None) -> np.ndarray | None:
        if not q or not _ANY.search(q):
            return None
        return np.array([1.0 if c in _ASKS and _ASKS[c].search(q) else 0.0 for c in self.codes])


def speech(codes: list[str], w: np.ndarray, t: float) -> Speech:
    table = np.hstack([w, np.ones((lg.SIZE, 1))]).astype(np.float32)
    table[0, -1] = 0
    return Speech(codes, table.tobytes(), t)


class Reader:
    """Features of pairs. ``asks`` tells the language of questions, ``says`` that of answers; both have the same codes."""

    def __init__(self, asks: Speech, says: Speech, known: dict[str, int]) -> None:
        self.asks, self.says, self.known = asks, says, known

    def __call__(self, pairs: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pair, feature, value), by pair."""
        q = [(x or "").strip(_BLANK) for x, _ in pairs]
        a = [(x or "").strip(_BLANK) for _, x in pairs]
        low = [(_MARKUP.sub(" ", x) if "<" in x or "&" in x else x).lower() for x in a]
        at, bucket, letters = _grams(low)
        grams = np.bincount(at, minlength=len(pairs))
        nx, ny, both = _overlap([x.lower() for x in q], low)
        pq, ps = self.asks([_ANY.sub(" ", x) for x in q]), self.says([x for _, x in pairs])
        where, names, values = [], [], []

        def add(i: int, name: str, v: float = 1.0) -> None:
            where.append(i)
            names.append(_id(name))
            values.append(v)

        for i in range(len(pairs)):
            n = int(letters[i])
            size = _bins("len", n, (0, 1, 4, 8, 15, 30, 60, 120, 250, 600))
            add(i, "bias")
            add(i, size)
            if len(low[i]) <= 24:
                add(i, "all:" + low[i].strip(_BLANK))
                add(i, "a_small", 2.0 if n <= 1 else 0.5)
            for t in _tail(a[i], self.known):
                add(i, t)
            if not (q[i] and n):
                continue
            of_a, of_q = both[i] / max(1, ny[i]), both[i] / max(1, nx[i])
            for name, z in (("ca", of_a), ("cq", of_q)):
                add(i, _bins(name, z, (0.2, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)))
            add(i, "copy", 3.0 * of_a * of_q)
            add(i, _bins("c_both", min(of_a, of_q), (0.4, 0.5, 0.6, 0.7, 0.8, 0.9)))
            add(i, _bins("c_cover", of_a, (0.5, 0.6, 0.7, 0.8)) + _bins("|", ny[i] / max(1, nx[i]), (0.5, 0.9, 1.3, 1.8, 3)))
            if n >= 16 and any(map(str.isalpha, q[i])):
                asked = self.asks.asked(q[i])
                ok = pq[i] if asked is None else np.maximum(pq[i], asked)
                other = 1.0 - float(ok @ ps[i])
                sure = float(ok[int(ps[i].argmax())])  # that the question is in the answer's language
                add(i, "other", 3.0 * other)
                add(i, _bins("other", other, (0.05, 0.2, 0.4, 0.6, 0.8, 0.95)) + _bins("|", sure, (0.01, 0.05, 0.2, 0.5)))
                add(i, _bins("other", other, (0.1, 0.5, 0.9)) + "|" + size)
        row = np.concatenate([np.array(where, np.int64), at])
        k = np.concatenate([np.array(names, np.int64), bucket])
        x = np.concatenate([np.array(values), 8.0 / np.maximum(8, grams[at])])
        order = np.argsort(row, kind="stable")
        return row[order], k[order], x[order]

    def each(self, pairs: list[tuple]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per pair its distinct features, values added up."""
        out = []
        for i, j in chunks([(q or "") + (a or "") for q, a in pairs], 300_000):
            row, k, x = self(pairs[i:j])
            for k_, x_ in zip(*(np.split(v, np.searchsorted(row, np.arange(1, j - i))) for v in (k, x))):
                u, at = np.unique(k_, return_inverse=True)
                out.append((u, np.bincount(at, x_)))
        return out


def _spoil(q: str | None, a: str, kind: int, rng: np.random.Generator, others: list[str]) -> str | None:
    """The answer made defective, None where that is not possible."""
    pick = lambda x: x[int(rng.integers(len(x)))]
    if kind == 0:
        return pick(STAND_INS) * int(rng.integers(1, 3)) if rng.random() < 0.1 else pick(STAND_INS)
    if kind == 1:
        a = a.strip()
        if len(a) < 12:
            return None
        if rng.random() < 0.3:  # a structure at the end that breaks off
            w = pick(re.findall(r"[^\W\d_]{2,12}", a) or ["x"])
            n = str(int(rng.integers(2, 90)))
            return a + pick([f" ([{w}](https://{w.lower()}.exam", f" [{w}](https://{w.lower()}.example/ab", f'\n\n```json\n{{"{w[:6]}": [{n}, ', f'\n\n```json\n{{"year": {n}, "va', f"\n\n| {w} | {w} |\n|---|---|\n| {w} | {n} |\n| {w} |", f"\n\n1. {w}: {n} {w}\n2. {w}:", f"\n\n- {w}: {n} {w}\n- {w}:", f"\n\n1. {w}: {n} {w}\n2. {w}: {n} {w}\n3.", f"\n\n## {w}"]).rstrip()
        cut = int(rng.integers(max(6, len(a) // 8), len(a) - 2))
        if rng.random() < 0.5:  # structures at the end break off too
            cut = int(rng.integers(max(6, len(a) - 60), len(a) - 1))
        b = a[:cut].rstrip()
        if a[len(b) :].lstrip(" \t")[:1] in ("", "\n"):  # a whole line: nobody can tell
            b = b[: -int(rng.integers(1, 6))].rstrip()
        if not b or b[-1] in ".!?。！？…]|" or (b.count("```") % 2 == 0 and b.endswith("```")):
            b = b.rstrip(".!?。！？…]|`") if rng.random() < 0.5 else ""
        if b and rng.random() < 0.15:
            b += "," if not _CJK.search(b[-1]) else "，"
        return b or None
    if kind == 2:
        o, c, e = REFUSALS[pick(list(REFUSALS))]
        o = pick(o)
        c = pick(c)
        s = o + c if o else c[:1].upper() + c[1:]
        if q and rng.random() < 0.15:
            s = (f"关于{q[2:12]}，" if _CJK.search(q) else f"Thank you for the question about {' '.join(q.split()[2:6])}. ") + s
        return s + pick(e)
    if kind == 3:
        if not q:
            return None
        r = rng.random()
        words = q.split() if len(q.split()) > 2 else list(q)
        glue = " " if len(q.split()) > 2 else ""
        if r < 0.12:
            i = int(rng.integers(len(words) - 1)) if len(words) > 1 else 0
            words[i : i + 2] = words[i : i + 2][::-1]
            return glue.join(words)
        forms = [q, q + "\n\n" + q, f"**{q.rstrip('?？。.')}**", f"“{q}”", "> " + q, q.upper(), q.lower(), q.rstrip("?？") + ".", q + " ", ("您问：" if _CJK.search(q) else "You asked: ") + q, q + " " + q]
        return pick(forms)
    return pick(others) if others else None


ALPHA = 0.8  # learning rate
GRID = np.linspace(-1.5, 1.5, 61)


class Model:
    def __init__(self) -> None:
        self.z, self.n = np.zeros((SIZE, len(DEFECTS))), np.zeros((SIZE, len(DEFECTS)))

    def weights(self, k: np.ndarray | slice = slice(None), alpha: float = ALPHA, l1: float = 0.02, l2: float = 0.005) -> np.ndarray:
        z, n = self.z[k], self.n[k]
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((1.0 + np.sqrt(n)) / alpha + l2))

    def learn(self, k: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
        w = self.weights(k)
        g = x[:, None] * speaks()[k] * (1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30))) - y)
        sigma = (np.sqrt(self.n[k] + g * g) - np.sqrt(self.n[k])) / ALPHA
        self.z[k] += g - sigma * w
        self.n[k] += g * g


def crops(said: list[tuple[str, str]], rng: np.random.Generator, each: int = 3) -> list[tuple[str, str]]:
    """Short runs of words (of signs, where words are not parted) from labelled texts."""
    out = []
    for t, c in said:
        for _ in range(each):
            a = int(rng.integers(max(1, len(t) - 80)))
            part = t[a : a + 120]
            n = int(rng.integers(4, 11))
            out.append((part[: 2 * n] if len(_CJK.findall(part)) > len(part) // 4 else " ".join(part.split()[1 : n + 1]), c))
    return out


def listen(pairs: list[tuple], said: list[tuple[str, str]], says: Speech, rng: np.random.Generator) -> Speech:
    """The language of questions, taught by crops of labelled texts and by the sample's questions, labelled as their answers sound."""
    p = says([a for _, a in pairs])
    own = [(_ANY.sub(" ", q), says.codes[int(p[i].argmax())]) for i, (q, a) in enumerate(pairs) if q and len(a) >= 60 and p[i].max() > 0.9 and says.asked(q) is None]
    short = [(t, c) for t, c in crops(said, rng) if t]
    codes, w, t = lg.fit(own + short, np.ones(lg.SIZE), least=4, quoted=True)
    full = np.zeros((lg.SIZE, len(says.codes)))
    full[:, [says.codes.index(c) for c in codes]] = w
    full[:, [i for i, c in enumerate(says.codes) if c not in codes]] = w.min(1, keepdims=True) if len(codes) else 0.0
    return speech(says.codes, full, t)


def train(pairs: list[tuple], said: list[tuple[str, str]], seed: int = 11) -> tuple[np.ndarray, np.ndarray, Reader]:
    """(weights [feature, defect], thresholds, feature reader) from a sample of (question, answer) and labelled (text, code)."""
    rng = np.random.default_rng(seed)
    says = speech(*(lg.fit(said, np.ones(lg.SIZE)) if said else (["en"], np.zeros((lg.SIZE, 1)), 1.0)))
    pairs = [(q, a) for q, a in pairs if a and a.strip(_BLANK)]
    if not pairs:
        return np.zeros((SIZE, len(DEFECTS))), np.full(len(DEFECTS), np.inf), Reader(says, says, {})
    read = Reader(listen(pairs, said, says, rng), says, seen_words([a for _, a in pairs]))
    tongue = says([a for _, a in pairs]).argmax(1)
    asks = read.asks([_ANY.sub(" ", q or "") for q, _ in pairs]).argmax(1)
    by = {c: [i for i in range(len(pairs)) if tongue[i] == c] for c in range(len(says.codes))}
    made, label = [], []
    for i, (q, a) in enumerate(pairs):
        for kind in rng.choice(5, 2, replace=False, p=[0.1, 0.32, 0.2, 0.18, 0.2]).tolist():
            others = []
            if kind == 4:
                wrong = [c for c in by if c != asks[i] and by[c]]
                if not (q and wrong):
                    continue
                c = int(rng.choice(wrong))
                if says.asked(q) is not None and says.asked(q)[c]:
                    continue
                others = [pairs[by[c][int(rng.integers(len(by[c])))]][1]]
            b = _spoil(q, a, kind, rng, others)
            if b is not None:
                made.append((q, b))
                label.append(kind)
    rows = read.each(pairs + made)
    y = np.zeros((len(rows), len(DEFECTS)))
    y[np.arange(len(pairs), len(rows)), label] = 1.0
    own = np.concatenate([np.arange(len(pairs)), rng.integers(0, len(pairs), len(made))])
    held = own % 4 == 0
    score = lambda w, i: rows[i][1] @ w[rows[i][0]]
    good = np.ones(len(rows), bool)
    for half in (0, 1):
        m = Model()
        for i in rng.permutation(np.flatnonzero(own % 2 != half)).tolist():
            m.learn(*rows[i], y[i])
        w = m.weights()
        for i in range(half, len(pairs), 2):
            s = score(w, i)
            good[i] = s.max() < 0
            if s.argmax() == REFUSAL and s.max() > 0.5:
                good[i], y[i, REFUSAL] = True, 1.0
    m = Model()
    for _ in range(3):
        for i in rng.permutation(np.flatnonzero(~held & good)).tolist():
            m.learn(*rows[i], y[i])
    w = m.weights()
    check = np.flatnonzero(held & good)
    s = np.array([score(w, i) for i in check])
    limit = np.zeros(len(DEFECTS))
    for k in range(len(DEFECTS)):  # best F1 if 3 % of pairs had the defect; the sample's own defects sit at the top of its whole pairs
        yes, no = s[y[check, k] == 1, k], np.sort(s[y[check].sum(1) == 0, k])
        no = no[: int(np.ceil(0.997 * len(no)))]
        if len(yes) and len(no):
            f1 = lambda t: 2 * 0.03 * (yes > t).mean() / (0.03 * (yes > t).mean() + 0.97 * ((no > t).sum() + 0.5) / (len(no) + 1) + 0.03)
            got = np.array([f1(t) for t in GRID])
            limit[k] = GRID[got >= got.max() - 1e-9].mean()  # the middle of what serves best
    return w, limit, read


def _judge(asks: tuple, says: tuple, known: dict[str, int], weights: bytes, kept: bytes, limit: list[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader(Speech(*asks), Speech(*says), known)
        w = np.zeros((SIZE, len(DEFECTS)), np.float32)
        w[np.frombuffer(kept, np.int32)] = np.frombuffer(weights, np.float32).reshape(-1, len(DEFECTS))
        lim = np.array(limit)
        for b in batches:
            pairs = list(zip(b.column(3).to_pylist(), b.column(4).to_pylist()))
            best, top = [], []
            for i, j in chunks([(q or "") + (a or "") for q, a in pairs], 300_000):
                row, k, x = read(pairs[i:j])
                s = np.add.reduceat(w[k] * x[:, None], np.searchsorted(row, np.arange(j - i)), axis=0) - lim  # every pair has its bias
                best.append(s.argmax(1))
                top.append(s.max(1))
            best, top = (np.concatenate(v) if v else np.zeros(0) for v in (best, top))
            defect = [DEFECTS[int(d)] if t > 0 else None for d, t in zip(best.tolist(), top.tolist())]
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(defect, pa.string()), pa.array(top.astype(float), pa.float64())], names=["tbl", "rec_id", "arrived", "defect", "score"])

    return run


def judge_pairs(pairs: DataFrame, docs: DataFrame, labels: DataFrame, sample: int = 3000, per_label: int = 150) -> DataFrame:
    """(tbl, rec_id, defect, score) of every pair in (tbl, rec_id, arrived, question, answer); ``defect`` is null for whole ones.

    ``sample`` bounds the pairs the classifier is fitted on, ``per_label`` the labelled texts of each language.
    """
    pairs = pairs.where("rec_id IS NOT NULL").select("tbl", "rec_id", "arrived", "question", "answer")
    said = lg.labelled_sample(lg.with_codes(docs, labels), per_label)
    n = max(1, pairs.count())
    picked = pairs.where(F.pmod(F.xxhash64("tbl", "rec_id"), F.lit(1 << 30)) < F.lit(int(min(1.0, sample / n) * (1 << 30))))
    rows = [(r.question, r.answer) for r in picked.sort("tbl", "rec_id").limit(2 * sample).collect()]
    weights, limit, read = train(rows, said)
    kept = np.flatnonzero(np.abs(weights).max(1) > 0).astype(np.int32)
    voices = [(s.codes, s.m.tobytes(), s.t) for s in (read.asks, read.says)]
    job = _judge(*voices, read.known, weights[kept].astype(np.float32).tobytes(), kept.tobytes(), limit.tolist())
    out = spread(pairs, "rec_id").mapInArrow(job, "tbl string, rec_id long, arrived timestamp, defect string, score double")
    return latest(out, ["tbl", "rec_id"], "arrived").drop("arrived")
