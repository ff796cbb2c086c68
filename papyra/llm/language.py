"""Problem 9: the language of every text and of the paragraphs of mixed texts.

Sparse multinomial logistic regression on TF-IDF character n-grams (n = 1, 2, 3, hashed),
trained by follow-the-regularised-leader with an elastic-net penalty, confidences calibrated by
one temperature.

* Document frequencies of the n-grams are counted over all texts (one map-side-combined sum).
* The classifier is fitted on a bounded sample of labelled texts: about ``per_label`` texts of each
  code, chosen by a hash of the id; labels that the first fit contradicts are left out of the second.
* Scoring is one narrow pass; no text is shuffled.

Policies: a paragraph lies between blank lines (``\\n\\n``); quoted spans do not count while the rest
has words; a paragraph without words, or of web addresses only, has no language of its own; a short
paragraph takes another language than the text's main one only at high confidence. Null, empty and
wordless texts have no main language. Rows that repeat an id are judged each for itself.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm import textscan as ts
from papyra.llm.tokens import chunks
from papyra.operators.common import spread

BITS = 15
SIZE = 1 << BITS
# Not language: web addresses, footnote marks, code fences, inline code.
_NOISE = re.compile(r"\[\^[^\]]*\]:[^\n]*|https?://\S+|\[\^[^\]]*\]|```.*?(?:```|\Z)|`[^`\n]*`|\b[\w.-]+@[\w.-]+", re.S)
_QUOTED = re.compile(r"“[^”]{12,}”|«[^»]{12,}»|„[^“”]{12,}[“”]|「[^」]{8,}」|『[^』]{8,}』|‘[^’]{12,}’|\"[^\"\n]{12,}\"|‹[^›]{12,}›")


@functools.cache
def folds() -> np.ndarray:
    """Lower-case code point of letters and marks, blank for all else."""
    import unicodedata

    out = np.full(0x110000, 32, np.uint32)
    for i in np.flatnonzero(ts.classes() == ts.LETTER).tolist():
        low = chr(i).lower() if i < 0x3000 or i > 0xF000 else chr(i)
        out[i] = ord(low) if len(low) == 1 else i
    for i in range(0x300, 0x3100):
        if unicodedata.category(chr(i))[0] == "M":
            out[i] = i
    return out


def grams(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 1-, 2- and 3-grams that start at each position (3 rows, 0: none); which positions are letters."""
    f = folds()[cp]
    letter = f != 32
    g = np.zeros((3, len(f)), np.int32)
    h = f * np.uint32(0x9E3779B1)
    shift = np.uint32(32 - BITS)
    both = np.zeros(len(f), bool)
    both[:-1] = letter[:-1] | letter[1:]
    g[0] = np.where(letter, (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77) >> shift, 0)
    h2 = h.copy()
    h2[:-1] += f[1:] * np.uint32(0xC2B2AE3D)
    g[1] = np.where(both, ((h2 ^ (h2 >> np.uint32(15))) * np.uint32(0x27D4EB2F)) >> shift, 0)
    h3 = h2
    h3[:-2] = (h3[:-2] << np.uint32(5)) + h3[:-2] + f[2:] * np.uint32(0x165667B1)
    g[2] = np.where(both, ((h3 ^ (h3 >> np.uint32(13))) * np.uint32(0x9E3779B1)) >> shift, 0)
    return g, letter


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(SIZE, np.int64), 0
    for b in batches:
        texts = b.column(0).to_pylist()
        for i, j in chunks(texts):
            cp, starts, ends = ts.flat(texts[i:j])
            g, _ = grams(cp)
            for a, z in zip(starts.tolist(), ends.tolist()):
                if z > a:
                    df += np.bincount(g[:, a:z].ravel(), minlength=SIZE) > 0
                    n += 1
    df[0] = n
    yield pa.record_batch([pa.array(np.arange(SIZE)), pa.array(df)], names=["bucket", "n"])


def paragraphs(text: str | None) -> list[str]:
    """The paragraphs as they are scored: noise and quotations blanked."""
    out = []
    for p in (text or "").split("\n\n"):
        if ":" in p or "`" in p or "[^" in p or "@" in p:
            p = _NOISE.sub(" ", p)
        q = _QUOTED.sub(" ", p)
        if q is not p and sum(map(str.isalpha, q)) >= 8:
            p = q
        out.append(p)
    return out


def _bag(pars: list[str], idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    cp, starts, ends = ts.flat(pars)
    g, _ = grams(cp)
    out = []
    for a, z in zip(starts.tolist(), ends.tolist()):
        k, n = np.unique(g[:, a:z], return_counts=True)
        w = n * idf[k]
        total = w.sum()
        out.append((k, w / total) if total > 0 else (k[:0], w[:0]))
    return out


class Ftrl:
    """Multinomial logistic regression, FTRL-proximal: per-coordinate rates, L1 and L2 penalties."""

    def __init__(self, classes: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.002, l2: float = 0.02) -> None:
        self.z, self.n = np.zeros((SIZE, classes)), np.zeros((SIZE, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, k: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[k], self.n[k]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, k: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(k)
        s = x @ w * SCALE
        p = np.exp(s - s.max())
        p /= p.sum()
        p[y] -= 1.0
        g = x[:, None] * (p * SCALE)
        sigma = (np.sqrt(self.n[k] + g * g) - np.sqrt(self.n[k])) / self.alpha
        self.z[k] += g - sigma * w
        self.n[k] += g * g


SCALE = 10.0  # the L1-normalised TF-IDF vectors are short; this keeps the weights of a workable size


def fit(sample: list[tuple[str, str]], idf: np.ndarray, per_text: int = 12, seed: int = 7, least: int = 10, quoted: bool = False) -> tuple[list[str], np.ndarray, float]:
    """(codes, weights [bucket, code], temperature) from (text, code) pairs; ``quoted`` texts are taken as they are, those of under ``least`` letters not."""
    rng = np.random.default_rng(seed)
    codes = sorted({c for _, c in sample})
    at = {c: i for i, c in enumerate(codes)}
    bags, ys, owner = [], [], []
    for d, (text, c) in enumerate(sample):
        pars = [p for p in ([text] if quoted else paragraphs(text)) if sum(map(str.isalpha, p)) >= least][:per_text]
        got = [b for b in _bag(pars, idf) if len(b[0])] if pars else []
        bags += got
        ys += [at[c]] * len(got)
        owner += [d] * len(got)
    if not bags:
        return codes, np.zeros((SIZE, len(codes))), 1.0
    y, own = np.array(ys), np.array(owner)
    side = rng.integers(0, 10, len(sample))[own]  # texts go to halves and to the held-out part by chance
    held = side < 2
    score = lambda w, i: bags[i][1] @ w[bags[i][0]] * SCALE

    def train(rows: np.ndarray, epochs: int) -> np.ndarray:
        m = Ftrl(len(codes))
        for _ in range(epochs):
            for i in rng.permutation(rows).tolist():
                m.learn(*bags[i], int(y[i]))
        return m.weights()

    good = np.zeros(len(bags), bool)
    for half in (0, 1):  # each half is judged by what the other half teaches: no label vouches for itself
        other = train(np.flatnonzero(side % 2 != half), 1)
        for i in np.flatnonzero(side % 2 == half).tolist():
            s = score(other, i)
            good[i] = s.argmax() == y[i] or s.max() - s[y[i]] < 0.7
    w = train(np.flatnonzero(~held & good), 2)
    check = np.flatnonzero(held & good)
    if not len(check):
        return codes, w, 1.0
    s = np.array([score(w, i) for i in check])

    def loss(t: float) -> float:
        q = s / t
        q = q - q.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(q).sum(1)) - q[np.arange(len(q)), y[check]]))

    return codes, w, min(np.geomspace(0.05, 5.0, 60), key=loss)


def _score(codes: list[str], table: bytes, temperature: float, sure: float, short: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.frombuffer(table, np.float32).reshape(SIZE, len(codes) + 1)
        for b in batches:
            ids, texts, said = (b.column(i).to_pylist() for i in range(3))
            out: list[tuple] = []
            for i, j in chunks(texts, 700_000):
                pars, sizes = [], []
                for t in texts[i:j]:
                    p = paragraphs(t)
                    pars += p
                    sizes.append(len(p))
                cp, starts, ends = ts.flat(pars)
                g, letter = grams(cp)
                v = m[g[0]]
                v += m[g[1]]
                v += m[g[2]]
                v = np.add.reduceat(v, starts, axis=0)
                n_letters = np.add.reduceat(letter.astype(np.int32), starts)
                total = v[:, -1:]
                s = np.where(total > 0, v[:, :-1] / np.maximum(total, 1e-9), 0) * (SCALE / temperature)
                s -= s.max(1, keepdims=True)
                p = np.exp(s)
                p /= p.sum(1, keepdims=True)
                best, conf = p.argmax(1), p.max(1)
                first = 0
                for d, k in zip(range(i, j), sizes):
                    a, z = first, first + k
                    first = z
                    n, q = n_letters[a:z], p[a:z]
                    if n.sum() < 2:
                        continue
                    size = np.where(n > 0, ends[a:z] - starts[a:z], 0)
                    chars = np.zeros(len(codes))
                    np.add.at(chars, best[a:z], size)
                    main = int(chars.argmax())
                    lang = best[a:z].copy()
                    plain = np.array([not q.lstrip().startswith("|") for q in pars[a:z]])
                    weak = conf[a:z] < np.where(plain & (n >= short), 0.7, sure)
                    lang[weak | (n < 4)] = main
                    if weak.any():
                        chars = np.zeros(len(codes))
                        np.add.at(chars, lang, size)
                        main = int(chars.argmax())
                    c_main = float((q[:, main] * n).sum() / n.sum())
                    spoken = n >= 4
                    mixed = len(set(lang[spoken].tolist())) > 1
                    out.append((ids[d], -1, codes[main], c_main, mixed, said[d]))
                    if mixed:
                        out += [(ids[d], x, codes[lang[x]], float(q[x, lang[x]]), True, said[d]) for x in np.flatnonzero(spoken).tolist()]
            cols = list(zip(*out)) or [[]] * 6
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.bool_(), pa.string()))], names=["doc_id", "seg", "lang", "confidence", "mixed", "said"])

    return run


def labelled_sample(src: DataFrame, per_label: int) -> list[tuple[str, str]]:
    """About ``per_label`` (text, code) pairs of each code from (doc_id, text, said), chosen by a hash of the id; never more than twice that."""
    ok = src.where("said IS NOT NULL AND text <> ''")
    counts = {r.said: r["count"] for r in ok.groupBy("said").count().collect()}  # one row per code of the label table
    share = F.lit(0.0)
    for c, k in counts.items():
        share = F.when(F.col("said") == c, F.lit(min(1.0, per_label / k))).otherwise(share)
    picked = ok.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    return [(r.text, r.said) for r in picked.select("doc_id", "text", "said").sort("doc_id").limit(2 * per_label * max(1, len(counts))).collect()]


def with_codes(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, text, said): ``said`` is the code that the label stands for, null where it is missing or unknown."""
    names = labels.groupBy(F.col("label").alias("_l")).agg(F.min("code").alias("said"))
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("_l")).join(names, "_l", "left").drop("_l")


def identify_languages(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_label: int = 400, sure: float = 0.9, short: int = 30) -> DataFrame:
    """(key, seg, lang, confidence, mixed, said): per text a row with seg -1, per mixed text one for each paragraph with words.

    ``said`` is the code its label stands for, null where the label is missing or unknown.
    """
    spark = docs.sparkSession
    src = spread(with_codes(docs, labels, key, text, lang), "doc_id")
    df = src.select("text").where("text <> ''").mapInArrow(_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # SIZE rows at most
    n = np.zeros(SIZE)
    n[df["bucket"].to_numpy()] = df["n"].to_numpy()
    idf = np.log((1 + n[0]) / (1 + n)) + 1
    idf[0] = 0
    sample = labelled_sample(src, per_label)
    if not sample:
        return spark.createDataFrame([], f"{key} long, seg int, lang string, confidence double, mixed boolean, said string")
    codes, w, t = fit(sample, idf)
    table = np.hstack([w * idf[:, None], idf[:, None]]).astype(np.float32).tobytes()
    out = src.select("doc_id", "text", "said").mapInArrow(_score(codes, table, t, sure, short), "doc_id long, seg int, lang string, confidence double, mixed boolean, said string")
    return out.withColumnRenamed("doc_id", key)


def wrong_or_mixed(found: DataFrame) -> DataFrame:
    """The rows whose label is missing or contradicted, and the paragraphs of mixed texts."""
    return found.where("seg >= 0 OR said IS NULL OR said <> lang")
