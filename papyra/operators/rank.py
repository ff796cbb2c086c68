"""TF-IDF relevance and graph-ranked summaries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.functions import text as T
from papyra.operators.common import stored

# Words that do not count.
STOP = "a about above after again all also am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it its itself just me more most my no nor not now of off on once only or other our out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with you your".split()


def term_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf)."""
    words = docs.select(key, F.explode(T.tokens(F.col(text))).alias("term")).where(~F.col("term").isin(STOP))
    return words.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(tf: DataFrame, n_docs: int, min_df: int = 2, max_df: float = 0.95, size: int = 10_000) -> DataFrame:
    """(term, df, total): at most ``size`` terms by total count, then by term."""
    v = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
    return v.orderBy(F.desc("total"), "term").limit(size)


def weights(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """((key, term, u), vocabulary): normalised TF-IDF weights. Term counts are stored, as vocabulary and weights both need them;
    the vocabulary is at most 10,000 terms, so the join with it may be broadcast by size."""
    n = docs.count()
    tf = stored(term_counts(docs, key, text), "terms")
    voc = stored(vocabulary(tf, n), "vocabulary")
    w = tf.join(voc, "term").select(key, "term", (F.col("tf") * (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0)).alias("w"))
    norm = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("u")), voc


def relevance(docs: DataFrame, key: str = "file_id", text: str = "body") -> DataFrame:
    """M1: (key, score), the cosine of each text's normalised TF-IDF vector with the mean vector, which has a row per term of the
    vocabulary; texts without its terms have 0, and all texts 1 where the vocabulary is empty."""
    n = docs.count()
    w, voc = weights(docs, key, text)
    if voc.isEmpty():
        return docs.select(key, F.lit(1.0).alias("score"))
    unit = stored(w, "weights")
    mean = unit.groupBy("term").agg((F.sum("u") / n).alias("c"))
    length = mean.agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("len"))
    dot = unit.join(mean, "term").groupBy(key).agg(F.sum(F.col("u") * F.col("c")).alias("dot"))
    scored = dot.join(F.broadcast(length)).select(key, (F.col("dot") / F.col("len")).alias("score"))
    return docs.select(key).join(scored, key, "left").select(key, F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"))


def _summary(text: str, n: int) -> str:
    import re

    ss = [s.strip() for s in re.split(r"(?<=[.!?。！？])\s+", text or "") if len(s.strip()) > 20]
    if len(ss) <= n:
        return " ".join(ss)
    words = [[w for w in re.findall(r"\w{2,}", s.lower()) if w not in _STOP] for s in ss]
    terms = {t: i for i, t in enumerate(sorted({w for ws in words for w in ws}))}
    m = np.zeros((len(ss), max(1, len(terms))))
    for i, ws in enumerate(words):
        for w in ws:
            m[i, terms[w]] += 1
    df = (m > 0).sum(0)
    m *= np.log((1 + len(ss)) / (1 + df)) + 1
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    s = m @ m.T
    out = s.sum(1, keepdims=True)
    p = np.where(out > 0, s / np.maximum(out, 1e-12), 1 / len(ss))
    r = np.full(len(ss), 1 / len(ss))
    for _ in range(100):
        new = 0.15 / len(ss) + 0.85 * r @ p
        if np.abs(new - r).sum() < 1e-6:
            break
        r = new
    return " ".join(ss[i] for i in sorted(np.argsort(-r, kind="stable")[:n]))


_STOP = set(STOP)


def summaries(docs: DataFrame, key: str, text: str, n: int = 5) -> DataFrame:
    """M2: (key, summary), the n best-ranked sentences in text order; a text of n sentences or fewer is kept whole."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: _summary(t, n))

    return docs.select(key, run(F.col(text)).alias("summary"))
