"""M3: grouping of texts by k-means on TF-IDF vectors, the number of groups by silhouette.

All numbers of groups and all starts are improved together: a round reads the stored vectors once, each task sums up its
part for every centre, and the sums (at most centres times terms) make the next centres. So rounds, and not starts
times numbers of groups, are the passes over the data; one more pass gives the silhouette of every number of groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.operators import rank
from papyra.operators.common import stored

POOL = 1000  # texts among which starts are chosen
CHUNK = 20_000  # terms of a chunk: bounds the arrays of a task


class Groups:
    """Centres of several clusterings side by side: ``spans`` gives the rows of each."""

    def __init__(self, centres: np.ndarray, spans: list[tuple[int, int]]) -> None:
        self.c, self.spans = centres, spans
        self.norm = (centres * centres).sum(1)

    def only(self, which: list[int]) -> tuple[Groups, np.ndarray]:
        """Some of the clusterings, and the rows of their centres."""
        rows = np.concatenate([np.arange(*self.spans[i]) for i in which])
        at = np.cumsum([0, *(self.spans[i][1] - self.spans[i][0] for i in which)]).tolist()
        return Groups(self.c[rows], list(zip(at, at[1:]))), rows

    def near(self, idx: np.ndarray, val: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centre of each text in each clustering, squared distances to all centres); texts are parts of (idx, val) between cuts."""
        n = np.diff(cuts)
        dot = np.zeros((len(n), len(self.c)), np.float32)
        square = np.zeros(len(n), np.float32)
        some = np.flatnonzero(n)
        if len(some):
            dot[some] = np.add.reduceat(self.c.T[idx] * val[:, None], cuts[some], axis=0)
            square[some] = np.add.reduceat(val * val, cuts[some])
        far = np.maximum(square[:, None] - 2 * dot + self.norm, 0)
        return np.stack([a + far[:, a:z].argmin(1) for a, z in self.spans], 1), far


def _parts(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of texts of about CHUNK terms: (batch, first, last, term numbers, weights, cuts)."""
    for b in batches:
        lists = b.column(at)
        offs = lists.offsets.to_numpy().astype(np.int64)
        idx, val = lists.values.to_numpy(zero_copy_only=False), b.column(at + 1).values.to_numpy(zero_copy_only=False).astype(np.float32)
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + CHUNK, "right")) - 1)
            j = min(j, b.num_rows)
            yield b, i, j, idx[offs[i] : offs[j]], val[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            i = j


def _sums(g: Groups, terms: int):
    """Sums of texts by (centre, term), then how many texts each centre has (term -1) and their squared distances (term -2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count, error = np.zeros(len(g.c) * terms), np.zeros(len(g.c)), np.zeros(len(g.c))
        for _, _, _, idx, val, cuts in _parts(batches, 0):
            best, far = g.near(idx, val, cuts)
            row = np.repeat(np.arange(len(best)), np.diff(cuts))
            for k, (a, z) in enumerate(g.spans):
                total[a * terms : z * terms] += np.bincount((best[row, k] - a) * terms + idx, val, (z - a) * terms)
                count += np.bincount(best[:, k], minlength=len(g.c))
                error += np.bincount(best[:, k], far[np.arange(len(best)), best[:, k]], len(g.c))
        i = np.flatnonzero(total)
        m = np.arange(len(g.c))
        centre, term, v = np.concatenate([i // terms, m, m]), np.concatenate([i % terms, m * 0 - 1, m * 0 - 2]), np.concatenate([total[i], count, error])
        for a in range(0, len(v), 100_000):
            yield pa.record_batch([pa.array(x[a : a + 100_000]) for x in (centre, term, v)], names=["centre", "term", "v"])

    return run


def _gathered(x: DataFrame, g: Groups, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sums, counts, errors) of all texts: at most centres times terms numbers."""
    t = x.select("idx", "val").mapInArrow(_sums(g, terms), "centre long, term long, v double").groupBy("centre", "term").agg(F.sum("v").alias("v")).toArrow()
    centre, term, v = (t.column(c).to_numpy() for c in ("centre", "term", "v"))
    out = np.zeros((len(g.c), terms + 2))
    out[centre, np.where(term < 0, terms - 1 - term, term)] = v
    return out[:, :terms], out[:, terms], out[:, terms + 1]


def _starts(pool: list[tuple[np.ndarray, np.ndarray]], terms: int, spans: list[tuple[int, int]], seed: int) -> np.ndarray:
    """Texts of the pool as first centres: each next one by chance, in proportion to its squared distance from those before."""
    rng = np.random.default_rng(seed)
    x = np.zeros((len(pool), terms), np.float32)
    for r, (i, v) in enumerate(pool):
        x[r, i] = v
    sq = (x * x).sum(1)
    out = np.zeros((spans[-1][1], terms), np.float32)
    for a, z in spans:
        far = np.ones(len(x))
        for m in range(a, z):
            p = far if far.sum() > 0 else np.ones(len(x))
            out[m] = x[int(rng.choice(len(x), p=p / p.sum()))]
            d = np.maximum(sq - 2 * x @ out[m] + (out[m] ** 2).sum(), 0)
            far = d if m == a else np.minimum(far, d)
    return out


def _silhouette(g: Groups, mean: np.ndarray, within: np.ndarray, size: np.ndarray):
    """Sum of silhouettes (squared distances) of each clustering. The mean squared distance of a text to a group is that to its
    centre plus the group's own mean squared distance from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.zeros(len(g.spans))
        for _, _, _, idx, val, cuts in _parts(batches, 0):
            best, far = g.near(idx, val, cuts)
            for k, (a, z) in enumerate(g.spans):
                d = far[:, a:z] + within[a:z]
                own, r = best[:, k] - a, np.arange(len(best))
                n = size[a:z][own]
                inner = d[r, own] * n / np.maximum(n - 1, 1)
                d[r, own] = np.inf
                d[:, size[a:z] == 0] = np.inf
                outer = d.min(1)
                ok = (n > 1) & np.isfinite(outer)
                top = np.maximum(inner, outer)
                s[k] += np.where(ok & (top > 0), (outer - inner) / np.where(top > 0, top, 1), 0).sum()
        yield pa.record_batch([pa.array(np.arange(len(s))), pa.array(s)], names=["k", "s"])

    return run


def _labels(g: Groups, key_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, i, j, idx, val, cuts in _parts(batches, 1):
            yield pa.record_batch([b.column(0).slice(i, j - i), pa.array(g.near(idx, val, cuts)[0][:, 0].astype(np.int32))], names=["_key", "cluster"])

    return run


def vectors(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, int]:
    """(_key, idx, val) of every text, its normalised TF-IDF vector over the vocabulary of M1, and the number of terms."""
    w, voc = rank.weights(docs, key, text)
    number = {t: i for i, t in enumerate(sorted(r.term for r in voc.select("term").collect()))}  # the vocabulary is bounded
    if not number:
        return docs.select(F.col(key).alias("_key")), 0
    terms = docs.sparkSession.createDataFrame(list(number.items()), "term string, idx int")
    lists = w.join(F.broadcast(terms), "term").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("idx", "u"))).alias("l"))
    none = F.array().cast("array<struct<idx:int,u:double>>")
    v = docs.select(F.col(key).alias("_key")).join(lists.withColumnRenamed(key, "_key"), "_key", "left").withColumn("l", F.coalesce("l", none))
    return stored(v.select("_key", F.transform("l", lambda x: x["idx"]).alias("idx"), F.transform("l", lambda x: x["u"]).alias("val")), "vectors"), len(number)


def clusters(docs: DataFrame, key: str, text: str, k_min: int = 3, k_max: int = 10, inits: int = 10, seed: int = 42, rounds: int = 20) -> DataFrame:
    """(key, cluster): every text in one group; up to three texts, or texts without common terms, form one group of -1.

    Of each number of groups the best of ``inits`` starts is taken, of these the one with the best silhouette."""
    x, terms = vectors(docs, key, text)
    n = x.count()
    if n <= 3 or not terms:
        return docs.select(key, F.lit(-1).alias("cluster"))
    spans, ks = [], [k for k in range(k_min, min(k_max, n - 1) + 1) for _ in range(inits)]
    for k in ks:
        a = spans[-1][1] if spans else 0
        spans.append((a, a + k))
    chosen = x.select("idx", "val", F.xxhash64("_key", F.lit(seed)).alias("h")).orderBy("h").limit(min(POOL, 40_000_000 // terms))
    g = Groups(_starts([(np.array(r.idx, np.int64), np.array(r.val, np.float32)) for r in chosen.collect()], terms, spans, seed), spans)
    error, going = np.zeros(len(g.c)), list(range(len(spans)))
    for turn in range(rounds + 1):  # the last round only measures
        part, rows = g.only(going)
        total, count, error[rows] = _gathered(x, part, terms)
        new = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], part.c).astype(np.float32)
        moved = np.abs(new - part.c).max(1)
        still = [i for i, (a, z) in zip(going, part.spans) if moved[a:z].max() >= 1e-4]
        if not still or turn == rounds:
            break
        g.c[rows], going = new, still  # a clustering that stands still is left out of further rounds
        g = Groups(g.c, spans)
    best = [min((i for i, k in enumerate(ks) if k == want), key=lambda i: error[spans[i][0] : spans[i][1]].sum()) for want in sorted(set(ks))]
    g, _ = g.only(best)
    _, size, error = _gathered(x, g, terms)
    s = x.select("idx", "val").mapInArrow(_silhouette(g, g.c, error / np.maximum(size, 1), size), "k long, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()
    k = max(s, key=lambda r: (round(r.s / n, 9), -r.k)).k
    a, z = g.spans[k]
    one = Groups(g.c[a:z], [(0, z - a)])
    kind = x.schema["_key"].dataType.simpleString()
    return x.mapInArrow(_labels(one, None), f"_key {kind}, cluster int").withColumnRenamed("_key", key)
