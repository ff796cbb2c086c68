"""Problem 8: texts into containers of fixed capacity, along a space-filling curve.

1. Per text: size in tokens, and the Hilbert key of its hashed bag-of-words vector projected to
   three dimensions (random projection derived from the word hashes, 10 bits a dimension).
2. Range partitions over (key, id), each sorted: neighbours on the curve are alike.
3. Each partition packs along the curve by best fit over at most ``window`` open containers; the
   open ones left at its end are packed anew in order of size. Partitions are independent, so no
   text is held by one task together with all others; waste is bounded by the few containers per
   partition that stay open.

A text above the capacity is cut into full pieces and a rest; no other text is cut. Null and empty
texts have size 0 and join the container that is open at their place on the curve. Rows that
repeat an id are packed each for itself.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm import textscan as ts
from papyra.llm.tokens import chunks, token_counts
from papyra.operators.common import spread, stored

BITS, DIMS = 10, 3


def hilbert(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of points with integer coordinates (rows) in [0, 2^bits)."""
    x = x.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the excess rotations, axis by axis
        p = q - 1
        for i in range(n):
            on = (x[i] & q) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_key(words: np.ndarray) -> np.ndarray:
    """Projected, normalised vector of the distinct words of a text, each weighted by 1 + ln(count)."""
    if not len(words):
        return np.zeros(DIMS)
    u, n = np.unique(words, return_counts=True)
    w = 1.0 + np.log(n)
    axes = [(ts.mix(u, k + 1) >> np.uint64(40)).astype(np.float64) / (1 << 23) - 1.0 for k in range(DIMS)]
    return np.array([w @ a for a in axes]) / np.sqrt(w @ w)


def _measure(name: str, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in chunks(texts):
                hashes, counts = token_counts(texts[i:j], memo, name, folder)
                v = np.array([curve_key(h) for h in hashes])
                grid = np.clip((v / 3.5 + 0.5) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
                size = np.array([c.sum() for c in counts], np.int64)
                yield pa.record_batch([b.column(0).slice(i, j - i), pa.array(size), pa.array(hilbert(grid))], names=["doc_id", "n_tokens", "curve"])

    return run


class _Packer:
    def __init__(self, capacity: int, window: int, base: int) -> None:
        self.capacity, self.window, self.next = capacity, window, base
        self.open: list[tuple[int, int]] = []  # (free, container), ascending
        self.items: dict[int, list[tuple]] = {}

    def place(self, item: tuple, size: int) -> list[tuple]:
        at = bisect_left(self.open, (size, -1))
        if at < len(self.open):
            free, no = self.open.pop(at)
        else:
            free, no = self.capacity, self.next
            self.next += 1
            self.items[no] = []
        self.items[no].append(item)
        done = []
        if free - size > 0:
            insort(self.open, (free - size, no))
            if len(self.open) > self.window:
                done = self.close(self.open.pop(0)[1])
        else:
            done = self.close(no)
        return done

    def close(self, no: int) -> list[tuple]:
        return [(no, *x) for x in self.items.pop(no)]


def _pack(capacity: int, window: int):
    columns = ["container_id", "doc_id", "piece", "start_token", "n_tokens"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        p = _Packer(capacity, window, TaskContext.get().partitionId() << 32)
        for f in frames:
            out: list[tuple] = []
            for doc, size in zip(f["doc_id"].tolist(), f["n_tokens"].tolist()):
                piece, at = 0, 0
                while size - at > capacity:
                    out.append((p.next, doc, piece, at, capacity))
                    p.next, piece, at = p.next + 1, piece + 1, at + capacity
                out += p.place((doc, piece, at, size - at), size - at)
            yield pd.DataFrame(out, columns=columns)
        rest = sorted((x for no in list(p.items) for x in p.items[no]), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1]))
        p.items, p.open, p.window = {}, [], 1 << 60
        out = [y for x in rest for y in p.place(x, x[3])]
        out += [y for no in list(p.items) for y in p.close(no)]
        yield pd.DataFrame(out, columns=columns)

    return run


def pack_documents(docs: DataFrame, capacity: int, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = ts.TOKENIZER_DIR, window: int = 256, docs_per_partition: int = 100_000) -> DataFrame:
    """(container_id, key, piece, start_token, n_tokens): one row per text, or per piece of a text above the capacity."""
    src = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sized = stored(spread(src, "doc_id").mapInArrow(_measure(name, folder), "doc_id long, n_tokens long, curve long"), "sized")
    n = max(1, -(-sized.count() // docs_per_partition))
    line = sized.repartitionByRange(n, "curve", "doc_id").sortWithinPartitions("curve", "doc_id", "n_tokens")
    out = line.select("doc_id", "n_tokens").mapInPandas(_pack(capacity, window), "container_id long, doc_id long, piece int, start_token long, n_tokens long")
    return out.withColumnRenamed("doc_id", key)


def container_report(packed: DataFrame, capacity: int) -> DataFrame:
    """Of all containers: how many, tokens held, share of the capacity that is used, and the smallest possible number."""
    per = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("items"))
    total = per.agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"), F.max("used").alias("fullest"), F.max("items").alias("most_items"))
    return total.select("*", F.round(F.col("tokens") / (F.col("containers") * F.lit(capacity)), 6).alias("fill"), F.ceil(F.col("tokens") / F.lit(capacity)).alias("least_containers"))
