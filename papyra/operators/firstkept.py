"""A2: near-duplicates by banded MinHash, the first document of each collision kept (not transitive)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.operators.common import stored

PERMS, BANDS, K = 128, 8, 5
_R = np.random.default_rng(1)
_A = (_R.integers(1, 1 << 32, PERMS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _R.integers(0, 1 << 32, PERMS, dtype=np.uint64).astype(np.uint32)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _bands(text: str | None) -> list[int]:
    """A 64-bit key for each band of the MinHash signature over the text's K-character pieces; a shorter text is its own piece."""
    s = " ".join((text or "").lower().split())
    cp = np.frombuffer(s.ljust(K, "\0").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.zeros(len(cp) - K + 1, np.uint64)
    for i in range(K):
        h = mix(h * np.uint64(31) + cp[i : len(cp) - K + 1 + i])
    h = (np.unique(h) >> np.uint64(32)).astype(np.uint32)[:, None]
    sig = np.full(PERMS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(h), 4096):
        y = h[i : i + 4096] * _A + _B
        np.minimum(sig, (y ^ (y >> np.uint32(15))).min(0), out=sig)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in sig.reshape(BANDS, -1).T.astype(np.uint64):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + row)
    return key.view(np.int64).tolist()


def kept_first(docs: DataFrame, key: str = "file_id", text: str = "body") -> DataFrame:
    """(key, kept): a document goes if it shares a band with an earlier one that stays.

    Documents of one band are linked in a chain of bucket minima rather than pairwise: within a
    bucket every later member collides with every earlier one, so exactly the first member still
    undecided or kept matters, and each round compares members with that minimum only. Rounds end
    when nothing is undecided, and the first undecided document is decided in each, so they do end;
    each is written to the shared folder."""

    @F.pandas_udf("array<long>")
    def bands(s: pd.Series) -> pd.Series:
        return s.map(_bands)

    rows = stored(docs.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.explode(bands(F.coalesce(F.col(text), F.lit("")))).alias("band")), "bands")
    crowded = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band")
    rows = stored(rows.join(crowded, "band"), "crowded")
    state = stored(rows.select("id").distinct().withColumn("s", F.lit(0)), "state")  # 0 undecided, 1 kept, 2 dropped
    while not state.where("s = 0").isEmpty():
        open_ = rows.join(state, "id").where("s < 2")
        low = open_.groupBy("band").agg(F.min("id").alias("low"), F.min(F.when(F.col("s") == 1, F.col("id"))).alias("kept"))
        seen = open_.join(low, "band").groupBy("id", "s").agg(F.min("low").alias("low"), F.max(F.coalesce(F.col("kept") < F.col("id"), F.lit(False))).alias("hit"))
        new = seen.select("id", F.when(F.col("s") == 1, 1).when(F.col("hit"), 2).when(F.col("low") == F.col("id"), 1).otherwise(0).alias("n"))
        state = stored(state.join(new, "id", "left").select("id", F.coalesce("n", "s").alias("s")), "state")
    return docs.select(F.col(key).alias("id")).join(state, "id", "left").select(F.col("id").alias(key), (F.coalesce("s", F.lit(1)) != 2).alias("kept"))
