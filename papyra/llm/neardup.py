"""Problem 6: records whose texts are largely the same, by a chosen-path set similarity join.

1. Normalise, hash to an exact class, MinHash (``COORDS`` tokens over 5-character pieces). Exact
   copies are joined as one class from here on, so a text that a third of all rows hold costs one row.
2. ``trees`` independent random trees over the classes. A node of more than ``node`` members
   branches: a hash of its path selects one coordinate, or two with the chance that keeps pairs at
   the threshold alive (mean 1/threshold); members with the same token there share the child.
   A smaller node is compared exhaustively (bit sketches first). A node that is still large after
   ``depth`` levels is compared in blocks, each pair of blocks in its own task.
3. Pairs that pass the sketch are verified by exact similarity of their whole piece sets.

Levels are written to the shared folder: rows are (node, id, sketch), 32 bytes each. Sizes of nodes
come from a map-side-combined count. Nothing is collected on the driver but row counts.

Policies: null texts and texts under ``min_chars`` after normalising take no part; of several
deliveries of a key the latest counts; null keys take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.llm import textscan as ts
from papyra.llm.tokens import chunks
from papyra.operators.common import latest, spread, stored

COORDS, PIECE = 64, 5
_RNG = np.random.default_rng(20240229)
_A = (_RNG.integers(1, 1 << 32, COORDS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_C = _RNG.integers(0, 1 << 32, COORDS, dtype=np.uint64).astype(np.uint32)[:, None]


def normal(text: str | None) -> str | None:
    """Lower case, one blank for each run of white space, trimmed."""
    return None if text is None else " ".join(text.lower().split())


def pieces(texts: list[str]) -> list[np.ndarray]:
    """Hashes of the distinct pieces of each (normalised) text, ascending."""
    cp, starts, ends = ts.flat(texts)
    p = ts.prefix(cp)
    at = np.arange(max(0, len(cp) - PIECE + 1))
    h = ts.span_hash(p, at, at + PIECE)
    return [np.unique(h[a : max(a, z - PIECE + 1)]) for a, z in zip(starts.tolist(), ends.tolist())]


def signature(h: np.ndarray) -> np.ndarray:
    """MinHash tokens of one set of pieces."""
    x = (h >> np.uint64(32)).astype(np.uint32)
    out = np.full(COORDS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 4096):
        y = x[i : i + 4096] * _A + _C
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        np.minimum(out, y.min(1), out=out)
    return out


_SIG = "id long, arrived timestamp, md5 binary, tokens array<int>, s0 long, s1 long"


def _sign(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "arrived", "md5", "tokens", "s0", "s1"]
        for b in batches:
            texts = [normal(t) for t in b.column(2).to_pylist()]
            for i, j in chunks(texts, 700_000):
                keep = [k for k in range(i, j) if texts[k] is not None and len(texts[k]) >= min_chars]
                part = [texts[k] for k in keep]
                sig = np.array([signature(h) for h in pieces(part)], np.uint32).reshape(len(part), COORDS)
                bits = np.uint64(1) << np.arange(COORDS, dtype=np.uint64)
                s0, s1 = (((sig >> np.uint32(k)) & 1).astype(np.uint64) @ bits for k in (3, 11))
                md5 = [hashlib.md5(t.encode("utf-8", "surrogatepass")).digest() for t in part]
                at, gone = dict(zip(keep, range(len(keep)))), pa.scalar(None, pa.binary())
                if len(keep) < j - i:  # rows that take no part still outrank older deliveries
                    rows = [at.get(k) for k in range(i, j)]
                    idx = pa.array(rows, pa.int64())
                else:
                    idx = pa.array(np.arange(len(keep)))
                tokens = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * COORDS), pa.array(sig.ravel().view(np.int32)))
                cols = [pa.array(md5, pa.binary()), tokens, pa.array(s0.view(np.int64)), pa.array(s1.view(np.int64))]
                yield pa.record_batch([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), *[c.take(idx) for c in cols]], names=names)

    return run


def _children(rows: DataFrame, threshold: float) -> DataFrame:
    """(node, id, s0, s1, tokens) -> members of the children."""
    extra = 1.0 / threshold - 1.0
    two = F.pmod(F.xxhash64("node", F.lit(-1)), F.lit(1 << 20)) < int(extra * (1 << 20))
    turns = rows.select("*", F.explode(F.when(two, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_j"))
    at = F.pmod(F.xxhash64("node", "_j"), F.lit(COORDS)).cast("int")
    return turns.select(F.xxhash64("node", at, F.get("tokens", at)).alias("node"), "id", "s0", "s1")


def _alike(rows: DataFrame, on: list[str], most: int, also: Column | None = None) -> DataFrame:
    a, b = rows.alias("a"), rows.alias("b")
    match = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in on] + ([] if also is None else [also])
    cond = match[0]
    for m in match[1:]:
        cond = cond & m
    differ = F.bit_count(F.col("a.s0").bitwiseXOR(F.col("b.s0")).bitwiseOR(F.col("a.s1").bitwiseXOR(F.col("b.s1"))))
    return a.join(b, cond & (F.col("a.id") < F.col("b.id")) & (differ <= most)).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def candidates(sets: DataFrame, threshold: float, trees: int, node: int, depth: int, most: int) -> DataFrame:
    """Distinct pairs (a < b) of ids that meet in a small node of some tree and whose sketches differ in at most ``most`` places."""
    small, rest = [], None
    rows = sets.select(F.explode(F.array([F.lit(i) for i in range(trees)])).alias("tree"), "id", "s0", "s1", "tokens").withColumn("node", F.xxhash64("tree", F.lit("root")))
    for level in range(depth):
        kids = stored(_children(rows, threshold), f"level{level}")
        sizes = kids.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        kids = stored(kids.join(sizes, "node"), f"sized{level}")
        small.append(kids.where(F.col("n") <= node).drop("n"))
        rest = kids.where(F.col("n") > node)
        if level and rest.isEmpty():
            rest = None
            break
        rows = rest.drop("n").join(sets.select("id", "tokens"), "id")
    pairs = _alike(stored_union(small), ["node"], most)
    if rest is not None:  # blocks of about ``node`` members, every two of them in one group
        blocks = rest.withColumn("m", F.ceil(F.col("n") / F.lit(node)).cast("int")).withColumn("c", F.pmod(F.xxhash64("id", "node"), F.col("m")).cast("int"))
        cross = blocks.select("node", "id", "s0", "s1", "c", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("o"))
        cross = cross.select("node", "id", "s0", "s1", "c", F.least("c", "o").alias("x"), F.greatest("c", "o").alias("y"))
        once = (F.col("a.c") != F.col("b.c")) | (F.col("a.x") == F.col("a.y"))  # two of one block meet in that block's own group only
        pairs = pairs.unionByName(_alike(cross, ["node", "x", "y"], most, once))
    return pairs.distinct()


def stored_union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _verify(threshold: float):
    share = round(threshold * 10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c, ta, tb = (b.column(i).to_pylist() for i in range(4))
            out: list[tuple] = []
            for i, j in chunks(ta, 500_000):
                pa_, pb_ = pieces([normal(t) or "" for t in ta[i:j]]), pieces([normal(t) or "" for t in tb[i:j]])
                for k, x, y in zip(range(i, j), pa_, pb_):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    either = len(x) + len(y) - both
                    if either and both * 10_000 >= share * either:
                        out.append((a[k], c[k], both / either))
            cols = list(zip(*out)) or [[]] * 3
            yield pa.record_batch([pa.array(v, t) for v, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "similarity"])

    return run


def similar_classes(docs: DataFrame, key: str = "file_id", text: str = "body", arrived: str = "ingested_at", threshold: float = 0.85, min_chars: int = 200, trees: int = 10, node: int = 32, depth: int = 12) -> tuple[DataFrame, DataFrame]:
    """(members, links): ``members`` (id, cls, copies) has a row per record that takes part, ``cls`` being the least id of its
    exact class; ``links`` (a, b, similarity) has a row per pair of classes at or above the threshold."""
    src = docs.select(F.col(key).cast("long").alias("id"), F.col(arrived).cast("timestamp").alias("arrived"), F.col(text).alias("text")).where(F.col(key).isNotNull())
    signed = stored(spread(src, "id").mapInArrow(_sign(min_chars), _SIG), "signed")
    newest = latest(signed.select("id", "arrived", "md5"), ["id"], "arrived").where("md5 IS NOT NULL")
    heads = newest.groupBy("md5").agg(F.min("id").alias("cls"), F.count(F.lit(1)).alias("copies"))
    heads = stored(heads, "heads")
    # classes that hold over 1/10,000 of the rows: at most 10,000 of them, so this table may be sent to all tasks; the join by md5 then has no hot key
    large = F.broadcast(heads.where(F.col("copies") > max(1000, signed.count() // 10_000)))
    some = newest.join(large, "md5").select("id", "cls", "copies")
    rest = newest.join(large.select("md5"), "md5", "left_anti").join(heads, "md5").select("id", "cls", "copies")
    members = stored(some.unionByName(rest), "members")
    sets = signed.where("md5 IS NOT NULL").join(heads.select("md5", F.col("cls").alias("id")), ["md5", "id"]).groupBy("id").agg(*[F.max(c).alias(c) for c in ("tokens", "s0", "s1")])
    sets = stored(sets, "sets")
    chance = 0.75 * (1 - threshold)  # that a coordinate's two bits differ, at the threshold
    most = int(COORDS * chance + 4 * np.sqrt(COORDS * chance * (1 - chance)))
    pairs = stored(candidates(sets, threshold, trees, node, depth, most), "pairs")
    asked = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    texts = src.join(asked, "id", "left_semi").groupBy("id").agg(F.max_by("text", "arrived").alias("text"))
    ab = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    links = stored(ab.select("a", "b", "ta", "tb").mapInArrow(_verify(threshold), "a long, b long, similarity double"), "links")
    return members, links


def similar_pairs(members: DataFrame, links: DataFrame, multiply: int = 100) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of records, also those within a class of exact copies.

    The copies of a class of more than ``multiply`` members are not multiplied out (a third of all rows
    may be copies of one text): each of them is paired with the first record of its class, and other
    classes with that record only. Together with the membership in ``members`` that is every pair;
    ``links`` holds the pairs between different texts, whatever the size of their classes.
    """
    few = F.col("copies") <= multiply
    shown = members.where(few | (F.col("id") == F.col("cls"))).select("id", "cls")
    cross = links.join(shown.select(F.col("cls").alias("a"), F.col("id").alias("x")), "a").join(shown.select(F.col("cls").alias("b"), F.col("id").alias("y")), "b")
    some = members.where((F.col("copies") > 1) & few)
    inner = some.select("cls", F.col("id").alias("x")).join(some.select("cls", F.col("id").alias("y")), "cls").where("x < y")
    star = members.where(~few & (F.col("id") > F.col("cls"))).select(F.col("cls").alias("x"), F.col("id").alias("y"))
    both = cross.select("x", "y").unionByName(inner.select("x", "y")).unionByName(star)
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, cls, links, group_id): connected groups of classes; ``group_id`` is the least class of the group, ``links`` counts its class's partners.

    Labels spread to neighbours and jump to the label's own label, so rounds grow with the
    logarithm of the longest chain; each round is written to the shared folder, and rounds go on
    until no label changes.
    """
    ends = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = stored(ends.select(F.col("a").alias("cls")).distinct().withColumn("label", F.col("cls")), "labels")
    while True:
        near = ends.join(labels.select(F.col("cls").alias("b"), "label"), "b").groupBy(F.col("a").alias("cls")).agg(F.min("label").alias("near"))
        step = labels.join(near, "cls").select("cls", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        jump = step.join(labels.select(F.col("cls").alias("mid"), F.col("label").alias("far")), "mid", "left")
        new = stored(jump.select("cls", "old", F.least("mid", F.coalesce("far", F.col("mid"))).alias("label")), "labels")
        labels = new.select("cls", "label")
        if new.where("label <> old").isEmpty():
            break
    count = ends.groupBy(F.col("a").alias("cls")).agg(F.count(F.lit(1)).alias("links"))
    out = members.join(labels, "cls", "left").join(count, "cls", "left")
    return out.select("id", "cls", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("label", F.col("cls")).alias("group_id"))
