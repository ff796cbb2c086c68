"""Problem 7: the whole corpus as ids of a public tokenizer.

Global distinct-word shuffle:

1. split all texts into pre-tokens; a block (a run of texts of one partition, bounded in characters,
   texts and words) keeps the positions of its pre-tokens as numbers of its own word list;
2. one row per (block, number, word), shuffled and sorted by word: all rows of a word meet in one
   stream, where the word is encoded once and its ids go back to every row;
3. the rows return to their block, which lays the ids out along the positions.

Words are keyed by themselves, and words of equal hash are compared sign by sign, so no two words
share ids. A word that stands in every block is one row per block. Sizes of rows and tasks depend on
the block's bounds only, not on the corpus; a single text beyond them is a block of its own.

Null and empty texts give an empty list. One row comes out per row that goes in; a null id stays null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm import textscan as ts
from papyra.operators.common import spread, stored

CHARS = 1_500_000  # code points scanned at a time: bounds the arrays of a batch


def chunks(texts: list[str | None], limit: int = CHARS) -> Iterator[tuple[int, int]]:
    """Cut a batch so that a piece holds at most ``limit`` code points, or one text."""
    a = size = 0
    for i, t in enumerate(texts):
        k = len(t or "") + 1
        if size and size + k > limit:
            yield a, i
            a, size = i, 0
        size += k
    if a < len(texts):
        yield a, len(texts)


def distinct_words(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, number of each pre-token's word, text of each pre-token, hash of each pre-token).

    Pre-tokens are grouped by hash and compared with the first of their group; should any differ, all are told apart by themselves.
    """
    cp, _, ends = ts.flat(texts)
    s, e, d = ts.pretokens(cp, ends)
    h = ts.span_hash(ts.prefix(cp), s, e)
    _, first, inv = np.unique(h, return_index=True, return_inverse=True)
    inv = inv.ravel()
    whole = "\0".join(t or "" for t in texts) + "\0"
    n, rep = e - s, first[inv] if len(first) else inv
    same = bool((n == n[rep]).all())
    if same and len(n):
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        same = bool((cp[at + np.repeat(s, n)] == cp[at + np.repeat(s[rep], n)]).all())
    if same:
        return [whole[i:j] for i, j in zip(s[first].tolist(), e[first].tolist())], inv, d, h
    exact: dict[str, int] = {}
    inv = np.fromiter((exact.setdefault(whole[i:j], len(exact)) for i, j in zip(s.tolist(), e.tolist())), np.int64, len(s))
    return list(exact), inv, d, h


def by_text(values: np.ndarray, d: np.ndarray, n: int) -> list[np.ndarray]:
    return np.split(values, np.searchsorted(d, np.arange(1, n)))


class WordList:
    """A growing list of distinct words, each with its number."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}

    def index(self, texts: list[str | None]) -> list[np.ndarray]:
        """For each text, the numbers of its words; unseen words are added."""
        words, inv, d, _ = distinct_words(texts)
        number = self.number
        where = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words))
        return by_text(where[inv], d, len(texts))


BLOCK = "block long, doc_ids array<long>, sizes array<int>, idx binary, words array<string>"


def _blocks(block_docs: int, block_chars: int, block_words: int):
    schema = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("idx", pa.binary()), ("words", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, no = TaskContext.get().partitionId() << 32, 0
        words, ids, parts, chars = WordList(), [], [], 0

        def done() -> pa.RecordBatch:
            idx = np.concatenate(parts)
            idx = idx.astype("<u2" if len(words.number) <= 1 << 16 else "<i4")  # the reader tells by the length
            return pa.record_batch([[base + no], [ids], [[len(p) for p in parts]], [idx.tobytes()], [list(words.number)]], schema=schema)

        for b in batches:
            doc_ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in chunks(texts, min(CHARS, block_chars)):
                ids += doc_ids[i:j]
                parts += words.index(texts[i:j])
                chars += sum(len(t or "") for t in texts[i:j])
                if len(ids) >= block_docs or chars >= block_chars or len(words.number) >= block_words:
                    yield done()
                    words, ids, parts, chars, no = WordList(), [], [], 0, no + 1
        if ids:
            yield done()

    return run


def _encode(name: str, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = ts.encoder(name, folder)._core_bpe.encode_single_piece
        last: dict[str, bytes] = {}  # of the word at the end of the batch before
        for b in batches:
            d = b.column(2).dictionary_encode()
            got = {w: last.get(w) or np.array(piece(w.encode()), "<u2").tobytes() for w in d.dictionary.to_pylist()}
            last = dict([next(reversed(got.items()))]) if got else {}
            yield pa.record_batch([b.column(0), b.column(1), pa.array(list(got.values()), pa.binary()).take(d.indices)], names=["block", "pos", "ids"])

    return run


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in range(b.num_rows):
            doc_ids, sizes = b.column(0)[r].values.to_numpy(zero_copy_only=False), b.column(1)[r].values.to_numpy()
            raw, total = b.column(2)[r].as_py(), int(sizes.sum())
            idx = np.frombuffer(raw, "<u2" if len(raw) == 2 * total else "<i4")
            got = b.column(3)[r].values
            pos = got.field(0).to_numpy() if len(got) else np.zeros(0, np.int64)
            ids = got.field(1)
            buf = ids.buffers()
            offs = np.frombuffer(buf[1], np.int32)[ids.offset : ids.offset + len(ids) + 1].astype(np.int64) // 2 if len(got) else np.zeros(1, np.int64)
            pool = np.frombuffer(buf[2], "<u2") if len(got) and buf[2] is not None else np.zeros(0, np.uint16)
            start, count = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64)
            start[pos], count[pos] = offs[:-1], np.diff(offs)
            doc_end = np.cumsum(sizes.astype(np.int64))
            for i in range(0, len(doc_ids), 500):  # bounded arrays, however large the block
                j = min(i + 500, len(doc_ids))
                a, z = (doc_end[i - 1] if i else 0), doc_end[j - 1]
                w = idx[a:z]
                k = count[w]
                ends = np.cumsum(k)
                total = int(ends[-1]) if len(ends) else 0
                take = np.repeat(start[w] - (ends - k), k) + np.arange(total)
                per_doc = np.concatenate([[0], ends])[np.concatenate([[0], doc_end[i:j] - a])]
                lists = pa.ListArray.from_arrays(pa.array(per_doc.astype(np.int32)), pa.array(pool[take].astype(np.int32)))
                null = b.column(0)[r].values[i:j]
                yield pa.record_batch([null, lists], names=["doc_id", "ids"])


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = ts.TOKENIZER_DIR, block_docs: int = 20_000, block_chars: int = 4_000_000, block_words: int = 50_000) -> DataFrame:
    """(key, ids): the ids of each text by a byte-level vocabulary of at most 65,536 entries."""
    if max(ts.ranks(name, folder).values()) >= 1 << 16:
        raise ValueError(f"{name} has ids beyond two bytes")
    src = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    blocks = stored(spread(src, "doc_id").mapInArrow(_blocks(block_docs, block_chars, block_words), BLOCK), "blocks")
    words = blocks.select("block", F.posexplode("words").alias("pos", "word"))
    met = words.repartition("word").sortWithinPartitions("word")
    lists = met.mapInArrow(_encode(name, folder), "block long, pos int, ids binary").groupBy("block").agg(F.collect_list(F.struct("pos", "ids")).alias("got"))
    whole = blocks.select("block", "doc_ids", "sizes", "idx").join(lists, "block", "left")
    whole = whole.select("doc_ids", "sizes", "idx", F.coalesce("got", F.expr("CAST(array() AS array<struct<pos:int,ids:binary>>)")).alias("got"))
    return whole.mapInArrow(_assemble, "doc_id long, ids array<int>").withColumnRenamed("doc_id", key)


def _decode(name: str, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = ts.ranks(name, folder)
        size = max(entries.values()) + 2  # the last entry stands for ids outside the vocabulary
        table = [b""] * size
        for word, i in entries.items():
            table[i] = word
        known = np.zeros(size, bool)
        known[list(entries.values())] = True
        count = np.fromiter(map(len, table), np.int64, size)
        start, pool = np.cumsum(count) - count, np.frombuffer(b"".join(table), np.uint8)
        for b in batches:
            for i in range(0, b.num_rows, 500):
                lists = b.column(1).slice(i, 500)
                ids = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                ids[(ids < 0) | (ids >= size)] = size - 1
                k = count[ids]
                ends = np.cumsum(k)
                data = pool[np.repeat(start[ids] - (ends - k), k) + np.arange(int(k.sum()))].tobytes()
                n = np.array([len(x) if x is not None else 0 for x in lists.to_pylist()] if lists.null_count else np.diff(lists.offsets.to_numpy()), np.int64)
                cuts = np.concatenate([[0], np.cumsum(n)])
                at, bad = np.concatenate([[0], ends])[cuts].tolist(), np.concatenate([[0], np.cumsum(~known[ids])])[cuts]
                whole = (np.diff(bad) == 0) & lists.is_valid().to_numpy(zero_copy_only=False)
                out = [data[x:y].decode("utf-8", "replace") if ok else None for x, y, ok in zip(at, at[1:], whole.tolist())]
                yield pa.record_batch([b.column(0).slice(i, 500), pa.array(out, pa.string())], names=["_k", "text"])

    return run


def decode_ids(df: DataFrame, key: str = "doc_id", ids: str = "ids", name: str = "byte_bpe_50k", folder: str = ts.TOKENIZER_DIR) -> DataFrame:
    """(key, text): each id joined with the token-byte table (fixed, one entry per id, held by each task), bytes in order, then UTF-8.

    An id outside the vocabulary makes the text null. Null lists give a null text, empty lists an empty one. No shuffle.
    """
    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("_k"), F.col(ids).cast("array<int>").alias("_ids")).mapInArrow(_decode(name, folder), f"_k {kind}, text string").withColumnRenamed("_k", key)


def token_counts(texts: list[str | None], memo: dict[str, int], name: str, folder: str, memo_max: int = 400_000) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per text, the hash and the number of ids of each of its words. ``memo`` keeps counts between calls, bounded."""
    words, inv, d, h = distinct_words(texts)
    piece = ts.encoder(name, folder)._core_bpe.encode_single_piece
    if len(memo) > memo_max:
        memo.clear()
    n = np.empty(len(words), np.int64)
    for i, w in enumerate(words):
        k = memo.get(w)
        if k is None:
            k = memo[w] = len(piece(w.encode()))
        n[i] = k
    return by_text(h, d, len(texts)), by_text(n[inv], d, len(texts))
