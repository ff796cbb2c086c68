"""Problem 2: texts above a size limit into pieces at natural boundaries, with overlap.

Structure-tree packing. A text is a tree: sections by heading level, blocks (paragraphs, lists, tables,
fenced code), list items with their nested lists, lines, sentences, words. Only a node above the limit is
descended into; its children, those above the limit packed by themselves first, are merged with their
neighbours up to the limit. So a piece holds whole siblings, or parts of one oversized node, and never
parts of two parents. A heading is one node with the block after it. Only a run without white space and
sentence end that exceeds the limit is cut inside (``forced``).

Every piece but the first begins with the last ``overlap`` characters of the piece before; the new
parts, in order, are the text. Sizes are code points. Texts within the limit, null and empty ones
give no piece. Of several deliveries of a key the latest counts; null keys are left out.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.operators.common import latest

SECTION, BODY, LIST, ITEM, ROWS, PARAGRAPH, SENTENCE, WORD, SOLID = range(9)
DEEPEST = 40  # nested lists further down are cut by lines
_HEADING = re.compile(r"^ {0,3}(#{1,6})\s+\S.*$", re.M)
_FENCE = re.compile(r"^ {0,3}(?:```|~~~)", re.M)
_GAP = re.compile(r"\n[^\S\n]*\n\s*")
_MARK = re.compile(r"^([ \t]*)(?:[-*+•]|\d{1,3}[.)])[ \t]+\S", re.M)
_LINE = re.compile(r"\n+")
_SENTENCE = re.compile(r"[.!?;][\"'”’»)\]]*\s+|[。！？；][”’」』）]*\s*")
_WORD = re.compile(r"\s+")
_STOP = re.compile(r"[.!?;。！？；]+")
_SOLID = re.compile(r"[^\s.!?;。！？；]+")


class _Cutter:
    def __init__(self, text: str, limit: int, overlap: int) -> None:
        self.text, self.limit, self.later = text, limit, max(1, limit - overlap)
        self.starts: list[int] = []
        self.forced = False
        self.fences = [m.start() for m in _FENCE.finditer(text)]
        heads = [(m.start(), len(m.group(1)), m.end()) for m in _HEADING.finditer(text) if not self.fenced(m.start())]
        self.heads, self.levels, self.head_ends = ([h[i] for h in heads] for i in range(3))
        self.marks = [(m.start(), len(m.group(1).expandtabs(4))) for m in _MARK.finditer(text) if not self.fenced(m.start())]
        self.mark_at = [p for p, _ in self.marks]

    def fenced(self, p: int) -> bool:
        return bisect_left(self.fences, p) % 2 == 1

    def room(self, start: int) -> int:
        return self.later if start else self.limit

    def parted(self, a: int, z: int, pattern: re.Pattern) -> list[int]:
        return [m.end() for m in pattern.finditer(self.text, a, z) if a < m.end() < z]

    def marks_in(self, a: int, z: int) -> list[tuple[int, int]]:
        return self.marks[bisect_left(self.mark_at, a) : bisect_left(self.mark_at, z)]

    def kind(self, a: int, z: int) -> int:
        """Of a block."""
        t = self.text
        first = t[a : a + 4].lstrip(" ")[:3]
        if first in ("```", "~~~") or first[:1] == "|":
            return ROWS
        return LIST if self.mark_at and a in self.mark_at[(i := bisect_left(self.mark_at, a)) : i + 1] else PARAGRAPH

    def section(self, a: int, z: int) -> list[tuple[int, int]]:
        i, j = bisect_right(self.heads, a), bisect_left(self.heads, z)
        if i == j:
            return [(a, BODY)]
        top = min(self.levels[i:j])
        cuts = [a, *(p for p, k in zip(self.heads[i:j], self.levels[i:j]) if k == top)]
        return [(p, SECTION) for p in cuts]

    def body(self, a: int, z: int) -> list[tuple[int, int]]:
        """Blocks; a heading goes with the block after it, list blocks that follow each other are one list."""
        own = bisect_left(self.heads, a)
        after = self.head_ends[own] if own < len(self.heads) and self.heads[own] == a else a
        out: list[tuple[int, int]] = []
        for p in [a, *(p for p in self.parted(a, z, _GAP) if not self.fenced(p))]:
            if out and (p > after and not self.text[after:p].strip()):  # only the heading so far
                out[-1] = (out[-1][0], self.kind(p, z))
                continue
            k = self.kind(p, z)
            if out and k == LIST and out[-1][1] == LIST:
                continue
            out.append((p, k))
        return out

    def items(self, a: int, z: int, depth: int) -> list[tuple[int, int]]:
        marks = self.marks_in(a, z)
        if not marks or depth > DEEPEST:
            return [(a, ROWS)]
        least = min(k for _, k in marks)
        cuts = [p for p, k in marks if k == least]
        return ([(a, PARAGRAPH)] if cuts[0] > a else []) + [(p, ITEM) for p in cuts]

    def children(self, a: int, z: int, kind: int, depth: int) -> list[tuple[int, int]]:
        """(start, kind) of the children of the node [a, z)."""
        if kind == SECTION:
            return self.section(a, z)
        if kind == BODY:
            return self.body(a, z)
        if kind == LIST:
            return self.items(a, z, depth)
        if kind == ITEM:  # its own lines, then the list nested in it
            inner = self.marks_in(a + 1, z)
            return [(a, ROWS), (inner[0][0], LIST)] if inner else [(a, ROWS)]
        if kind in (ROWS, PARAGRAPH):
            return [(p, SENTENCE) for p in [a, *self.parted(a, z, _LINE)]]
        pattern, below = {SENTENCE: (_SENTENCE, WORD), WORD: (_WORD, SOLID), SOLID: (_STOP, -1)}[kind]
        return [(p, below) for p in [a, *self.parted(a, z, pattern)]]

    def pack(self, a: int, z: int, kind: int, depth: int = 0) -> None:
        """Starts of the pieces of an oversized node."""
        if kind < 0:
            solid = _SOLID.search(self.text, a, z)
            self.forced |= solid is not None and solid.end() - solid.start() > self.limit
            while z - a > self.room(a):
                self.starts.append(a)
                a += self.room(a)
            self.starts.append(a)
            return
        kids = self.children(a, z, kind, depth)
        ends = [p for p, _ in kids[1:]] + [z]
        group = None
        for (p, k), q in zip(kids, ends):
            if group is not None and q - group <= self.room(group):
                continue
            if group is not None:
                self.starts.append(group)
                group = None
            if q - p <= self.room(p):
                group = p
            else:
                self.pack(p, q, k, depth + 1)
        if group is not None:
            self.starts.append(group)


def split_text(text: str, limit: int, overlap: int) -> tuple[list[tuple[int, int]], bool]:
    """Spans of the pieces, overlap included, and whether an unbreakable run had to be cut. Needs 0 <= overlap < limit."""
    if len(text) <= limit:
        return [(0, len(text))], False
    c = _Cutter(text, limit, overlap)
    c.pack(0, len(text), SECTION)
    edges = [*c.starts, len(text)]
    return [(max(0, a - overlap) if i else 0, z) for i, (a, z) in enumerate(zip(edges, edges[1:]))], c.forced


def _split(limit: int, overlap: int, with_text: bool):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pieces, forced = [], []
            for t in b.column(2).to_pylist():
                spans, f = split_text(t, limit, overlap) if t is not None else (None, None)
                pieces.append(spans and [{"start": a, "stop": z, "text": t[a:z] if with_text else None} for a, z in spans])
                forced.append(None if f is None else int(f))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(pieces, kind), pa.array(forced, pa.int32())], names=["rec_id", "arrived", "pieces", "forced"])

    return run


def split_oversized(df: DataFrame, key: str, text: str, arrived: str, limit: int, overlap: int, with_text: bool = True) -> DataFrame:
    """(rec_id, pieces array<(start, stop, text)>, forced): one row per key whose latest text is above the limit. Shorter texts never leave the JVM."""
    long = F.when(F.length(text) > limit, F.col(text))
    src = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("rec_id"), F.col(arrived).cast("timestamp").alias("arrived"), long.alias("text"))
    cut = src.mapInArrow(_split(limit, overlap, with_text), "rec_id long, arrived timestamp, pieces array<struct<start:int,stop:int,text:string>>, forced int")
    return latest(cut, ["rec_id"], "arrived").where("pieces IS NOT NULL").drop("arrived")


def pieces_of(split: DataFrame) -> DataFrame:
    """One row per piece."""
    return split.select("rec_id", "forced", F.posexplode("pieces").alias("piece", "p")).select("rec_id", "piece", F.col("p.start").alias("start"), F.col("p.stop").alias("stop"), F.col("p.text").alias("text"), "forced")
