"""Vectorised text scanning for Arrow batches: code points, pre-tokens, rolling hashes.

All functions work on one flat array of code points that holds a batch of texts, each followed
by one separator position, so that no Python loop runs per character, word or text.
"""

from __future__ import annotations

import base64
import functools
import os

import numpy as np

TOKENIZER_DIR = os.environ.get("PAPYRA_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the pattern by which the byte-level vocabularies split a text before merging.
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
OTHER, LETTER, NUMBER, SPACE, SEP = range(5)
_B = 0x9E3779B97F4A7C15 | 3  # odd and 3 modulo 4: B and B - 1 lose as few low bits as they can
_MASK = (1 << 64) - 1


@functools.cache
def classes() -> np.ndarray:
    """The pre-token class of every code point."""
    import regex

    chars = "".join(map(chr, range(0xD800))) + "\0" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    out = np.zeros(0x110000, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for m in regex.finditer(pattern, chars):
            out[m.start() : m.end()] = kind
    return out


def flat(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by a zero; where each text starts and ends."""
    texts = [t or "" for t in texts]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    cp = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32) if texts else np.zeros(0, np.uint32)
    ends = np.cumsum(sizes + 1) - 1
    return cp, ends - sizes, ends


@functools.cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _B & _MASK, np.uint64), np.full(size, pow(_B & _MASK, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit finaliser."""
    x = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & _MASK)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix(cp: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over the mixed code points, modulo 2^64."""
    n = len(cp)
    up, _ = _powers(1 << max(10, (n + 1).bit_length()))
    out = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(cp) * up[:n], out=out[1:])
    return out


def span_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span [start, end) of the text that ``prefix`` was taken of."""
    _, down = _powers(1 << max(10, len(p).bit_length()))
    return (p[end] - p[start]) * down[start]


def pretokens(cp: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every pre-token, as PRETOKEN splits the texts."""
    n = len(cp)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    c = classes()[cp]
    c[ends] = SEP
    first = np.empty(n, bool)
    first[0] = True
    first[1:] = c[1:] != c[:-1]
    first[ends] = True
    starts = np.flatnonzero(first)
    last = np.append(starts[1:], n) - 1  # last position of each run
    kind = c[starts]
    cut = np.zeros(n + 1, bool)
    blank = np.zeros(n + 1, bool)
    blank[1:] = cp == 32  # blank before position i
    white = kind == SPACE
    solid = starts[~white & ~(blank[starts] & (starts > 0) & (kind != SEP))]
    cut[solid] = True
    cut[starts[white]] = True
    inner = last[white]
    cut[inner[c[inner + 1] != SEP]] = True
    q = starts[(kind == OTHER) & (last == starts) & (cp[starts] == 39) & ~blank[starts]]
    q = q[c[q + 1] == LETTER]
    if len(q):
        a = cp[q + 1]
        one = np.isin(a, np.array([115, 116, 109, 100], np.uint32))  # s t m d
        b = np.where(q + 2 < n, cp[np.minimum(q + 2, n - 1)], 0)
        two = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)  # re ve ll
        for hits, k in ((q[one], 1), (q[two], 2)):
            cut[hits + 1] = False
            go_on = hits[c[hits + 1 + k] == LETTER]
            cut[go_on + 1 + k] = True
    s = np.flatnonzero(cut[:n])
    e = np.append(s[1:], n)
    keep = c[s] != SEP
    s, e = s[keep], e[keep]
    return s, e, np.searchsorted(ends, s)


@functools.cache
def ranks(name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> dict[bytes, int]:
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.cache
def encoder(name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR):
    import tiktoken

    return tiktoken.Encoding(name, pat_str=PRETOKEN, mergeable_ranks=ranks(name, folder), special_tokens={})


def encode_word(word: str, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> list[int]:
    """Ids of one pre-token."""
    return encoder(name, folder)._core_bpe.encode_single_piece(word.encode())
