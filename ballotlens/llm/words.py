"""Words of texts, many texts at once, as numbers."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np


def kept(name: str, make):
    """What ``make`` gives, made once in this Python process."""
    store = sys.modules.setdefault("_ballotlens_kept", types.ModuleType("_ballotlens_kept"))
    if not hasattr(store, name):
        setattr(store, name, make())
    return getattr(store, name)


#: Characters of texts that are worked on at once, if they are more than one text.
PIECE_CHARS = 1_000_000


def pieces(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Begin and end of runs of texts of at most PIECE_CHARS characters together; a longer text stands alone, whole."""
    begin = held = 0
    for i, t in enumerate(texts):
        if i > begin and held + len(t) > PIECE_CHARS:
            yield begin, i
            begin, held = i, 0
        held += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def _word_table() -> np.ndarray:
    return np.array([chr(i).isalnum() for i in range(0x10000)])


def is_word_char(codes: np.ndarray) -> np.ndarray:
    """Whether each code point is a letter or a digit."""
    table = kept("word_table", _word_table)
    out = table[np.minimum(codes, 0xFFFF)]
    high = np.flatnonzero(codes > 0xFFFF)
    if len(high):
        values, back = np.unique(codes[high], return_inverse=True)
        out[high] = np.array([chr(int(v)).isalnum() for v in values])[back]
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64, and of its inverse."""
    base, inverse = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    out = np.ones((2, n + 1), np.uint64)
    out[0, 1:], out[1, 1:] = base, inverse
    return tuple(np.multiply.accumulate(out, axis=1))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    store = kept("powers", dict)
    if "p" not in store or len(store["p"][0]) <= n:
        store["p"] = _powers(max(n, 1 << 20))
    return store["p"]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, str]:
    """Of all words (runs of letters or digits, without case) of the texts, in order: 64-bit hash, start and
    end in the joined text; then the index of each text's first word (and of the end); then the joined text."""
    lowered = [t.lower() for t in texts]
    joined = "\n".join(lowered) + "\n"
    codes = code_points(joined)
    word = is_word_char(codes)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    up, down = powers(len(codes))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], dtype=np.uint64)))
    hashes = mix((sums[end] - sums[start]) * down[start])
    text_start = np.concatenate(([0], np.cumsum([len(t) + 1 for t in lowered]))).astype(np.int64)
    return hashes, start, end, np.searchsorted(start, text_start), joined


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n words, by its first word; it may run on into the next text."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out = (out + words[i : len(words) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out
