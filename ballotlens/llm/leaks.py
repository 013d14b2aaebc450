"""Test passages that leak into training texts, by pigeonhole edit matching.

Every window of ``window`` words of a passage is split into budget + 1 pieces. A text that holds the
window with at most ``budget`` word edits holds one piece exactly, so the exact hits of pieces give all
candidates; each is verified by Myers' bit-parallel distance over words. Pieces are at least
``window // (budget + 1)`` words long; the index holds the first so many words of each, as hashes.

Test items are the query set: they are taken in blocks of bounded size, and each block is held against
all texts in one pass without a shuffle.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballotlens.llm.words import gram_hashes, pieces, word_hashes

WINDOW, BUDGET = 13, 2
#: Characters of passages in one block of test items (about 30 bytes of index for each 6), held against all texts at once.
BLOCK_CHARS = 16_000_000
#: Pairs of a place in the texts and a place in a passage that are looked at together.
PAIRS = 1_000_000


def myers(patterns: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """For each row, the least number of edits between the pattern and any stretch of the text.

    Both are matrices of 64-bit word hashes, patterns of at most 63 columns. One bit of a 64-bit number
    stands for a word of the pattern; all rows advance together, one word of text at a time.
    """
    m = patterns.shape[1]
    one, full, top = np.uint64(1), np.uint64((1 << m) - 1), np.uint64(m - 1)
    bits = one << np.arange(m, dtype=np.uint64)
    plus, minus = np.full(len(patterns), full), np.zeros(len(patterns), np.uint64)
    score = np.full(len(patterns), m, np.int64)
    best = score.copy()
    for t in range(texts.shape[1]):
        eq = ((patterns == texts[:, t : t + 1]) * bits).sum(axis=1, dtype=np.uint64)
        across = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | (~(across | plus) & full), plus & across
        score += ((up >> top) & one).astype(np.int64) - ((down >> top) & one).astype(np.int64)
        # a match may begin anywhere, so the top row stays 0
        up, down = (up << one) & full, (down << one) & full
        across = eq | minus
        plus, minus = down | (~(across | up) & full), up & across
        np.minimum(best, score, out=best)
    return best


class Index:
    """Hashes of all pieces of a block of passages, sorted, with their places."""

    def __init__(self, passages: dict[str, list[int]], window: int, budget: int):
        self.window, self.budget, self.piece = window, budget, window // (budget + 1)
        self.items = [ids for _, ids in passages.items()]
        hashes, start, end, first, joined = word_hashes(list(passages)) if passages else (np.zeros(0, np.uint64), [], [], [0], "")
        self.hashes, self.offset, self.size = hashes, np.asarray(first[:-1], np.int64), np.diff(np.asarray(first, np.int64))
        self.words = [[joined[s:e] for s, e in zip(start[a:b], end[a:b])] for a, b in zip(first[:-1], first[1:])]
        keys, who, place = [], [], []
        for n, (a, b) in enumerate(zip(first[:-1], first[1:])):
            if b - a >= window:
                g = gram_hashes(hashes[a:b], self.piece)
                keys.append(g)
                who.append(np.full(len(g), n, np.int32))
                place.append(np.arange(len(g), dtype=np.int32))
        self.keys, self.who, self.place = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((keys, np.uint64), (who, np.int32), (place, np.int32)))
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.who, self.place = self.keys[order], self.who[order], self.place[order]
        # one bit for each 20-bit prefix, so that most words of the corpus end after one look-up
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, grams: np.ndarray, pairs: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Positions of grams that equal a piece, once for each place of the piece; then passage and place. In slices of at
        most so many pairs (or one position with all its places), so that a common piece takes no more memory than a rare one."""
        maybe = np.flatnonzero(self.sieve[(grams >> np.uint64(44)).astype(np.int64)])
        lo, hi = np.searchsorted(self.keys, grams[maybe], "left"), np.searchsorted(self.keys, grams[maybe], "right")
        maybe, lo, n = maybe[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        upto, begin = np.cumsum(n), 0
        while begin < len(maybe):
            end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + pairs, "right")))
            k = n[begin:end]
            ref = np.repeat(lo[begin:end], k) + (np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k))
            yield np.repeat(maybe[begin:end], k), self.who[ref], self.place[ref]
            begin = end

    def verify(self, hashes: np.ndarray, bounds: tuple[np.ndarray, np.ndarray], doc: np.ndarray, at: np.ndarray, who: np.ndarray, place: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
        """For each text and passage with a window within the budget: the least distance of a window, and a
        place (in the texts' words, in the passage) where a window of that distance lies.

        bounds: first and end word of each hit's text.
        """
        k, w = self.budget, self.window
        rows = []
        for p in range(k + 1):
            begin = place - p * self.piece
            fits = (begin >= 0) & (begin <= self.size[who] - w)
            rows.append(np.stack((doc, who, begin, at - place + begin, *bounds))[:, fits])
        rows = np.concatenate(rows, axis=1)
        # each window once: passage, place in it and place in the texts make one number
        wide = int(self.size.max(initial=0)) + 1
        code = ((rows[3] + wide) * len(self.size) + rows[1]) * wide + rows[2]
        rows = rows[:, np.unique(code, return_index=True)[1]]
        out: dict[tuple[int, int], tuple[int, int, int]] = {}
        for step in range(0, rows.shape[1], 4096):
            d, n, begin, pos, lo, hi = rows[:, step : step + 4096]
            where = pos[:, None] + np.arange(-k, w + k)
            inside = (where >= lo[:, None]) & (where < hi[:, None])
            text = np.where(inside, hashes[np.clip(where, 0, len(hashes) - 1)], np.uint64(0))
            pattern = self.hashes[self.offset[n][:, None] + begin[:, None] + np.arange(w)]
            best = myers(pattern, text)
            for i in np.flatnonzero(best <= k).tolist():
                key = (int(d[i]), int(n[i]))
                if key not in out or best[i] < out[key][0]:
                    out[key] = (int(best[i]), int(pos[i]), int(begin[i]))
        return out

    def run(self, n: int, text: list[str], places: list[tuple[int, int]]) -> int:
        """Most words in a row that are equal in passage n and a text, through any of the places (of the text, of the passage)."""
        passage, most, done = self.words[n], 0, {}
        for i, j in sorted(places):
            if done.get(i - j, -1) > i:
                continue
            a, b = i, i
            while a > 0 and a - (i - j) > 0 and text[a - 1] == passage[a - 1 - (i - j)]:
                a -= 1
            while b < len(text) and b - (i - j) < len(passage) and text[b] == passage[b - (i - j)]:
                b += 1
            done[i - j] = b
            most = max(most, b - a)
        return most


def find_leaks(documents: DataFrame, items: DataFrame, window: int = WINDOW, budget: int = BUDGET, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, distance and run of each text that holds a window of an item's passage with at most
    ``budget`` word edits.

    distance: the least over the windows (0: held exactly). run: where a window is held exactly, most words
    in a row that are equal, compared as words, not as hashes; else null. Words
    are runs of letters or digits, without case; what lies between does not count. Null or empty texts and
    passages, and passages shorter than the window, match nothing. Items that share a passage all come out.
    Repeated rows give one row. Other columns are dropped.
    """
    items = items.select("item_id", "passage").where("passage is not null")
    blocks = max(1, -(-(items.agg(F.sum(F.length("passage"))).first()[0] or 0) // block_chars))
    out = None
    for b in range(int(blocks)):
        passages: dict[str, list[int]] = defaultdict(list)
        for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).distinct().collect():  # one bounded block of the query set
            passages[r.passage].append(r.item_id)
        part = _scan(documents, Index(dict(passages), window, budget))
        out = part if out is None else out.unionAll(part)
    return out.distinct()


def _scan(documents: DataFrame, index: Index) -> DataFrame:
    sent = documents.sparkSession.sparkContext.broadcast(index)  # bounded by block_chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            out: list[tuple[int, int, int, int]] = []
            for begin, end_ in pieces(texts):
                part = texts[begin:end_]
                hashes, start, end, first, joined = word_hashes(part)
                found: dict[tuple[int, int], list] = {}
                words: dict[int, list[str]] = {}
                for at, who, place in index.hits(gram_hashes(hashes, index.piece)):
                    doc = np.searchsorted(first, at, "right") - 1
                    inside = at + index.piece <= first[doc + 1]
                    doc, at, who, place = doc[inside], at[inside], who[inside].astype(np.int64), place[inside].astype(np.int64)
                    good = index.verify(hashes, (first[doc], first[doc + 1]), doc, at, who, place)
                    exact = {key for key, (best, _, _) in good.items() if best == 0}
                    hits: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
                    if exact:
                        code = who * len(part) + doc
                        near = np.isin(code, np.array([n * len(part) + d for d, n in exact]))
                        for d, n, i, j in zip(doc[near].tolist(), who[near].tolist(), at[near].tolist(), place[near].tolist()):
                            hits[d, n].append((i - int(first[d]), j))
                    for (d, n), (best, _, _) in good.items():
                        longest = None
                        if best == 0:
                            if d not in words:
                                a, b = first[d], first[d + 1]
                                words[d] = [joined[s:e] for s, e in zip(start[a:b].tolist(), end[a:b].tolist())]
                            longest = index.run(n, words[d], hits[d, n])
                        # a slice of the hits may hold a part of what a pair has
                        had = found.setdefault((d, n), [best, longest])
                        had[0] = min(had[0], best)
                        had[1] = longest if had[1] is None else max(had[1], longest or 0)
                out += [(ids[begin + d], item, best, longest) for (d, n), (best, longest) in found.items() for item in index.items[n]]
            cols = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], names=["doc_id", "item_id", "distance", "run"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, item_id bigint, distance int, run int")


def exact_leaks(leaks: DataFrame, words: int = WINDOW) -> DataFrame:
    """doc_id and item_id of the leaks with that many equal words in a row."""
    return leaks.where(F.col("run") >= words).select("doc_id", "item_id").distinct()
