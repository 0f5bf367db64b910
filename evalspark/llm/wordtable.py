"""A table of words that finds them among the words of many texts at once."""

from __future__ import annotations

import numpy as np

from . import common


class WordTable:
    """Different words as bytes, numbered in the given order; found by hash and then compared byte by byte."""

    def __init__(self, words: list[bytes]) -> None:
        self.words = words
        self.size = np.array([len(t) for t in words], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(words), np.uint8)
        hashes = common.SpanHash(self.data)(self.start, self.start + self.size)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        if len(self.hashes) and (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("a word is given twice, or two words share a 64-bit hash")

    def find(self, low: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the spans that are words of the table, and the numbers of these words."""
        if not len(self.words) or not len(start):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        own = common.SpanHash(low)(start, stop)
        at = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == own)
        word = self.order[at[hit]]
        fits = self.size[word] == stop[hit] - start[hit]
        hit, word = hit[fits], word[fits]
        size = self.size[word]
        same = low[common.ranges(start[hit], size)] == self.data[common.ranges(self.start[word], size)]
        if not same.all():
            fits = np.logical_and.reduceat(same, np.cumsum(size) - size)
            hit, word = hit[fits], word[fits]
        return hit, word


def words_of(text: str) -> list[bytes]:
    """The words of one text (letters, digits and non-ASCII characters) as bytes, A-Z as a-z."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    start, stop, _ = common.word_spans(np.array([0, len(data)]), data, common.ALPHANUMERIC)
    low = common.LOWER[data].tobytes()
    return [low[a:b] for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
