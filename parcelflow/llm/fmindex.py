"""Compressed FM-index over words: wavelet matrix of packed bit vectors, backward search, matching statistics."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Rank of symbols in a sequence; one bit vector of 64-bit words with running counts for each bit of a symbol."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.bits, self.before, self.zeros = [], [], []
        seq = seq.astype(np.uint32)
        for k in range(self.levels - 1, -1, -1):
            b = ((seq >> np.uint32(k)) & np.uint32(1)).astype(bool)
            pad = np.zeros((len(b) // 64 + 1) * 64, dtype=bool)
            pad[: len(b)] = b
            words = np.packbits(pad, bitorder="little").view("<u8")
            ones = np.bitwise_count(words).astype(np.uint32)
            self.bits.append(words)
            self.before.append(np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.int64))
            self.zeros.append(int(len(b) - ones.sum()))
            seq = np.concatenate([seq[~b], seq[b]])
        self.first = self._down(np.arange(symbols, dtype=np.int64), np.zeros(symbols, dtype=np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level in range(self.levels):
            word = i >> 6
            mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.before[level][word] + np.bitwise_count(self.bits[level][word] & mask)
            one = ((c >> (self.levels - 1 - level)) & 1).astype(bool)
            i = np.where(one, self.zeros[level] + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c occurs among the first i symbols, for arrays of c and i."""
        return self._down(c, i) - self.first[c]


class FMIndex:
    """Index of a text of words (0 separates segments) whose suffixes are sorted by their first depth words, then by place.

    A backward-search interval of a pattern of at most depth words is then contiguous, and its
    counts are right, as in a fully sorted index; its first entry is the earliest occurrence.
    """

    def __init__(self, text: np.ndarray, depth: int):
        self.depth, n = depth, len(text)
        symbols = int(text.max(initial=0)) + 1
        rank, ranks, size = text.astype(np.int64), {1: text.astype(np.int64)}, 1
        while size * 2 <= depth:
            rank = self._joined(rank, rank, size)
            size *= 2
            ranks[size] = rank
        deep = self._joined(rank, rank, depth - size) if depth > size else rank
        up = self._joined(rank, rank, depth - 1 - size) if depth - 1 > size else (rank if depth - 1 == size else self._joined(ranks[size // 2], ranks[size // 2], depth - 1 - size // 2))
        self.suffix = np.argsort(deep, kind="stable")
        self.start_here = self._starts(deep[self.suffix])
        self.start_up = self._starts(up[self.suffix])
        self.count = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.wavelet = WaveletMatrix(text[self.suffix - 1], symbols)
        self.n = n

    @staticmethod
    def _joined(a: np.ndarray, b: np.ndarray, shift: int) -> np.ndarray:
        """Ranks by (a at i, b at i + shift)."""
        key = a * (int(b.max(initial=0)) + 2)
        key[: len(key) - shift] += b[shift:] + 1
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        out = np.empty(len(key), dtype=np.int64)
        out[order] = np.cumsum(np.concatenate([[0], sorted_key[1:] != sorted_key[:-1]]))
        return out

    @staticmethod
    def _starts(sorted_rank: np.ndarray) -> np.ndarray:
        new = np.concatenate([[True], sorted_rank[1:] != sorted_rank[:-1]])
        return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))

    def extend(self, low: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Starts of the intervals of c followed by the patterns whose intervals start at low."""
        return self.count[c] + self.wavelet.rank(c, low)

    def earliest(self, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Streams segments start..end of text backwards, side by side.

        The length of the current match grows to depth and is kept there by going to the parent
        interval before a word is added. Returns the places at which a match of depth words
        begins, and the earliest place of each such match.
        """
        order = np.argsort(start - end, kind="stable")
        start, end = start[order], end[order]
        length = end - start
        low = np.zeros(len(start), dtype=np.int64)
        places, firsts = [], []
        for step in range(int(length.max(initial=0))):
            alive = int(np.searchsorted(-length, -step, side="left"))
            low = low[:alive]
            at = end[:alive] - 1 - step
            if step >= self.depth:
                low = self.start_up[low]
            low = self.extend(low, text[at])
            if step >= self.depth - 1:
                low = self.start_here[low]
                places.append(at)
                firsts.append(self.suffix[low])
        empty = np.zeros(0, dtype=np.int64)
        return np.concatenate([empty, *places]), np.concatenate([empty, *firsts])
