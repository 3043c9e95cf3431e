"""An FM-index over a shard of word sequences, for windows of a fixed number of words.

The Burrows-Wheeler transform of the shard lies in a wavelet matrix: a bit vector per bit of a
symbol, packed in 64-bit words with a count per word. Backward search extends a pattern to the
left with two rank queries. Suffixes need to be in order of their first ``depth`` words only:
an interval of a pattern of that length is a class of equal prefixes, and from any row of it, a
bit vector of class borders gives the whole interval back. So a document is streamed from its end
to its start, one step per word: extend by the next word, then fall back to ``depth`` words.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

SEPARATOR = 0


class BitVector:
    """Packed bits with rank."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))[:-1].astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        at = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at] + np.bitwise_count(self.words[at] & mask)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, size: int) -> None:
        self.bits = max(1, int(size - 1).bit_length())
        self.levels: list[tuple[BitVector, int]] = []
        now = symbols
        for b in range(self.bits - 1, -1, -1):
            one = (now >> b) & 1 == 1
            self.levels.append((BitVector(one), int(len(one) - one.sum())))
            now = np.concatenate((now[~one], now[one]))
        every = np.arange(size)
        self.base = self._down(every, np.zeros(size, np.int64))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, (vector, zeros) in enumerate(self.levels):
            ones = vector.rank(i)
            i = np.where((symbol >> (self.bits - 1 - k)) & 1 == 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._down(symbol, i) - self.base[symbol]


def _ranks(key: np.ndarray) -> np.ndarray:
    return np.unique(key, return_inverse=True)[1].astype(np.int64)


def _prefix_ranks(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Rank of each suffix by its first ``depth`` symbols (past the end counts as the smallest)."""

    def ahead(rank: np.ndarray, k: int) -> np.ndarray:
        return np.concatenate((rank[k:] + 1, np.zeros(min(k, len(rank)), np.int64)))[: len(rank)]

    rank, length = _ranks(symbols), 1
    while length < depth:
        top = int(rank.max()) + 2
        if length * 3 <= depth and top < 1 << 21:
            rank, length = _ranks((rank * top + ahead(rank, length)) * top + ahead(rank, 2 * length)), length * 3
        else:
            more = min(length, depth - length)
            rank, length = _ranks(rank * top + ahead(rank, more)), length + more
    return rank


class FMIndex:
    """Index of sequences of words. ``weights`` say how often each sequence stands in the shard."""

    def __init__(self, sequences: Sequence[Sequence[bytes]], weights: Sequence[int], depth: int) -> None:
        self.depth = depth
        ids: dict[bytes, int] = {}
        lengths = np.array([len(s) + 1 for s in sequences], np.int64)
        symbols = np.zeros(int(lengths.sum()), np.int64)
        at = 0
        for s in sequences:
            symbols[at : at + len(s)] = [ids.setdefault(w, len(ids) + 1) for w in s]
            at += len(s) + 1
        self.ids, size = ids, len(ids) + 1
        rank = _prefix_ranks(symbols, depth)
        suffix = np.argsort(rank, kind="stable")
        self.n = len(symbols)
        self.wavelet = WaveletMatrix(symbols[suffix - 1], size)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=size))))
        of_row = np.repeat(np.asarray(weights, np.int64), lengths)[suffix]
        self.weight = np.concatenate(([0], np.cumsum(of_row)))
        ordered = rank[suffix]
        border = np.concatenate(([True], ordered[1:] != ordered[:-1]))
        self.classes = BitVector(border)
        self.class_start = np.append(np.flatnonzero(border), self.n)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with ``symbol`` put before them."""
        return self.first[symbol] + self.wavelet.rank(symbol, low), self.first[symbol] + self.wavelet.rank(symbol, high)

    def widen(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of all suffixes that share their first ``depth`` words with the suffix in row ``low``."""
        c = self.classes.rank(low + 1) - 1
        return self.class_start[c], self.class_start[c + 1]

    def count(self, patterns: np.ndarray) -> np.ndarray:
        """Weighted number of places of each row of symbols (-1: a word that is not in the shard), by plain backward search."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for k in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[:, k]
            low, high = self.extend(np.maximum(symbol, 0), low, high)
            high = np.where(symbol < 0, low, high)
            high = np.maximum(low, high)
        return self.weight[high] - self.weight[low]

    def window_counts(self, documents: Sequence[Sequence[bytes]]) -> list[np.ndarray]:
        """For each document, the weighted number of places in the shard of each of its windows.

        A window that does not occur breaks the chain; it and the windows that the chain has not
        reached again are counted one by one.
        """
        depth = self.depth
        lengths = np.array([len(d) for d in documents], np.int64)
        flat = np.array([self.ids.get(w, -1) for d in documents for w in d], np.int64)
        ends = np.cumsum(lengths)
        order = np.argsort(-lengths, kind="stable")
        sizes, end = lengths[order], ends[order]
        n = len(order)
        low, high, have = np.zeros(n, np.int64), np.full(n, self.n, np.int64), np.zeros(n, np.int64)
        found = np.full(len(flat), -1, np.int64)
        for t in range(int(sizes[0]) if n else 0):
            live = int(np.searchsorted(-sizes, -t, "left"))
            place = end[:live] - 1 - t
            symbol = flat[place]
            a, b = self.extend(np.maximum(symbol, 0), low[:live], high[:live])
            broken = (symbol < 0) | (b <= a)
            depths = np.where(broken, 0, have[:live] + 1)
            over = np.flatnonzero(depths > depth)
            if len(over):
                a[over], b[over] = self.widen(a[over])
                depths[over] = depth
            full = depths == depth
            found[place[full]] = self.weight[b[full]] - self.weight[a[full]]
            low[:live], high[:live], have[:live] = np.where(broken, 0, a), np.where(broken, self.n, b), depths
        begin = ends - lengths
        out = []
        rest: list[np.ndarray] = []
        for s, e in zip(begin.tolist(), ends.tolist(), strict=True):
            counts = found[s : max(s, e - depth + 1)]
            rest.append(s + np.flatnonzero(counts < 0))
            out.append(counts)
        missing = np.concatenate(rest) if rest else np.zeros(0, np.int64)
        if len(missing):
            found[missing] = self.count(flat[missing[:, None] + np.arange(depth)])
            out = [found[s : max(s, e - depth + 1)] for s, e in zip(begin.tolist(), ends.tolist(), strict=True)]
        return out
