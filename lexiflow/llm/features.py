"""Numbers about texts for linear classifiers: surface shares, hashed byte pairs, hashed words.

All functions work on the concatenated bytes of a batch, so a text costs a few array operations
per byte whatever its length.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np

#: Byte classes, in this order of columns.
_CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "blank": b" \t",
    "line": b"\n\r",
    "stop": b".,;:'\"-()?",
    "symbol": b"!#$%&*+/<=>@[\\]^_`{|}~",
    "high": bytes(range(128, 256)),
}
SURFACE = (*_CLASSES, "log_bytes", "word_length", "long_word", "one_byte_word", "symbol_end", "symbol_word", "repeat_1", "repeat_2", "stop_end", "capital", "words_a_line", "much_repeat", "distinct", "symbols_root")
PAIR_BINS = 256
#: Bytes of a word's beginning that count as a word of its own.
WORD_BEGIN = 5
DENSE = len(SURFACE) + PAIR_BINS
_CLASS_OF = np.full(256, len(_CLASSES), np.uint8)
for _k, _members in enumerate(_CLASSES.values()):
    _CLASS_OF[list(_members)] = _k
#: Bytes whose words are hashed at once.
STRETCH = 1 << 18


class Flat:
    """Texts of a batch as one byte array, a blank after each, with their words."""

    def __init__(self, texts: Sequence[bytes]) -> None:
        self.n = len(texts)
        self.data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.begin = np.cumsum(self.lengths + 1) - self.lengths - 1
        self.kind = _CLASS_OF[self.data]
        blank = (self.kind == 3) | (self.kind == 4)
        edge = np.flatnonzero(np.diff(np.concatenate(([True], blank)).astype(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]
        self.doc = np.searchsorted(self.begin, self.start, "right") - 1
        self.n_words = np.bincount(self.doc, minlength=self.n)

    def _kept(self, lo: int, hi: int, fold: bool) -> np.ndarray:
        """Which bytes of a stretch count: those of words; with ``fold``, letters, digits and high bytes, and all bytes of a word that has none of those."""
        kind = self.kind[lo:hi]
        inside = (kind != 3) & (kind != 4)
        if not fold:
            return inside
        return ((kind < 3) | (kind == 7)) | (inside & self.bare[lo:hi])

    @functools.cached_property
    def bare(self) -> np.ndarray:
        """Bytes of the words without a letter, digit or high byte."""
        out = np.zeros(len(self.data), bool)
        if len(self.start):
            solid = np.add.reduceat((self.kind < 3) | (self.kind == 7), self.start, dtype=np.int64)
            # A word's stretch ends where the next begins; what lies between is blank, and never counted.
            lone = solid == 0
            step = np.zeros(len(self.data) + 1, np.int8)
            step[self.start[lone]] += 1
            step[self.end[lone]] -= 1
            out = np.cumsum(step[:-1], dtype=np.int8) > 0
        return out

    def word_hashes(self, fold: bool = False, begin: int = 0, family: int = 0) -> tuple[np.ndarray, ...]:
        """A 64-bit hash of each word; with ``begin``, also one of its first so many bytes.

        With ``fold`` a word is its letters, A-Z in lower case, digits and high bytes alone, and places
        are counted among those; a word of other marks only is taken as it is. Each place has a
        factor of its own, whatever the word's length. ``family`` picks independent factors.
        Bytes are gone through in stretches, so memory follows ``STRETCH`` and the number of words.
        """
        sums = [np.zeros(len(self.start), np.uint64) for _ in range(2 if begin else 1)]
        before = 0
        base = np.zeros(len(self.start), np.int64)
        for lo in range(0, len(self.data) if len(self.start) else 0, STRETCH):
            hi = min(lo + STRETCH, len(self.data))
            kept = self._kept(lo, hi, fold)
            first, last = np.searchsorted(self.start, (lo, hi))
            begins = self.start[first:last] - lo
            at = np.flatnonzero(kept)
            base[first:last] = before + np.searchsorted(at, begins)
            if len(at):
                opened = np.zeros(hi - lo, np.int32)
                opened[begins] = 1
                word = np.cumsum(opened, dtype=np.int32)[at] + (first - 1)
                place = np.arange(before, before + len(at)) - base[word]
                byte = self.data[lo:hi][at].astype(np.uint64) + np.uint64(1)
                if fold:
                    byte += (self.kind[lo:hi][at] == 1).astype(np.uint64) * np.uint64(32)
                mixed = byte * _factors(int(place.max()) + 1, family)[place]
                parts = [(word, mixed)]
                if begin:
                    early = place < begin
                    parts.append((word[early], mixed[early]))
                for total, (owner, value) in zip(sums, parts, strict=True):
                    if len(owner):
                        edge = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
                        total[owner[edge]] += np.add.reduceat(value, edge)
            before += len(at)
        return tuple((t ^ (t >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) for t in sums)

    def folded_texts(self) -> list[bytes]:
        """Each text as its folded words, a blank between them."""
        keep = self._kept(0, len(self.data), True)
        keep[self.end] = True  # the blank after each word
        lower = self.data + (self.kind == 1).astype(np.uint8) * np.uint8(32)
        lower[self.end] = 32
        size = np.add.reduceat(keep, self.begin, dtype=np.int64) if self.n else np.zeros(0, np.int64)
        body, stop = lower[keep].tobytes(), np.cumsum(size)
        return [body[e - n : e] for e, n in zip(stop.tolist(), size.tolist(), strict=True)]


def _splitmix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_FACTORS: dict[int, np.ndarray] = {}


def _factors(n: int, family: int) -> np.ndarray:
    """Pseudo-random odd factors of the places 0 to ``n`` - 1 at least; those of usual words are remembered."""
    known = _FACTORS.get(family)
    if known is not None and len(known) >= n:
        return known
    size = max(4096, n)
    made = _splitmix(np.arange(size, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(family * 0x632BE59BD9B4E019 % (1 << 64))) | np.uint64(1)
    if size == 4096:
        _FACTORS[family] = made
    return made


def _distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in order, by one sort, which on these arrays is faster than numpy's hash table."""
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def dense(texts: Sequence[bytes], pairs: bool = True, flat: Flat | None = None) -> np.ndarray:
    """(n, DENSE) float32: what ``SURFACE`` names, then, unless left out, shares of hashed byte pairs. An empty text has zeros."""
    out = np.zeros((len(texts), DENSE if pairs else len(SURFACE)), np.float32)
    if not len(texts):
        return out
    flat = flat or Flat(texts)
    size = np.maximum(flat.lengths, 1).astype(np.float64)
    owner = np.repeat(np.arange(flat.n), flat.lengths + 1)
    k = len(_CLASSES)
    counts = np.bincount(owner * (k + 1) + flat.kind, minlength=flat.n * (k + 1)).reshape(flat.n, k + 1)[:, :k].astype(np.float64)
    counts[:, 3] -= 1  # the blank after each text
    out[:, :k] = counts / size[:, None]
    out[:, k] = np.log1p(flat.lengths)
    words = np.maximum(flat.n_words, 1)
    share = lambda flag: np.bincount(flat.doc, flag, minlength=flat.n) / words
    length = (flat.end - flat.start).astype(np.float64)
    hashes = flat.word_hashes()[0]
    same = lambda d: np.concatenate((np.zeros(min(d, len(hashes))), ((hashes[d:] == hashes[:-d]) & (flat.doc[d:] == flat.doc[:-d])).astype(float)))
    last, first = flat.kind[flat.end - 1] if len(hashes) else flat.kind[:0], flat.kind[flat.start]
    columns = (share(length), share(length > 20), share(length == 1), share(last == 6), share((first == 6) & (length == 1)), share(same(1)), share(same(2)), share(last == 5), share(first == 1))
    for j, c in enumerate(columns):
        out[:, k + 1 + j] = c
    out[:, k + 1 + len(columns)] = np.log1p(words / (counts[:, 4] + 1))
    out[:, k + 2 + len(columns)] = out[:, k + 6] + out[:, k + 7] > 0.3
    met = _distinct((flat.doc.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    distinct = np.bincount((met >> np.uint64(40)).astype(np.int64), minlength=flat.n) / words
    # Against the share that a text of this length has on average: longer texts say old words more often.
    out[:, k + 3 + len(columns)] = distinct * np.log1p(words) / 4
    out[:, k + 4 + len(columns)] = np.sqrt(out[:, 6])
    out[flat.lengths == 0] = 0
    if not pairs:
        return out
    pair = ((flat.data[:-1].astype(np.uint32) * 0x9E37 + flat.data[1:].astype(np.uint32) * 0x85EB) >> 6) & (PAIR_BINS - 1)
    own = np.ones(len(pair), bool)
    own[(flat.begin + flat.lengths)[:-1]] = False  # the blank after a text and the next text's first byte
    table = np.bincount(owner[:-1][own] * PAIR_BINS + pair[own], minlength=flat.n * PAIR_BINS).reshape(flat.n, PAIR_BINS)
    out[:, len(SURFACE) :] = table / size[:, None]
    out[flat.lengths == 0] = 0
    return out


def hashed_words(texts: Sequence[bytes], bins: int, flat: Flat | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct folded words, and beginnings of words, of each text as bins: row of each entry, its bin, its weight (unit length per row)."""
    flat = flat or Flat(texts)
    whole, start = flat.word_hashes(fold=True, begin=WORD_BEGIN)
    codes = [(h * np.uint64(odd) >> np.uint64(20)).astype(np.int64) % bins for h, odd in ((whole, 1), (start, 2 * WORD_BEGIN + 1))]
    key = _distinct(np.concatenate([flat.doc * bins + c for c in codes]))
    row, column = key // bins, key % bins
    per = np.bincount(row, minlength=len(texts))
    return row, column, (1.0 / np.sqrt(np.maximum(per, 1)))[row]
