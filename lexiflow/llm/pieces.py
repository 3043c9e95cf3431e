"""SentencePiece byte-pair encoding in vectorised merge rounds.

A text becomes words: a run of word marks with what follows up to the next one. No piece of a
usable model crosses such a border, which is checked when the model is read. The words of a batch
that were not seen before lie in flat arrays of symbols. A round looks up the merge of each
adjacent pair, finds the best one of every word (a segmented minimum), merges it in all words at
once, and closes the gaps; rounds go on until no word has a pair left to merge.

Within a word, all leftmost non-overlapping occurrences of the best pair merge in one round when
its piece cannot take part in a better merge; if it can, the first occurrence merges alone, which
is the order in which the library goes.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.store import slices

MARK = "▁"
_WORD = re.compile(f"{MARK}*[^{MARK}]*")
#: Bytes, by estimate, of the words that a Python worker remembers with their ids before it starts afresh; longer words are not remembered.
CACHE_BYTES, CACHE_LENGTH = 32 << 20, 64
#: What Python needs for an entry beside its characters.
ENTRY_BYTES = 330


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes | float]]:
    """Field numbers and values of a protocol buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[i : i + n]
            i += n
        elif kind == 5:
            yield tag >> 3, struct.unpack_from("<f", data, i)[0]
            i += 4
        elif kind == 1:
            yield tag >> 3, struct.unpack_from("<d", data, i)[0]
            i += 8
        else:
            raise ValueError(f"wire type {kind} in a model file")


class PieceModel:
    """A byte-pair model with byte fallback, an identity normaliser and a leading word mark."""

    NORMAL, BYTE = 1, 6

    def __init__(self, proto: bytes) -> None:
        self.pieces: list[str] = []
        scores: list[float] = []
        kinds: list[int] = []
        self.prefix = True
        for number, value in _fields(proto):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(piece.get(2, 0.0))
                kinds.append(piece.get(3, self.NORMAL))
            elif number == 2 and dict(_fields(value)).get(3) != 2:
                raise ValueError("not a byte-pair model")
            elif number == 3:
                spec = dict(_fields(value))
                if spec.get(2) or spec.get(4, 1):
                    raise ValueError("only models without normalisation rules are read")
                self.prefix = bool(spec.get(3, 1))
        normal = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == self.NORMAL}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in normal):
            raise ValueError("a piece crosses a word border")
        self.bytes = np.array([self.pieces.index(f"<0x{b:02X}>") for b in range(256)], np.int64)
        self.byte_of = {int(p): b for b, p in enumerate(self.bytes)}
        self.kinds = kinds
        # Symbols are pieces, then single characters that are no piece (they never merge).
        self.char_id = {p: i for p, i in normal.items() if len(p) == 1}
        # Equal scores have equal ranks: the leftmost of them goes first.
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in normal.values()}, reverse=True))}
        n = len(self.pieces)
        rank_of = np.full(n, np.iinfo(np.int64).max)
        for i in normal.values():
            rank_of[i] = order[scores[i]]
        keys, made = [], []
        early = np.zeros(n, bool)
        for piece, i in normal.items():
            for cut in range(1, len(piece)):
                left, right = normal.get(piece[:cut]), normal.get(piece[cut:])
                if left is not None and right is not None:
                    keys.append(left * n + right)
                    made.append(i)
                    for part in (left, right):
                        if rank_of[i] <= rank_of[part]:
                            early[part] = True
        sort = np.argsort(np.array(keys, np.int64))
        self.keys, self.made = np.array(keys, np.int64)[sort], np.array(made, np.int64)[sort]
        self.n, self.rank_of, self.early = n, rank_of, early
        # A merge is found by its pair: left symbols have their merges side by side, so a hash of both is looked up first.
        bits = max(16, int(len(keys)).bit_length() + 4)
        self.shift = np.uint64(64 - bits)
        self.maybe = np.zeros(1 << bits, bool)
        self.maybe[self._slot(self.keys)] = True

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def merge_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, or -1."""
        out = np.full(len(left), -1, np.int64)
        key = left * self.n + right
        can = np.flatnonzero((left < self.n) & (right < self.n))
        can = can[self.maybe[self._slot(key[can])]]
        at = np.minimum(np.searchsorted(self.keys, key[can]), len(self.keys) - 1)
        hit = self.keys[at] == key[can]
        out[can[hit]] = self.made[at[hit]]
        return out

    def words(self, text: str) -> list[str]:
        """The words of a text as it is after the model's own preparation of blanks."""
        marked = text.replace(" ", MARK)
        return _WORD.findall(MARK + marked if self.prefix and text else marked)[:-1]

    def encode_words(self, words: Sequence[str]) -> list[np.ndarray]:
        """Ids of each word, by merge rounds over all words together."""
        lengths = np.array([len(w) for w in words], np.int64)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        chars, inverse = np.unique(codes, return_inverse=True)
        symbols = np.array([self.char_id.get(chr(c), self.n + int(c)) for c in chars], np.int64)[inverse]
        word = np.repeat(np.arange(len(words)), lengths)
        done_symbols, done_words = [], []
        merged = self.merge_of(symbols[:-1], symbols[1:]) if len(symbols) > 1 else np.empty(0, np.int64)
        merged[word[:-1] != word[1:]] = -1
        never = np.iinfo(np.int64).max
        while len(symbols):
            rank = np.where(merged >= 0, self.rank_of[merged], never)
            rank = np.append(rank, never)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, first)
            counts = np.diff(np.append(first, len(symbols)))
            going = best < never
            if not going.all():
                over = np.repeat(~going, counts)
                done_symbols.append(symbols[over])
                done_words.append(word[over])
                stay = ~over
                symbols, word, rank = symbols[stay], word[stay], rank[stay]
                merged = np.append(merged, -1)[stay]
                best, counts = best[going], counts[going]
                first = np.cumsum(counts) - counts
                if not len(symbols):
                    break
            else:
                merged = np.append(merged, -1)
            place = np.flatnonzero(rank == np.repeat(best, counts))
            # Leftmost first: of a chain of overlapping pairs every second one goes, and only the first pair of a word whose piece may merge on early.
            chain = np.append(True, (np.diff(place) != 1) | (word[place[1:]] != word[place[:-1]]))
            begins = np.flatnonzero(chain)
            step = np.arange(len(place)) - np.repeat(begins, np.diff(np.append(begins, len(place))))
            alone = np.append(True, word[place[1:]] != word[place[:-1]])
            careful = self.early[merged[place]]
            if careful.any():
                lead = np.maximum.accumulate(np.where(alone, np.arange(len(place)), 0))
                careful = np.logical_or.reduceat(careful, np.flatnonzero(alone))[np.cumsum(alone) - 1]
                pick = np.where(careful, np.arange(len(place)) == lead, step % 2 == 0)
            else:
                pick = step % 2 == 0
            place = place[pick]
            symbols[place] = merged[place]
            keep = np.ones(len(symbols), bool)
            keep[place + 1] = False
            fresh = np.zeros(len(symbols), bool)
            fresh[place] = True
            symbols, word, merged, fresh = symbols[keep], word[keep], merged[keep], fresh[keep]
            merged[-1] = -1
            merged = merged[:-1]
            again = np.flatnonzero(fresh[:-1] | fresh[1:])
            again_merged = self.merge_of(symbols[again], symbols[again + 1])
            again_merged[word[again] != word[again + 1]] = -1
            merged[again] = again_merged
        all_symbols, all_words = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(all_words, kind="stable")
        ids, owner = self._fall_back(all_symbols[order], all_words[order])
        return np.split(ids, np.searchsorted(owner, np.arange(1, len(words))))

    def _fall_back(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece as the pieces of their bytes."""
        odd = np.flatnonzero(symbols >= self.n)
        if not len(odd):
            return symbols, owner
        codes, inverse = np.unique(symbols[odd], return_inverse=True)
        parts = [self.bytes[np.frombuffer(chr(int(c) - self.n).encode("utf-8", "surrogatepass"), np.uint8)] for c in codes]
        sizes = np.ones(len(symbols), np.int64)
        sizes[odd] = np.array([len(p) for p in parts])[inverse]
        out = np.repeat(symbols, sizes)
        start = (np.cumsum(sizes) - sizes)[odd]
        for k in range(4):
            has = np.array([len(p) > k for p in parts])[inverse]
            value = np.array([p[min(k, len(p) - 1)] for p in parts])[inverse]
            out[start[has] + k] = value[has]
        return out, np.repeat(owner, sizes)

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: pieces and runs of byte pieces in a row, the leading mark dropped."""
        out = bytearray()
        for k in ids:
            byte = self.byte_of.get(int(k))
            if byte is None:
                out += self.pieces[k].encode()
            else:
                out.append(byte)
        text = out.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


class Encoder:
    """A model with the ids of the words it has met, and their text as decoded from those ids."""

    def __init__(self, model: PieceModel) -> None:
        self.model = model
        self.known: dict[str, tuple[str, int, str]] = {}
        self.held = 0

    def learn(self, words: set[str]) -> dict[str, tuple[str, int, str]]:
        """Ids (as text), their number and decoded text of every word; what is not known goes through the merge rounds."""
        known = self.known
        new = [w for w in words if w not in known]
        if not new:
            return known
        if self.held > CACHE_BYTES:
            known = self.known = {}
            self.held, new = 0, list(words)
        long: dict[str, tuple[str, int, str]] = {}
        for w, ids in zip(new, self.model.encode_words(new), strict=True):
            got = ids.tolist()
            entry = (",".join(map(str, got)), len(got), self._surface(got))
            if len(w) <= CACHE_LENGTH:
                known[w] = entry
                self.held += ENTRY_BYTES + 2 * len(w) + len(entry[0])
            else:
                long[w] = entry
        return {**known, **long} if long else known

    def _surface(self, ids: list[int]) -> str:
        model, out = self.model, bytearray()
        for k in ids:
            byte = model.byte_of.get(k)
            if byte is None:
                out += model.pieces[k].encode()
            else:
                out.append(byte)
        return out.decode("utf-8", "replace").replace(MARK, " ")


@functools.lru_cache(maxsize=2)
def _encoder(proto: bytes) -> Encoder:
    """One per Python worker: the next task finds the words of the last."""
    return Encoder(PieceModel(proto))


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, text: bool = True) -> DataFrame:
    """One row per input row: ``id_col``, n_tokens, ids (array, if asked for), decoded (text, if asked for), ids_sha256, decoded_sha256.

    ``model_path`` is read on the driver and its bytes go to the tasks with the plan (half a MB
    for 32,000 pieces). A null or empty text has no ids and decodes to an empty text. Texts of
    any length are encoded whole; repeated rows stay; an empty table gives no rows; other columns
    are not looked at.
    """
    with open(model_path, "rb") as f:
        proto = f.read()
    schema = "id long, n_tokens long" + ", ids array<int>" * ids + ", decoded string" * text + ", ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(proto)
        prefix = encoder.model.prefix
        for batch in slices(batches, "text", 1 << 20):
            cut = [encoder.model.words(t or "") for t in batch.column("text").to_pylist()]
            known = encoder.learn(set().union(*cut))
            rows = []
            for words in cut:
                entries = [known[w] for w in words]
                joined = ",".join([e[0] for e in entries])
                decoded = "".join([e[2] for e in entries])
                if prefix:
                    decoded = decoded[1:]
                row = [sum([e[1] for e in entries])]
                if ids:
                    row.append(np.fromstring(joined, np.int32, sep=",") if joined else np.empty(0, np.int32))
                if text:
                    row.append(decoded)
                rows.append((*row, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest()))
            kinds = [pa.int64(), *[pa.list_(pa.int32())] * ids, *[pa.string()] * text, pa.string(), pa.string()]
            names = ["id", "n_tokens", *["ids"] * ids, *["decoded"] * text, "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)
