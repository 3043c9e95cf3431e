"""Removal of passages that stand more than once in a corpus, by an FM-index per shard.

Which shard a window of words belongs to follows from its content: its anchor is the smallest hash
among its runs of eight words, so equal windows have equal anchors. Neighbouring windows mostly
share an anchor and travel together as one segment. Three steps come before the index:

1. Anchors are counted over the corpus. A window whose anchor stands once cannot stand twice.
2. Documents meet the repeated anchors they hold, and cut the segments of those.
3. Equal segments become one, with a weight, so a passage in a third of all documents is one row.

A shard indexes its segments and the same segments are streamed through it: windows whose interval
holds a weight of two or more are repeated, and go back to the documents as intervals of words. An
anchor with more than ``HOT`` places has no shard, as its segments could be as many as documents:
its windows are counted one by one under a 128-bit digest of their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.fm_index import FMIndex
from lexiflow.llm.store import materialize, slices

WINDOW = 35
GRAM = 8
#: Places of an anchor above which its windows are counted without a shard.
HOT = 20_000
#: Places of anchors to a shard, on average.
SHARD_PLACES = 20_000
#: Longer segments, which only a text that repeats itself has, are cut.
SEGMENT_WINDOWS = 64
_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.array([pow(0x100000001B3, k, 1 << 64) for k in range(4096)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` over every ``width`` neighbours, by doubling."""
    reach = 1
    while reach < width:
        more = min(reach, width - reach)
        x = op(x[:-more], x[more:]) if len(x) > more else x[:0]
        reach += more
    return x


def plain(text: str | None) -> bytes:
    """Words of a text (runs of anything but blank and the control blanks 9 to 13), a blank between them, in UTF-8."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").split())


class Windows:
    """Words and window anchors of a batch of plain texts."""

    def __init__(self, texts: Sequence[bytes], window: int) -> None:
        grams = window - GRAM + 1
        self.data = b" ".join([*texts, b""])
        data = np.frombuffer(self.data, np.uint8)
        blank = data == 32
        edge = np.diff(np.concatenate(([True], blank)).astype(np.int8))
        self.start, self.end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        lengths = np.array([len(t) for t in texts], np.int64)
        self.begin = np.cumsum(lengths + 1) - lengths - 1
        self.doc = np.searchsorted(self.begin, self.start, "right") - 1
        self.n_words = np.bincount(self.doc, minlength=len(texts))
        self.first_word = np.cumsum(self.n_words) - self.n_words
        n = len(self.start)
        if n < window:
            self.gram = self.anchor = np.zeros(0, np.uint64)
            return
        inside = np.flatnonzero(~blank)
        owner = np.cumsum(edge == -1)[inside] - 1
        place = inside - self.start[owner]
        word = _mix(np.add.reduceat((data[inside].astype(np.uint64) + np.uint64(1)) * _POWERS[place & 4095], np.cumsum(self.end - self.start) - (self.end - self.start)))
        h, power, reach = word, int(_ODD), 1
        while reach < GRAM:
            h = h[:-reach] * np.uint64(power) + h[reach:]
            power, reach = power * power % (1 << 64), reach * 2
        self.gram = _mix(h) | np.uint64(1)
        anchor = _slide(self.gram, grams, np.minimum)
        valid = self.doc[: len(anchor)] == self.doc[window - 1 : window - 1 + len(anchor)]
        self.anchor = np.where(valid, anchor, np.uint64(0))  # 0: the window would leave its document

    def anchor_places(self) -> tuple[np.ndarray, np.ndarray]:
        """Document and hash of every run of words that is the anchor of some window."""
        if not len(self.anchor):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        grams = len(self.gram) - len(self.anchor) + 1
        pad = np.zeros(grams - 1, np.uint64)
        highest = _slide(np.concatenate((pad, self.anchor, pad)), grams, np.maximum)
        at = np.flatnonzero(self.gram == highest)
        return self.doc[at], self.gram[at]

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First window, number of windows, and anchor of each run of windows with one anchor."""
        edge = np.ones(len(self.anchor), bool)
        edge[1:] = (self.anchor[1:] != self.anchor[:-1]) | (self.doc[1 : len(self.anchor)] != self.doc[: len(self.anchor) - 1])
        first = np.flatnonzero(edge)
        size = np.diff(np.append(first, len(self.anchor)))
        keep = self.anchor[first] != 0
        return first[keep], size[keep], self.anchor[first[keep]]


def _anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            doc, gram = Windows([plain(t) for t in batch.column("text").to_pylist()], window).anchor_places()
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("rid").take(take), pa.array(gram.view(np.int64))], ["id", "rid", "anchor"])

    return run


def _cut(window: int, shards: int):
    """Segments of repeated anchors; a row says where it stands, and the words stand in one row per content and task at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in slices(batches, "text", 4 << 20):
            w = Windows([plain(t) for t in batch.column("text").to_pylist()], window)
            first, size, anchor = w.segments()
            held = batch.column("anchors")
            owner = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(held).to_numpy())
            wanted = _mix(held.flatten().field("anchor").to_numpy().view(np.uint64) ^ (owner.astype(np.uint64) * _ODD))
            hot = held.flatten().field("hot").to_numpy(zero_copy_only=False)
            mine = _mix(anchor ^ (w.doc[first].astype(np.uint64) * _ODD)) if len(first) else np.zeros(0, np.uint64)
            order = np.argsort(wanted)
            at = np.minimum(np.searchsorted(wanted[order], mine), max(len(wanted) - 1, 0))
            rows: list[tuple] = []
            if len(wanted):
                hit = np.flatnonzero(wanted[order][at] == mine)
                ids, rids = batch.column("id").to_pylist(), batch.column("rid").to_pylist()
                docs = w.doc[first]
                for j in hit.tolist():
                    d, a, n = int(docs[j]), int(first[j]), int(size[j])
                    single = bool(hot[order[at[j]]])
                    step = 1 if single else SEGMENT_WINDOWS
                    shard = None if single else int(anchor[j] % np.uint64(shards))
                    for k in range(a, a + n, step):
                        last = min(k + step, a + n) - 1 + window - 1
                        words = w.data[w.start[k] : w.end[last]]
                        key = hashlib.blake2b(words, digest_size=16).digest()
                        fresh = not single and key not in seen
                        if fresh:
                            if len(seen) > 1_000_000:
                                seen.clear()
                            seen.add(key)
                        rows.append((shard, key, words if fresh else None, ids[d], rids[d], k - int(w.first_word[d])))
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32())
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["shard", "key", "words", "id", "rid", "first"])

    return run


def _search(window: int):
    """Index one shard and stream its segments through it: the repeated windows of each, as runs."""

    def run(table: pa.Table) -> pa.Table:
        keys = table.column("key").to_pylist()
        sequences = [x.split(b" ") for x in table.column("words").to_pylist()]
        index = FMIndex(sequences, np.minimum(table.column("places").to_numpy(), 2), window)
        out_keys, out_spans = [], []
        for key, counts in zip(keys, index.window_counts(sequences), strict=True):
            edge = np.flatnonzero(np.diff(np.concatenate(([False], counts >= 2, [False])).astype(np.int8)))
            if len(edge):
                out_keys.append(key)
                out_spans.append(edge.tolist())
        return pa.table({"key": pa.array(out_keys, pa.binary()), "spans": pa.array(out_spans, pa.list_(pa.int32()))})

    return run


def _remove(window: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            rows = []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist(), strict=True):
                data = plain(text)
                words = data.split()
                spans: list[tuple[int, int]] = []
                if found:
                    cover = np.zeros(len(words) + 1, np.int64)
                    for f in found:
                        s = np.array(f["spans"], np.int64) + f["first"]
                        np.add.at(cover, s[::2], 1)
                        np.add.at(cover, s[1::2] + window - 1, -1)
                    gone = np.cumsum(cover)[:-1] > 0
                    edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8))).tolist()
                    spans = list(zip(edges[::2], edges[1::2], strict=True))
                    pieces, last = [], 0
                    for a, b in spans:
                        pieces += words[last:a]
                        last = b
                    data = b" ".join(pieces + words[last:])
                row = (len(words), sum(b - a for a, b in spans), hashlib.sha256(data).hexdigest(), [{"start": a, "end": b} for a, b in spans])
                rows.append((*row, data.decode("utf-8", "surrogatepass")) if keep_text else row)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), *[pa.string()] * keep_text)
            names = ["id", "n_words", "n_removed", "kept_sha256", "removed", *["kept"] * keep_text]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, hot: int = HOT, shard_places: int = SHARD_PLACES, keep_text: bool = True) -> DataFrame:
    """One row per input row: ``id_col``, n_words, n_removed, kept_sha256, removed (array of start, end in words), kept (text, if asked for).

    A word goes if any window that covers it has a word sequence that also starts anywhere else in
    the table, the same document included. So all copies of a passage go, and repeated rows lose
    all their windows. A null text has no words; a text with fewer words than a window keeps them
    all; an empty table gives no rows; other columns are not looked at.
    """
    if window < GRAM:
        raise ValueError(f"a window has {GRAM} words at least")

    def rows() -> DataFrame:
        text: Column = F.col(text_col).cast("string")
        return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(id_col).cast("long"), text).alias("rid"), text.alias("text"))

    places = materialize(rows().mapInArrow(_anchors(window), "id long, rid long, anchor long"), "anchors")
    # Stored, so that both sides of the join are plain exchanges and Spark can split a frequent anchor's.
    repeated = materialize(places.groupBy("anchor").agg(F.count("*").alias("places")).filter("places > 1"), "repeated-anchors")
    held = places.join(repeated, "anchor").groupBy("id", "rid").agg(F.collect_set(F.struct("anchor", (F.col("places") > hot).alias("hot"))).alias("anchors"))
    held = materialize(held, "held-anchors").select(F.col("id").alias("hid"), F.col("rid").alias("hrid"), "anchors")
    shards = max(1, -(-(held.agg(F.sum(F.size("anchors"))).first()[0] or 0) // shard_places))
    texts = rows()
    joined = texts.join(held, F.col("id").eqNullSafe(F.col("hid")) & (F.col("rid") == F.col("hrid"))).select("id", "rid", "text", "anchors")
    cut = materialize(joined.mapInArrow(_cut(window, shards), "shard int, key binary, words binary, id long, rid long, first int"), "segments")
    distinct = cut.filter("shard IS NOT NULL").groupBy("shard", "key").agg(F.max("words").alias("words"), F.count("*").alias("places"))
    in_shard = distinct.groupBy("shard").applyInArrow(_search(window), "key binary, spans array<int>")
    single = cut.filter("shard IS NULL").groupBy("key").count().filter("count > 1").select("key", F.array(F.lit(0), F.lit(1)).alias("spans"))
    # A key of one window may come from both: they say the same.
    spans = materialize(in_shard.unionByName(single).dropDuplicates(["key"]), "spans")
    found = cut.select("key", "id", "rid", "first").join(spans, "key")
    found = found.groupBy("id", "rid").agg(F.collect_list(F.struct("first", "spans")).alias("found")).select(F.col("id").alias("fid"), F.col("rid").alias("frid"), "found")
    found = materialize(found, "found")
    schema = "id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<start:int,end:int>>" + ", kept string" * keep_text
    last = rows().join(found, F.col("id").eqNullSafe(F.col("fid")) & (F.col("rid") == F.col("frid")), "left").select("id", "text", "found")
    return last.mapInArrow(_remove(window, keep_text), schema).withColumnRenamed("id", id_col)
