"""Exact de-duplication by deterministic block naming.

Each normalised text is cut into blocks of a fixed number of bytes. Equal blocks get one integer
name, different blocks different names: names are positions in sorted order, so they never
collide. Adjacent names are then paired and the distinct pairs named in the same way, until every
document has a single name. Two texts are equal exactly when they have the same number of blocks
and the same last name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.store import RowIds, materialize, slices

BLOCK_BYTES = 4096


def normalise(text: str | None) -> bytes:
    """UTF-8 of the text with A-Z in lower case and nothing else changed; a missing text is empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def _contents(size: int):
    """Distinct blocks of each slice: digest and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found: dict[bytes, bytes] = {}
            for text in batch.column("text").to_pylist():
                data = normalise(text)
                for i in range(0, max(len(data), 1), size):
                    block = data[i : i + size]
                    found[hashlib.sha256(block).digest()] = block
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.binary())], ["digest", "block"])

    return run


def _places(size: int):
    """A row for each block of each document: where it stands and its digest; block 0 carries the text's own digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = RowIds()
        for batch in slices(batches, "text"):
            rows: list[tuple] = []
            texts, keys = batch.column("text").to_pylist(), batch.column("id").to_pylist()
            for rid, key, text in zip(ids.take(len(texts)), keys, texts, strict=True):
                data = normalise(text)
                whole = hashlib.sha256(data).digest()
                n = max(1, -(-len(data) // size))
                rows += [(rid, key, n, i, hashlib.sha256(data[i * size : (i + 1) * size]).digest() if n > 1 else whole, None if i else whole) for i in range(n)]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["rid", "id", "n_blocks", "pos", "digest", "text_digest"])

    return run


def _named(distinct: DataFrame, by: list[str], label: str, keep: list[str] | None = None) -> DataFrame:
    """Give each row of ``distinct`` an integer name, its place in the sorted order of its partition, and store ``keep`` (or ``by``) with it."""
    return materialize(distinct.sortWithinPartitions(*by).select(*(keep or by), F.monotonically_increasing_id().alias("name")), label)


def name_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: rid (row number), id, n_blocks, name, text_digest (SHA-256 of the normalised text).

    Names are given to block contents, not to digests. Rows only find their name by digest, and the
    run stops if one digest stands for two contents, so names stay free of collisions.
    Block contents are shuffled once, after equal ones have met in their own task; what follows is
    integers.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    contents = source.select("text").mapInArrow(_contents(block_bytes), "digest binary, block binary").groupBy("digest", "block").agg(F.lit(1).alias("one"))
    names = _named(contents.select("digest", "block"), ["block"], "block-names", ["digest"])
    places = source.mapInArrow(_places(block_bytes), "rid long, id long, n_blocks int, pos int, digest binary, text_digest binary")
    clash = names.groupBy("digest").count().filter("count > 1").select("digest")
    if not clash.isEmpty():
        raise ArithmeticError("two different blocks share a SHA-256 digest; use another digest")
    level = places.join(names.select("digest", "name"), "digest")
    level = materialize(level.select("rid", "id", "n_blocks", "pos", "name", "text_digest"), "block-level")
    whole = level.filter("pos = 0").select("rid", "id", "n_blocks", "text_digest", "name")
    most = level.agg(F.max("n_blocks")).first()[0] or 1
    if most == 1:
        return whole
    part = level.filter("n_blocks > 1").select("rid", "n_blocks", "pos", "name")
    done, width = [], 1
    while width < most:
        width *= 2
        half = F.col("pos").bitwiseAND(1)
        pairs = part.groupBy("rid", "n_blocks", F.shiftright("pos", 1).alias("pos")).agg(
            F.max(F.when(half == 0, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(half == 1, F.col("name"))), F.lit(-1)).alias("right")
        )
        pairs = materialize(pairs, "pairs")
        names = _named(pairs.select("left", "right").distinct(), ["left", "right"], "pair-names")
        part = pairs.join(names, ["left", "right"]).select("rid", "n_blocks", "pos", "name")
        done.append(part.filter(F.col("n_blocks") <= width).select("rid", "name"))
        part = materialize(part.filter(F.col("n_blocks") > width), "pair-level") if width < most else part
    last = done[0]
    for d in done[1:]:
        last = last.unionByName(d)
    long = whole.filter("n_blocks > 1").drop("name").join(last, "rid")
    return whole.filter("n_blocks = 1").unionByName(long)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. Of equal texts the row with the largest
    id stays; of several rows with that id, one. A null text counts as empty, a null id sorts below
    all others, an empty table gives no rows, and other columns are not looked at.
    """
    named = materialize(name_documents(docs, id_col, text_col, block_bytes), "named")
    # Stored, so that both sides of the join are plain exchanges and Spark can split a large group's.
    top = materialize(named.groupBy("n_blocks", "name").agg(F.max(F.struct("id", "rid")).alias("top"), F.count("*").alias("group_size")), "groups")
    return named.join(top, ["n_blocks", "name"]).select(
        F.col("id").alias(id_col), F.col("top.id").alias("keep_id"), "group_size", (F.col("rid") == F.col("top.rid")).alias("kept"), F.lower(F.hex("text_digest")).alias("text_sha256")
    )
