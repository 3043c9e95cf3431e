"""Subword encoding by a SentencePiece model, and features of the ids."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType


@functools.lru_cache(maxsize=2)
def _processor(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def encoder(model: bytes):
    """A column function from text to ids; a null text has none."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def encode(s: pd.Series) -> pd.Series:
        return pd.Series(_processor(model).encode(s.fillna("").tolist(), num_threads=1))

    return encode


def decoder(model: bytes, end_id: int | None = None):
    """A column function from ids to text, an end mark left out."""

    @F.pandas_udf(StringType())
    def decode(s: pd.Series) -> pd.Series:
        return pd.Series([_processor(model).decode([int(k) for k in ids if k != end_id]) for ids in s])

    return decode


def source_rarity(df: DataFrame, key: str, ids: str, counts: DataFrame, byte_ids: list[int]) -> DataFrame:
    """key, mean and least training count of the ids, share of byte pieces; zeros without ids. ``counts`` (token_id, n) has a row per vocabulary entry at most."""
    each = df.select(key, F.explode(ids).alias("token_id")).join(F.broadcast(counts), "token_id", "left").fillna(0, ["n"])
    got = each.groupBy(key).agg(F.avg("n").alias("mean"), F.min("n").cast("double").alias("least"), F.avg(F.col("token_id").isin(byte_ids).cast("double")).alias("byte_share"))
    return df.select(key).join(got, key, "left").fillna(0.0, ["mean", "least", "byte_share"])


#: Words that a worker remembers the numbers of, and the longest of them.
MOST_WORDS, LONGEST_WORD = 200_000, 64
WORD = regex.compile(r"[\p{L}\p{N}_]+")


class _Numbers(dict):
    """Numbers of words: the first 28 bits of MD5, modulo the size of the vocabulary. Each word is hashed once while it is remembered."""

    def __init__(self, size: int) -> None:
        super().__init__()
        self.size = size

    def __missing__(self, word: str) -> int:
        n = int(hashlib.md5(word.encode()).hexdigest()[:7], 16) % self.size
        if len(self) >= MOST_WORDS:
            self.clear()
        if len(word) <= LONGEST_WORD:
            self[word] = n
        return n


@functools.lru_cache(maxsize=4)
def _numbers(size: int) -> _Numbers:
    return _Numbers(size)


def word_numbers(size: int):
    """A column function from text to the numbers of its words, below ``size``; a null text has none."""

    @F.arrow_udf(ArrayType(IntegerType()))
    def number(texts: pa.Array) -> pa.Array:
        get = _numbers(size).__getitem__
        lists = [None if t is None else np.fromiter(map(get, WORD.findall(t)), np.int32) for t in texts.to_pylist()]
        return pa.array(lists, pa.list_(pa.int32()))

    return number


def untranslated(known: Iterable[int]):
    """A column function from a hypothesis' and a source's ids (32-bit) to the share of the first, repeats included, that the source has and the training target never had (``known``: ids it had); 0 without ids."""
    had = np.unique(np.fromiter(known, np.int64))

    @F.arrow_udf(DoubleType())
    def share(hyp: pa.Array, src: pa.Array) -> pa.Array:
        n = pc.fill_null(pc.list_value_length(hyp), 0).to_numpy(zero_copy_only=False)
        keys = []
        for lists in (hyp, src):
            rows, ids = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (pc.list_parent_indices(lists), lists.flatten()))
            new = ~np.isin(ids, had)
            keys.append(rows[new] << 32 | ids[new] & 0xFFFFFFFF)
        hits = keys[0][np.isin(keys[0], keys[1])] >> 32
        return pa.array(np.bincount(hits, minlength=len(n)) / np.maximum(n, 1))

    return share


def blocked_tokens(history: Column, n: int) -> Column:
    """Ids that would make an n-gram of the history stand twice."""
    size = F.size(history)
    tail = F.slice(history, F.greatest(size - n + 2, F.lit(1)), n - 1)
    at = F.when(size >= n, F.sequence(F.lit(1), size - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(F.filter(at, lambda i: F.slice(history, i, n - 1) == tail), lambda i: F.element_at(history, i + n - 1)))
