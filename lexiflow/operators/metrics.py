"""Corpus metrics from per-row sufficient statistics."""

from __future__ import annotations

import itertools
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

ORDERS = 4
STATS = ["hyp_len", "ref_len", *(f"m{n}" for n in range(1, ORDERS + 1)), *(f"t{n}" for n in range(1, ORDERS + 1))]
#: The word tokens of BLEU here: words, and single marks. Its values compare with no other tokenizer's.
TOKEN = regex.compile(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]")


#: The same tokens by the faster module, for texts of characters on which both agree.
_NEAR, _NEAR_TOKEN = re.compile(r"[\x00-\u052f\u2010-\u2027]*"), re.compile(r"\w+|[^\w\s]|[\x1c-\x1f]")
#: Tokens or characters that are counted side by side; a longer pair of texts is counted alone.
_SIDE_BY_SIDE = 1 << 16


def tokens(text: str) -> list[str]:
    return (_NEAR_TOKEN if text.isascii() or _NEAR.fullmatch(text) else TOKEN).findall(text)


def clipped_matches(ids: np.ndarray, sizes: np.ndarray, orders: int) -> np.ndarray:
    """Of every pair of texts, how many n-grams of the first the second has, each counted as often as both have it; a column for each n.

    ``ids`` are the texts' numbers, first and second of each pair in turn; ``sizes`` has a row for each pair. N-grams
    are packed into one integer with their pair and their side, and sorted; where they would not fit, shorter ones are numbered first.
    """
    pairs, lengths = len(sizes), sizes.ravel()
    out = np.zeros((pairs, orders), np.int64)
    if not len(ids):
        return out
    width, pair_bits = max(1, int(ids.max()).bit_length()), (pairs - 1).bit_length()
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(ids))
    side = np.repeat(np.tile(np.array([0, 1]), pairs), lengths)
    pair = np.repeat(np.arange(pairs), sizes.sum(axis=1))
    gram, low = ids, width
    for n in range(1, orders + 1):
        if n > 1:
            if low + width + pair_bits > 62:
                names, gram = np.unique(gram, return_inverse=True)
                low = max(1, (len(names) - 1).bit_length())
            gram, low = gram[:-1] << width | ids[n - 1 :], low + width
        whole = np.flatnonzero(left[: len(gram)] >= n)
        key = np.sort((pair[whole] << low | gram[whole]) << 1 | side[whole])
        if not len(key):
            break
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        counts, key = np.diff(np.append(starts, len(key))), key[starts]
        both = np.flatnonzero((key[1:] == key[:-1] + 1) & (key[:-1] & 1 == 0))
        out[:, n - 1] = np.bincount(key[both] >> low + 1, np.minimum(counts[both], counts[both + 1]), pairs)
    return out


def _groups(sizes: np.ndarray) -> Iterator[slice]:
    """Runs of pairs of about ``_SIDE_BY_SIDE`` items, one pair at least."""
    ends, start = np.cumsum(sizes.sum(axis=1)), 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + _SIDE_BY_SIDE, "right")))
        yield slice(start, stop)
        start = stop


def all_stats(hyps: Sequence[str | None], refs: Sequence[str | None]) -> np.ndarray:
    """``STATS`` of each pair: lengths, clipped matches and totals of 1- to 4-grams."""
    chars = np.array([(len(h or ""), len(r or "")) for h, r in zip(hyps, refs, strict=True)], np.int64).reshape(-1, 2)
    sizes, match = np.zeros_like(chars), np.zeros((len(chars), ORDERS), np.int64)
    for part in _groups(chars // 4):
        number = defaultdict(itertools.count().__next__).__getitem__
        ids = [np.fromiter(map(number, tokens(t or "")), np.int64) for both in zip(hyps[part], refs[part], strict=True) for t in both]
        sizes[part] = np.array([len(x) for x in ids]).reshape(-1, 2)
        match[part] = clipped_matches(np.concatenate(ids), sizes[part], ORDERS)
    total = np.maximum(sizes[:, :1] - np.arange(ORDERS), 0)
    return np.column_stack([sizes, match, total])


def sentence_stats(hyp: str, ref: str) -> tuple[int, ...]:
    return tuple(all_stats([hyp], [ref])[0].tolist())


@F.arrow_udf(StructType([StructField(s, LongType()) for s in STATS]))
def pair_stats(hyp: pa.Array, ref: pa.Array) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(c) for c in all_stats(hyp.to_pylist(), ref.to_pylist()).T], STATS)


def bleu_stats(df: DataFrame, hyp: str = "hyp", ref: str = "ref", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns and the statistics of each row, by an Arrow function, as n-gram counts of long texts would explode; who reads ``keep`` alone does not call it."""
    keep = keep or []
    return df.select(*keep, pair_stats(hyp, ref).alias("__stats")).select(*keep, *(F.col(f"__stats.{s}").alias(s) for s in STATS))


def summed() -> list[Column]:
    return [F.sum(s).alias(s) for s in STATS]


def bleu(prefix: str = "") -> Column:
    """BLEU in percent from summed statistics: a floor of 1e-9 for unmatched words, one added to longer n-grams, and a penalty for length."""
    c = lambda s: F.col(prefix + s).cast("double")
    logs = None
    ok = F.lit(True)
    for n in range(1, ORDERS + 1):
        m, t = c(f"m{n}"), c(f"t{n}")
        p = F.when(t == 0, 0.0).when(F.lit(n == 1), F.when(m == 0, 1e-9).otherwise(m) / F.nullif(t, F.lit(0.0))).otherwise((m + 1) / (t + 1))
        ok = ok & (p > 0)
        term = F.ln(F.when(p > 0, p).otherwise(1.0))
        logs = term if logs is None else logs + term
    brevity = F.when(c("hyp_len") > c("ref_len"), 1.0).when(c("hyp_len") == 0, 0.0).otherwise(F.exp(1 - c("ref_len") / F.nullif(c("hyp_len"), F.lit(0.0))))
    return F.when(ok, 100 * brevity * F.exp(logs / ORDERS)).otherwise(0.0)


def all_chrf(hyps: Sequence[str | None], refs: Sequence[str | None], orders: int = 6, beta: float = 2.0) -> np.ndarray:
    """Of each pair, the mean F-score of character n-grams, in lower case and without white space, over the orders that both sides have."""
    texts = [("".join((h or "").lower().split()), "".join((r or "").lower().split())) for h, r in zip(hyps, refs, strict=True)]
    sizes = np.array([(len(h), len(r)) for h, r in texts], np.int64).reshape(-1, 2)
    match = np.zeros((len(texts), orders), np.int64)
    for part in _groups(sizes):
        codes = np.frombuffer("".join(h + r for h, r in texts[part]).encode("utf-32-le"), np.uint32)
        if len(codes):
            number = np.cumsum(np.bincount(codes) > 0) - 1
            match[part] = clipped_matches(number[codes], sizes[part], orders)
    score, used = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    for n in range(1, orders + 1):
        total = sizes - n + 1
        have = (total > 0).all(axis=1)
        some = have & (match[:, n - 1] > 0)
        p, q = (match[some, n - 1] / total[some, k] for k in (0, 1))
        score[some] += (1 + beta * beta) * p * q / (beta * beta * p + q)
        used += have
    return np.where((sizes == 0).all(axis=1), 100.0, 100 * score / np.maximum(used, 1))


def sentence_chrf(hyp: str, ref: str, orders: int = 6, beta: float = 2.0) -> float:
    return float(all_chrf([hyp], [ref], orders, beta)[0])


@F.arrow_udf(DoubleType())
def chrf(hyp: pa.Array, ref: pa.Array) -> pa.Array:
    return pa.array(all_chrf(hyp.to_pylist(), ref.to_pylist()))


def overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    return F.aggregate(F.array_distinct(F.array_intersect(a, b)), F.lit(0), lambda acc, x: acc + F.least(count(a, x), count(b, x)))


def mbr_utilities(pools: DataFrame, pool: str = "pool", order: str = "ord", text: str = "text") -> DataFrame:
    """pool, ord, utility: mean chrF of each member to every other; 0 for a pool of one. Equal texts are scored once."""
    a, b = pools.select(pool, F.col(order).alias("i"), F.col(text).alias("x")), pools.select(pool, F.col(order).alias("j"), F.col(text).alias("y"))
    both = a.join(b, pool).filter("i <> j")
    once = both.select("x", "y").distinct().withColumn("score", chrf("x", "y"))
    scored = both.join(once, ["x", "y"]).groupBy(pool, F.col("i").alias(order)).agg(F.avg("score").alias("utility"))
    return pools.select(pool, order).join(scored, [pool, order], "left").fillna(0.0, ["utility"])


def argmax(df: DataFrame, keys: list[str], value: str, order: str, tolerance: float = 1e-12) -> DataFrame:
    """Of the rows within ``tolerance`` of a group's best, the earliest."""
    best = df.groupBy(*keys).agg(F.max(value).alias("__best"))
    near = df.join(best, keys).filter(F.col("__best") - F.col(value) <= tolerance)
    return near.groupBy(*keys).agg(F.min(order).alias(order))
