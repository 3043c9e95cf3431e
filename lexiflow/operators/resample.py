"""Bootstrap intervals from sufficient statistics: a resample is a sum of rows."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from lexiflow.operators import metrics, stats


#: A draw is at most this: the chance of more is below 2^-60, the grain of the hash.
MOST_DRAWN = 18


def poisson_steps() -> list[float]:
    """Chances that a Poisson number of mean one is at most 0, 1, 2, ..."""
    chance, total, out = math.exp(-1), 0.0, []
    for k in range(MOST_DRAWN):
        total += chance
        out.append(total)
        chance /= k + 1
    return out


def poisson_sql(u: str) -> str:
    """The draw of a uniform number, as SQL."""
    return "CASE " + " ".join(f"WHEN {u} < {x!r} THEN {k}" for k, x in enumerate(poisson_steps())) + f" ELSE {MOST_DRAWN} END"


def resampled_sums(df: DataFrame, id_col: str, columns: list[str], reps: int, seed: str, keys: list[str] | None = None, whole: bool = False) -> DataFrame:
    """keys, rep, n and the drawn sum of each column; strata are resampled alike by putting them among the keys. With ``whole``, rep -1 has every row once.

    A row is drawn a Poisson number of times, of mean one, by an MD5 hash of seed, id and rep: the
    same in any engine and for any partitioning. Rows are drawn where they stand, and a task adds up
    its own before anything is shuffled: ``reps`` rows for each key and task.
    """
    keys = keys or []
    names = [f"k{j}" for j in range(len(keys))]
    values = [f"v{j}" for j in range(len(columns))]
    source = df.select(F.col(id_col).cast("string").alias("id"), *(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(v) for c, v in zip(columns, values, strict=True)))
    fields = source.schema.fields[1 : 1 + len(keys)]
    schema = StructType([*fields, StructField("rep", IntegerType()), StructField("n", DoubleType()), *(StructField(v, DoubleType()) for v in values)])
    sums = source.mapInArrow(_drawn_sums(names, values, reps, seed, whole), schema).groupBy(*names, "rep").agg(F.sum("n").cast("long").alias("n"), *(F.sum(v).alias(v) for v in values))
    back = dict(zip((*names, *values), (*keys, *columns), strict=True))
    return sums.filter("n > 0").withColumnsRenamed(back)


def _drawn_sums(names: list[str], values: list[str], reps: int, seed: str, whole: bool):
    labels = np.array([*range(reps), *([-1] if whole else [])], dtype=np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = np.array(poisson_steps())
        held: dict[tuple, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for key, total in held.items():
                columns = [pa.array([k] * len(labels), t) for k, t in zip(key, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(labels), *(pa.array(c) for c in total.T)], [*names, "rep", "n", *values])
            held.clear()

        for batch in batches:
            kinds = [batch.schema.field(n).type for n in names]
            keyed = list(zip(*(batch.column(n).to_pylist() for n in names), strict=True)) if names else [()] * batch.num_rows
            x = np.column_stack([np.ones(batch.num_rows), *(batch.column(v).to_numpy(zero_copy_only=False) for v in values)])
            places: dict[str | None, list[int]] = {}
            for j, i in enumerate(batch.column("id").to_pylist()):
                places.setdefault(i, []).append(j)
            ids = list(places)
            # An id is drawn once, for all of its rows.
            for a in range(0, len(ids), 64):
                part = ids[a : a + 64]
                # The first 15 hex digits of each digest, as a number.
                number = _first_halves(seed, part, reps) >> np.uint64(4)
                times = np.searchsorted(steps, number.astype(np.float64) * 2.0**-60, "right").astype(np.float64)
                if whole:
                    times = np.column_stack([times, np.ones(len(part))])
                mine: dict[tuple, list[tuple[int, int]]] = {}
                for t, i in enumerate(part):
                    for j in places[i]:
                        mine.setdefault(keyed[j], []).append((t, j))
                for key, pairs in mine.items():
                    of, rows = (list(v) for v in zip(*pairs, strict=True))
                    held[key] = held.get(key, 0) + times[of].T @ x[rows]
                if len(held) > 500:
                    yield from flush()
        yield from flush()

    return run


def _md5_constants() -> tuple[list[int], list[int], list[int]]:
    """Of each of the 64 rounds: its summand, its turn, and the word it reads."""
    summands = [int(abs(math.sin(k + 1)) * 2**32) for k in range(64)]
    turns = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
    reads = [*range(16), *((5 * k + 1) % 16 for k in range(16)), *((3 * k + 5) % 16 for k in range(16)), *(7 * k % 16 for k in range(16))]
    return summands, turns, reads


_MD5 = _md5_constants()
#: Digests that are computed side by side; their few arrays stay in the processor's cache.
_MD5_WIDTH = 16384


def _first_halves(seed: str, ids: list[str | None], reps: int) -> np.ndarray:
    """ids by reps: the first 8 bytes, as a number, of MD5 of ``seed:id:rep`` (a null id is left out, as by concat_ws).

    Messages of one length that fit MD5's one block are digested side by side; any other by hashlib.
    """
    out = np.empty((len(ids), reps), np.uint64)
    heads = [(seed if i is None else f"{seed}:{i}").encode() for i in ids]
    for size in sorted({len(h) for h in heads}):
        rows = [k for k, h in enumerate(heads) if len(h) == size]
        first = np.frombuffer(b"".join(heads[k] for k in rows), np.uint8).reshape(len(rows), 1, size)
        start = 0
        while start < reps:
            digits = len(str(start))
            stop = min(reps, 10**digits)
            total = size + 1 + digits
            if total > 55:
                for k in rows:
                    for r in range(start, stop):
                        out[k, r] = int.from_bytes(hashlib.md5(heads[k] + b":%d" % r).digest()[:8], "big")
            else:
                tails = np.frombuffer(b"".join(b":%d" % r for r in range(start, stop)), np.uint8).reshape(1, stop - start, digits + 1)
                filled = total // 4 + 1
                block = np.zeros((len(rows), stop - start, 4 * filled), np.uint8)
                block[:, :, :size], block[:, :, size:total], block[:, :, total] = first, tails, 128
                words = np.ascontiguousarray(block.reshape(-1, 4 * filled).view("<u4").T)
                got = np.empty(words.shape[1], np.uint64)
                for a in range(0, len(got), _MD5_WIDTH):
                    got[a : a + _MD5_WIDTH] = _md5_block(words[:, a : a + _MD5_WIDTH], 8 * total)
                out[rows, start:stop] = got.reshape(len(rows), -1)
            start = stop
    return out


def _md5_block(words: np.ndarray, bits: int) -> np.ndarray:
    """MD5 of messages of ``bits`` bits, a column of words each, which the closing bit ends. The first 8 bytes of each digest."""
    filled, n = words.shape
    initial = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
    a, b, c, d = (np.full(n, v, np.uint32) for v in initial)
    f, g = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for k, (summand, turn, read) in enumerate(zip(*_MD5, strict=True)):
        if k < 16:  # d ^ (b & (c ^ d))
            np.bitwise_xor(c, d, f), np.bitwise_and(f, b, f), np.bitwise_xor(f, d, f)
        elif k < 32:  # c ^ (d & (b ^ c))
            np.bitwise_xor(b, c, f), np.bitwise_and(f, d, f), np.bitwise_xor(f, c, f)
        elif k < 48:
            np.bitwise_xor(b, c, f), np.bitwise_xor(f, d, f)
        else:
            np.invert(d, f), np.bitwise_or(f, b, f), np.bitwise_xor(f, c, f)
        np.add(f, a, f), np.add(f, np.uint32((summand + (bits if read == 14 else 0)) % 2**32), f)
        if read < filled:
            np.add(f, words[read], f)
        np.left_shift(f, np.uint32(turn), g), np.right_shift(f, np.uint32(32 - turn), f), np.bitwise_or(f, g, f)
        np.add(f, b, f)
        a, b, c, d, f = d, f, b, c, a
    low, high = (x + np.uint32(v) for x, v in zip((a, b), initial, strict=False))
    return low.byteswap().astype(np.uint64) << np.uint64(32) | high.byteswap()


def interval(samples: DataFrame, value: str, reps: int, keys: list[str] | None = None) -> DataFrame:
    """Order statistics at 2.5 and 97.5 percent, without interpolation."""
    w = Window.partitionBy(*(keys or [F.lit(1)])).orderBy(value, "rep")
    low, high = int(0.025 * reps) + 1, min(reps, int(0.975 * reps) + 1)
    ranked = samples.withColumn("__n", F.row_number().over(w))
    return ranked.groupBy(*(keys or [])).agg(F.max(F.when(F.col("__n") == low, F.col(value))).alias("low"), F.max(F.when(F.col("__n") == high, F.col(value))).alias("high"))


def interpolated(samples: DataFrame, values: list[str], keys: list[str] | None = None) -> DataFrame:
    """keys, and low and high of each value: percentiles 2.5 and 97.5, interpolated."""
    picks = [F.percentile(v, F.lit(q)).alias(f"{v}_{side}") for v in values for side, q in (("low", 0.025), ("high", 0.975))]
    return samples.groupBy(*(keys or [])).agg(*picks)


def mix_and_rate_intervals(df: DataFrame, id_col: str, cls: str, side: str, value: str, reps: int, seed: str) -> DataFrame:
    """class, then low and high of mix, rate and gap (the whole table's, side 0 less side 1), of means split anew on every draw; either side is drawn within itself.

    A class that a draw lacks counts there with terms of 0, so every interval is of all ``reps`` draws.
    """
    sums = resampled_sums(df.select(id_col, F.col(cls).alias("class"), F.col(side).alias("__side"), F.col(value).alias("s")), id_col, ["s"], reps, seed, ["class", "__side"])
    wide = sums.groupBy("class", "rep").agg(*(F.sum(F.when(F.col("__side") == k, F.col(c))).alias(f"{c}{x}") for k, x in ((0, "a"), (1, "b")) for c in ("s", "n")))
    every = df.select(F.col(cls).alias("class")).distinct().crossJoin(df.sparkSession.range(reps).select(F.col("id").cast("int").alias("rep")))  # classes by draws
    terms = stats.mix_and_rate(every.join(wide, ["class", "rep"], "left").fillna(0, ["sa", "na", "sb", "nb"]), ["rep"])
    terms = terms.withColumn("gap", F.sum(F.col("mix") + F.col("rate")).over(Window.partitionBy("rep")))
    return interpolated(terms, ["mix", "rate", "gap"], ["class"])


def clipped(low: Column, high: Column, point: Column) -> tuple[Column, Column]:
    """An interval widened to hold its point."""
    return F.least(low, point), F.greatest(high, point)


def paired(samples: DataFrame, a: str, b: str, reps: int, keys: list[str] | None = None) -> DataFrame:
    """Interval of the difference of two systems on the same draws, and the share of draws in which it is not above zero."""
    delta = samples.withColumn("delta", F.col(a) - F.col(b))
    p = delta.groupBy(*(keys or [])).agg(F.avg((F.col("delta") <= 0).cast("double")).alias("p"))
    ci = interval(delta, "delta", reps, keys)
    return ci.join(p, keys) if keys else ci.crossJoin(p)  # one row each


def slice_intervals(df: DataFrame, id_col: str, keys: list[str], value: str, reps: int, seed: str) -> DataFrame:
    """keys, n, then point, low and high of BLEU (from its statistics) and of the mean of ``value``."""
    known = df.withColumn("__known", F.col(value).isNotNull().cast("long"))
    sums = resampled_sums(known, id_col, [*metrics.STATS, value, "__known"], reps, seed, keys, whole=True)
    made = sums.select(*keys, "rep", "n", metrics.bleu().alias("bleu"), (F.col(value) / F.col("n")).alias("mean"), (F.col(value) / F.nullif(F.col("__known"), F.lit(0.0))).alias("point"))
    # All of a slice's draws are sorted in one row, so that they are made once.
    drawn = F.col("rep") >= 0
    of = lambda c: F.max(F.when(~drawn, F.col(c)))
    each = made.groupBy(*keys).agg(of("n").alias("n"), of("bleu").alias("bleu"), of("point").alias("mean"), *(F.sort_array(F.collect_list(F.when(drawn, F.col(c)))).alias(f"{c}s") for c in ("bleu", "mean")))
    m = F.size("means")  # a slice of few rows has draws without any; its interval is of the others
    at = {"low": (F.floor(0.025 * m) + 1).cast("int"), "high": F.least(m, F.floor(0.975 * m) + 1).cast("int")}
    out = each.filter(m > 0).select(*keys, "n", "bleu", "mean", *(F.element_at(f"{c}s", i).alias(f"{c}_{side}") for c in ("bleu", "mean") for side, i in at.items()))
    low, high = clipped(F.col("bleu_low"), F.col("bleu_high"), F.col("bleu"))
    return out.select(*keys, "n", "bleu", low.alias("bleu_low"), high.alias("bleu_high"), "mean", "mean_low", "mean_high")


def complete_runs(rows: DataFrame, ids: DataFrame, id_col: str, run: str) -> list[str]:
    """Runs that have a row for every id, in order of name."""
    n = ids.select(id_col).distinct().count()
    got = rows.join(ids.select(id_col).distinct(), id_col, "left_semi").groupBy(run).agg(F.countDistinct(id_col).alias("n"))
    return sorted(r[run] for r in got.filter(F.col("n") == n).collect())


def decisions(rows: DataFrame, ids: DataFrame, id_col: str, run: str, split: str, reps: int, seed: str, better: list[str], no_worse: list[str]) -> DataFrame:
    """Every pair of complete runs, tested both ways on the same draws: better, other, split, delta of BLEU, low, high, p, met, supported.

    In a split of ``better`` delta must be above 0 and p below 0.05; in one of ``no_worse`` the interval must begin above -0.5.
    A pair is supported when every one of these splits is there and meets its rule.
    """
    runs = complete_runs(rows, ids, id_col, run)
    full = rows.filter(F.col(run).isin(runs) & F.col(split).isin([*better, *no_worse]))
    sums = resampled_sums(full, id_col, metrics.STATS, reps, seed, [run, split], whole=True).select(run, split, "rep", metrics.bleu().alias("v"))
    # A row for each run, split and draw; the joins below read it eight times, and each time would draw anew.
    sums = rows.sparkSession.createDataFrame(sums.collect(), sums.schema)
    point, sums = sums.filter("rep < 0").drop("rep"), sums.filter("rep >= 0")
    side = lambda df, name, v: df.withColumnsRenamed({run: name, "v": v})
    different = F.col("better") != F.col("other")
    drawn = side(sums, "better", "a").join(side(sums, "other", "b"), [split, "rep"]).filter(different)
    tested = paired(drawn, "a", "b", reps, ["better", "other", split])
    delta = side(point, "better", "a").join(side(point, "other", "b"), split).filter(different).select("better", "other", split, (F.col("a") - F.col("b")).alias("delta"))
    met = F.when(F.col(split).isin(better), (F.col("delta") > 0) & (F.col("p") < 0.05)).otherwise(F.col("low") > -0.5)
    each = delta.join(tested, ["better", "other", split]).withColumn("met", met)
    held = F.sum(F.col("met").cast("long")).over(Window.partitionBy("better", "other"))  # a row per split
    return each.withColumn("supported", held == len({*better, *no_worse}))
