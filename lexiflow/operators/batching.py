"""Length-sorted batches under a token budget."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiflow.functions.formulas import hash_rank

CHUNK = 512


def plan_batches(df: DataFrame, id_col: str, length: str, max_tokens: int, seed: str, chunks: int) -> DataFrame:
    """id, chunk, batch: rows fall to a chunk by a hash, are sorted by length within, and fill batches while count times the longest stays in the budget."""

    def fill(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values([length, id_col], kind="stable").reset_index(drop=True)
        batch, count, out = 0, 0, []
        for n in f[length]:
            if count and (count + 1) * n > max_tokens:
                batch, count = batch + 1, 0
            out.append(batch)
            count += 1
        f["batch"] = out
        return f[[id_col, "chunk", length, "batch"]]

    placed = df.select(id_col, F.col(length).cast("long").alias(length), F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(chunks)).alias("chunk"))
    return placed.groupBy("chunk").applyInPandas(fill, f"{id_col} long, chunk long, {length} long, batch long")


def padded(batches: DataFrame, length: str) -> DataFrame:
    """rows, real and padded tokens of each batch."""
    return batches.groupBy("chunk", "batch").agg(F.count("*").alias("rows"), F.sum(length).alias("real"), (F.count("*") * F.max(length)).alias("padded"))


def stepped(batches: DataFrame, tokens_per_step: int, seed: str) -> DataFrame:
    """Batches in a seeded order, with ``place``, ``step`` (from 0) and ``held``: a step takes batches until its padded tokens reach ``tokens_per_step``, then counting begins anew.

    The counter is no prefix sum, so one task walks all batches; they come to it as at most 256 rows of arrays, ordered by the hash that shuffles them.
    """
    rank = hash_rank(seed, F.col("chunk"), F.col("batch"))
    names = ["chunk", "batch", "rows", "real", "padded"]
    parts = batches.withColumn("__r", rank).groupBy(F.substring("__r", 1, 2).alias("__part")).agg(F.array_sort(F.collect_list(F.struct("__r", *names))).alias("__b"))

    def walk(f: pd.DataFrame) -> pd.DataFrame:
        out, step, held = [], 0, 0
        for part in f.sort_values("__part")["__b"]:
            for b in part:
                held += b["padded"]
                out.append((*(b[k] for k in names), len(out), step, held))
                if held >= tokens_per_step:
                    step, held = step + 1, 0
        return pd.DataFrame(out, columns=[*names, "place", "step", "held"], dtype="int64")

    return parts.groupBy().applyInPandas(walk, ", ".join(f"{k} long" for k in [*names, "place", "step", "held"]))


def replayed(steps: DataFrame, tokens_per_step: int, max_tokens: int) -> DataFrame:
    """Totals of an epoch from ``stepped``: one row."""
    full = F.col("held") >= tokens_per_step
    total = steps.agg(
        F.count("*").alias("batches"), F.sum("rows").alias("examples"), F.sum("real").alias("real"), F.sum("padded").alias("padded"), F.count_if(full).alias("steps"),
        (F.sum("padded") - F.coalesce(F.sum(F.when(full, F.col("held"))), F.lit(0))).alias("left"),
        F.percentile("padded", F.lit(0.5)).alias("median"), F.percentile("padded", F.lit(0.99)).alias("p99"), F.max("padded").alias("max"), F.count_if(F.col("padded") > max_tokens).alias("over_budget"),
    )
    return total.withColumn("padding_share", 1 - F.col("real") / F.nullif(F.col("padded"), F.lit(0)))


def pad(tokens: Column, size: Column, end: int, fill: int) -> Column:
    """Tokens, an end mark, and filling up to ``size``."""
    return F.concat(tokens, F.array(F.lit(end)), F.array_repeat(F.lit(fill), F.greatest(size - F.size(tokens) - 1, F.lit(0)).cast("int")))


def chunk_bounds(order: Column, size: int) -> Column:
    return F.floor(order / F.lit(size)).cast("long")


def joined_rows(df: DataFrame, partners: DataFrame, id_col: str, tokens: str, cap: int) -> DataFrame:
    """Each id's partners (id, place, partner) as one array, in order of place, cut off at ``cap``."""
    each = partners.join(df.select(F.col(id_col).alias("partner"), tokens), "partner")
    ordered = F.array_sort(F.collect_list(F.struct("place", tokens)))
    return each.groupBy(id_col).agg(F.slice(F.flatten(F.transform(ordered, lambda s: s[tokens])), 1, cap).alias(tokens))
