"""Aggregations: histograms, ratios of sums, percentiles, quantile buckets, islands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: Sequence[str], order: str, start: str) -> DataFrame:
    """Runs that begin where ``start`` holds: keys, island (from 1), first, last of ``order``."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("island", F.sum(F.col(start).cast("long")).over(w)).groupBy(*keys, "island").agg(F.min(order).alias("first"), F.max(order).alias("last"))


def histogram(df: DataFrame, label: Column, labels: Sequence[str]) -> DataFrame:
    """label, n for every label, zeros included."""
    counted = df.groupBy(label.alias("label")).agg(F.count("*").alias("n"))
    every = df.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    return F.broadcast(every).join(counted, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def dense_counts(df: DataFrame, tokens: str, vocab: int) -> DataFrame:
    """token_id, n for every id below ``vocab``."""
    counted = df.select(F.explode(tokens).alias("token_id")).groupBy("token_id").agg(F.count("*").alias("n"))
    return df.sparkSession.range(vocab).select(F.col("id").cast("int").alias("token_id")).join(counted, "token_id", "left").fillna(0, ["n"])


def describe(values: Column, prefix: str = "") -> list[Column]:
    """n, mean, min, p50, p90, p95, p99, max; percentiles interpolate."""
    pick = lambda q: F.percentile(values, F.lit(q))
    made = {"n": F.count(values), "mean": F.avg(values), "min": F.min(values), "p50": pick(0.5), "p90": pick(0.9), "p95": pick(0.95), "p99": pick(0.99), "max": F.max(values)}
    return [c.alias(prefix + k) for k, c in made.items()]


def unpivoted(df: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.unpivot(list(ids), list(columns), "key", "value")


def across_runs(df: DataFrame, keys: Sequence[str], value: str = "value", unstable: float = 0.10) -> DataFrame:
    """median, min, max, n of each key, its spread relative to the median, and whether that exceeds ``unstable``; the spread is NaN for a median of 0."""
    got = df.groupBy(*keys).agg(F.median(value).alias("median"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("n"))
    spread = F.when(F.col("median") == 0, F.lit(float("nan"))).otherwise((F.col("max") - F.col("min")) / F.nullif(F.col("median"), F.lit(0.0)))
    return got.withColumn("spread", spread).withColumn("unstable", ~F.isnan("spread") & (F.col("spread") > unstable))


def most_common(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The ``n`` most frequent values; of equal counts, the one met first."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.min(order).alias("first")).orderBy(F.desc("n"), "first").limit(n).drop("first")


def quantile_edges(df: DataFrame, value: str, buckets: int) -> list[float]:
    """Interior edges, interpolated; none for an empty table."""
    return df.agg(F.percentile(value, F.array(*(F.lit(k / buckets) for k in range(1, buckets))))).first()[0] or []


def quantile_means(df: DataFrame, value: str, measure: str, edges: Sequence[float], buckets: int) -> DataFrame:
    """bucket (1: the largest values), n, mean of ``measure``; a value on an edge belongs to the lower side; empty buckets are there."""
    above = sum(((F.col(value) > e).cast("int") for e in edges), F.lit(0))
    counted = df.groupBy((F.lit(buckets) - above).cast("long").alias("bucket")).agg(F.count("*").alias("n"), F.avg(measure).alias("mean"))
    return df.sparkSession.range(1, buckets + 1).select(F.col("id").alias("bucket")).join(counted, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"), "mean")


def rate(flag: Column) -> Column:
    """Share of rows with the flag; null for none."""
    return F.avg(flag.cast("double"))


def merged_counts(df: DataFrame, maps: str) -> DataFrame:
    """Key-wise sum of maps."""
    return df.select(F.explode(maps).alias("key", "n")).groupBy("key").agg(F.sum("n").alias("n"))


def vector_mean(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """Element-wise mean of arrays: keys, pos, mean."""
    return df.select(*keys, F.posexplode(vector).alias("pos", "x")).groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def mix_and_rate(classes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Of class, sa, na, sb, nb (sums and counts of two sides; 0 for a class that a side lacks) within ``keys``: each class's part of the gap in means (a less b) by its share, ``mix``, and by its mean, ``rate``; they sum to the gap."""
    whole = Window.partitionBy(*(keys or [F.lit(1)]))  # a row per class
    share = lambda k: F.col(f"n{k}") / F.nullif(F.sum(f"n{k}").over(whole), F.lit(0))
    mean = lambda k, other: F.coalesce(F.col(f"s{k}") / F.nullif(F.col(f"n{k}"), F.lit(0)), F.col(f"s{other}") / F.nullif(F.col(f"n{other}"), F.lit(0)), F.lit(0.0))
    t = classes.select(*keys, "class", share("a").alias("wa"), share("b").alias("wb"), mean("a", "b").alias("ma"), mean("b", "a").alias("mb"))
    return t.selectExpr(*keys, "class", "(wa - wb) * (ma + mb) / 2 AS mix", "(ma - mb) * (wa + wb) / 2 AS rate")
