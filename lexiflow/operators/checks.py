"""Set operations and comparisons that must hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_empty(df: DataFrame, what: str, most: int = 20) -> None:
    """Raise with the first rows of a frame that must have none."""
    rows = df.limit(most).collect()
    if rows:
        raise ValueError(f"{what}: {rows}")


def strict_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One to one on ``key``: equal sets of keys or an error."""
    left_keys, right_keys = left.select(key), right.select(key)
    require_empty(left_keys.exceptAll(right_keys).unionByName(right_keys.exceptAll(left_keys)), f"keys of {key} that stand on one side only")
    return left.join(right, key)


def labelled(inputs: DataFrame, labels: DataFrame, key: str, own: Column) -> DataFrame:
    """Inputs, when all keys are the set's ``own`` and have a label; else an error."""
    require_empty(inputs.filter(~F.coalesce(own, F.lit(False))).select(key), f"{key} of another set")
    require_empty(inputs.select(key).join(labels.select(key), key, "left_anti"), f"{key} without a label")
    return inputs


def mismatches(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose values differ or that one side lacks."""
    both = a.select(key, F.col(value).alias("left")).join(b.select(key, F.col(value).alias("right")), key, "full_outer")
    return both.filter(~F.col("left").eqNullSafe(F.col("right")))


def distinct_with_mapping(df: DataFrame, keys: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """Distinct rows with their ``first`` place, and the place of each row's distinct one."""
    one = df.groupBy(*keys).agg(F.min(order).alias("first"))
    same = None
    right = one.select(*(F.col(k).alias(f"__{k}") for k in keys), "first")
    for k in keys:
        test = F.col(k).eqNullSafe(F.col(f"__{k}"))
        same = test if same is None else same & test
    return one, df.join(right, same).select(order, "first")


def inconsistent(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that have several values."""
    return df.groupBy(key).agg(F.countDistinct(value).alias("n")).filter("n > 1")


def file_digests(df_files: DataFrame) -> DataFrame:
    """path, bytes, sha256 of rows read with the ``binaryFile`` format."""
    return df_files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
