"""Seeded samples by the rank of a hash: the same rows in any engine and for any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.functions.formulas import hash_rank


def sample(df: DataFrame, id_col: str, n: int, seed: str) -> DataFrame:
    """``n`` rows without replacement, all if there are fewer."""
    return df.withColumn("__rank", hash_rank(seed, F.col(id_col))).orderBy("__rank", id_col).limit(n).drop("__rank")


def stratified(df: DataFrame, stratum: str, id_col: str, sizes: dict[str, int], seed: str) -> DataFrame:
    """A fixed number of rows of each stratum; strata without a number have none."""
    size: Column | None = None
    for k, n in sizes.items():
        size = F.when(F.col(stratum) == k, n) if size is None else size.when(F.col(stratum) == k, n)
    w = Window.partitionBy(stratum).orderBy(hash_rank(seed, F.col(id_col)), id_col)
    return df.filter(F.col(stratum).isin(list(sizes))).withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= size).drop("__n")


def disjoint(df: DataFrame, id_col: str, sizes: dict[str, int], seed: str) -> DataFrame:
    """``part``: consecutive stretches of one shuffled order; too few rows raise."""
    need = sum(sizes.values())
    picked = sample(df, id_col, need, seed).withColumn("__n", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(hash_rank(seed, F.col(id_col)), id_col)))
    if picked.count() < need:
        raise ValueError(f"{need} rows are needed")
    part, end = None, 0
    for name, n in sizes.items():
        end += n
        part = F.when(F.col("__n") <= end, name) if part is None else part.when(F.col("__n") <= end, name)
    return picked.withColumn("part", part).drop("__n")


def rotated(df: DataFrame, id_col: str, value: str, seed: str) -> DataFrame:
    """``moved``: the value of the next row in a shuffled order, the last row that of the first, so none keeps its own place. For samples."""
    w = Window.partitionBy(F.lit(1)).orderBy(hash_rank(seed, F.col(id_col)), id_col)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn("moved", F.coalesce(F.lead(value).over(w), F.first(value).over(whole)))
