"""Run logs: rises, resets, retention, series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by(keys: Sequence[str], order: str):
    return Window.partitionBy(*keys).orderBy(order)


def rise_runs(df: DataFrame, keys: Sequence[str], order: str, value: str, least: int = 2) -> DataFrame:
    """Maximal runs of rising values with ``least`` rises: keys, first, last, rises."""
    w = _by(keys, order)
    prev = F.lag(value).over(w)
    marked = df.withColumn("__new", F.when(F.col(value) > prev, 0).otherwise(1)).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "__run").agg(F.min(order).alias("first"), F.max(order).alias("last"), (F.count("*") - 1).alias("rises")).filter(F.col("rises") >= least).drop("__run")


def rise_counter(df: DataFrame, keys: Sequence[str], order: str, value: str, flag_at: int = 2) -> DataFrame:
    """rises: values in a row above the least one before them; flag from ``flag_at`` on. NaN counts as a rise."""
    w = _by(keys, order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    least = F.min(F.when(~F.isnan(value), F.col(value))).over(before)
    rise = F.coalesce(F.isnan(value) | (F.col(value) > least), F.lit(False))
    marked = df.withColumn("__rise", rise.cast("long")).withColumn("__run", F.sum(1 - F.col("__rise")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rises = F.sum("__rise").over(Window.partitionBy(*keys, "__run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("rises", rises).withColumn("flag", F.col("rises") >= flag_at).drop("__rise", "__run")


def last_per_step(df: DataFrame, keys: Sequence[str], step: str, order: str) -> DataFrame:
    """A step that is logged again replaces what was logged before."""
    w = Window.partitionBy(*keys, step).orderBy(F.desc(order))
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def resets(df: DataFrame, keys: Sequence[str], order: str, step: str) -> DataFrame:
    """keys, resets (a step below the one before), repeated (steps that stand more than once)."""
    back = (F.col(step) < F.lag(step).over(_by(keys, order))).cast("long")
    moved = df.withColumn("__back", back).groupBy(*keys).agg(F.coalesce(F.sum("__back"), F.lit(0)).alias("resets"))
    twice = df.groupBy(*keys, step).agg(F.count("*").alias("n")).groupBy(*keys).agg(F.count_if(F.col("n") > 1).alias("repeated"))
    return moved.join(twice, list(keys))


def rising_only(df: DataFrame, keys: Sequence[str], order: str, step: str) -> DataFrame:
    """Rows whose step is not below any before. A dropped row is below that highest step, so it cannot have set it."""
    w = _by(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("__top", F.max(step).over(w)).filter(F.col("__top").isNull() | (F.col(step) >= F.col("__top"))).drop("__top")


def retained(df: DataFrame, keys: Sequence[str], step: str, newest: int, milestones: Sequence[int], decay_from: int | None) -> DataFrame:
    """Checkpoints that stay: the newest, milestones, and those of the decay phase."""
    w = Window.partitionBy(*keys).orderBy(F.desc(step))
    keep = (F.row_number().over(w) <= newest) | F.col(step).isin(list(milestones))
    if decay_from is not None:
        keep = keep | (F.col(step) >= decay_from)
    return df.withColumn("__keep", keep).filter("__keep").drop("__keep")


def loss_curve(df: DataFrame, keys: Sequence[str], step: str, value: str, shares: Sequence[float], tail: int) -> DataFrame:
    """First, last, least value and its step, mean of the last ``tail`` steps, and the value nearest to shares of the last step."""
    end = F.max(step).over(Window.partitionBy(*keys))
    marked = df.withColumn("__end", end)
    near = lambda p: F.min_by(value, F.struct(F.abs(F.col(step) - p * F.col("__end")), F.col(step))).alias(f"at_{int(p * 100)}")
    return marked.groupBy(*keys).agg(
        F.min_by(value, step).alias("first"), F.max_by(value, step).alias("last"), F.min(value).alias("least"), F.min_by(step, F.struct(value, step)).alias("least_at"), F.avg(F.when(F.col(step) > F.col("__end") - tail, F.col(value))).alias("tail_mean"), *(near(p) for p in shares)
    )


def changes(df: DataFrame, keys: Sequence[str], order: str, value: str) -> Column:
    """Whether a value differs from the row before."""
    return F.coalesce(F.col(value) != F.lag(value).over(_by(keys, order)), F.lit(False))
