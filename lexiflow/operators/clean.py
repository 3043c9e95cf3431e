"""The cleaning cascade: one pass tags each pair with the first step it fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiflow.functions.text import length_ratio_ok, non_letter_fraction
from lexiflow.operators import guard, sampling

STEPS = ["empty", "duplicate", "equal", "ratio", "non_letter", "guard", "holdout", "holdout_match"]


def first_of(df: DataFrame, keys: list[str], order: str) -> Column:
    """True on the first row of each key in ``order``."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(order)) == 1


def tag_steps(pairs: DataFrame, src: str = "src", tgt: str = "tgt", order: str = "ord") -> DataFrame:
    """``step``: the first cleaning step that drops the row, or null. A duplicate is a repeat of both sides; its first row stays."""
    a, b = F.col(src), F.col(tgt)
    keyed = pairs.withColumn("__key", F.sha2(F.concat_ws("\0", F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))), 256))
    step = (
        F.when(F.coalesce(a, F.lit("")).eqNullSafe("") | F.coalesce(b, F.lit("")).eqNullSafe(""), "empty")
        .when(~first_of(keyed, ["__key"], order), "duplicate")
        .when(a == b, "equal")
        .when(~length_ratio_ok(a, b), "ratio")
        .when((non_letter_fraction(a) > 0.5) | (non_letter_fraction(b) > 0.5), "non_letter")
    )
    return keyed.withColumn("step", step).drop("__key")


def cascade(pairs: DataFrame, protected: DataFrame, held: int, seed: str, src: str = "src", tgt: str = "tgt", order: str = "ord") -> DataFrame:
    """``step`` of every pair over all steps: those of :func:`tag_steps`, then the guard against ``protected`` (a match index), then the hold-out.

    The hold-out is a sample of ``held`` of the pairs left by then. Its own rows go by identity, and
    count as holdout; pairs that match one of them on any side, by exact text or key, go as
    holdout_match. Held rows are as few as asked for, so their ids and index are broadcast.
    """
    tagged = tag_steps(pairs, src, tgt, order)
    alive = tagged.filter("step IS NULL").select(order, src, tgt)
    hit = guard.matches(alive, protected, [src, tgt], order).select(order).distinct()
    clear = alive.join(hit, order, "left_anti")
    sample = sampling.sample(clear, order, held, seed)
    index = guard.match_index(sample.select(F.lit("held").alias("set"), F.explode(F.array(src, tgt)).alias("text")))
    alike = guard.matches(clear, index, [src, tgt], order, index_rows=4 * held).select(order).distinct()
    marks = hit.select(order, F.lit("guard").alias("late")).unionByName(sample.select(order, F.lit("holdout").alias("late")))
    marks = marks.unionByName(alike.join(F.broadcast(sample.select(order)), order, "left_anti").select(order, F.lit("holdout_match").alias("late")))
    return tagged.join(marks, order, "left").withColumn("step", F.coalesce("step", "late")).drop("late")


def reread_matches(spark: SparkSession, path: str, protected: DataFrame, sides: list[str], order: str = "ord") -> DataFrame:
    """set, n: rows of a written table that still match each protected set; all zero after a guard."""
    found = guard.matches(spark.read.parquet(path), protected, sides, order).groupBy("set").agg(F.count("*").alias("n"))
    return protected.select("set").distinct().join(found, "set", "left").select("set", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def filter_table(tagged: DataFrame, steps: list[str] = STEPS) -> DataFrame:
    """step, removed, remaining for every step in order, from one count."""
    counts = tagged.groupBy("step").agg(F.count("*").alias("n"))
    total = tagged.agg(F.count("*").alias("total"))
    every = tagged.sparkSession.createDataFrame(list(enumerate(steps)), "place int, step string")
    got = F.broadcast(every).join(counts, "step", "left").crossJoin(F.broadcast(total))  # one row
    removed = F.coalesce("n", F.lit(0))
    gone = F.sum(removed).over(Window.partitionBy(F.lit(1)).orderBy("place"))
    return got.select("step", removed.alias("removed"), (F.col("total") - gone).alias("remaining"))
