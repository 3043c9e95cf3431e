"""Keeping protected texts out of a corpus, and saying what was found where."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.functions.text import near_dup_key, side_label

#: A protected index with more stored rows is joined instead of broadcast.
BROADCAST_ROWS = 200_000


def _side(index: DataFrame, rows: int | None) -> DataFrame:
    """Broadcast where the caller knows the index to be small."""
    return F.broadcast(index) if rows is not None and rows <= BROADCAST_ROWS else index


def match_index(protected: DataFrame, set_col: str = "set", text_col: str = "text") -> DataFrame:
    """set, kind (exact or key), value, target, of every protected text; an empty key is no entry."""
    both = F.array(F.struct(F.lit("exact").alias("kind"), F.col(text_col).alias("value")), F.struct(F.lit("key").alias("kind"), near_dup_key(F.col(text_col)).alias("value")))
    return protected.select(F.col(set_col).alias("set"), F.col(text_col).alias("target"), F.inline(both)).filter(F.col("value").isNotNull()).dropDuplicates(["set", "kind", "value", "target"])


def probes(rows: DataFrame, sides: Sequence[str], id_col: str = "ord") -> DataFrame:
    """A row for each side and kind of value of each row: an OR of equalities would be a nested loop."""
    each = F.array(*(F.struct(F.lit(s).alias("side"), F.lit(k).alias("kind"), v.alias("value")) for s in sides for k, v in (("exact", F.col(s)), ("key", near_dup_key(F.col(s))))))
    return rows.select(id_col, F.inline(each)).filter(F.col("value").isNotNull())


def matches(rows: DataFrame, index: DataFrame, sides: Sequence[str], id_col: str = "ord", index_rows: int | None = None) -> DataFrame:
    """id, set, match_type (exact before near_dup), side, for every row and set that match."""
    entries = _side(index.select("set", "kind", "value").distinct(), index_rows)
    hit = probes(rows, sides, id_col).join(entries, ["kind", "value"])
    has = lambda s: F.bool_or(F.col("side") == s)
    got = hit.groupBy(id_col, "set").agg(F.bool_or(F.col("kind") == "exact").alias("exact"), has(sides[0]).alias("a"), (has(sides[1]) if len(sides) > 1 else F.lit(False)).alias("b"))
    return got.select(id_col, "set", F.when(F.col("exact"), "exact").otherwise("near_dup").alias("match_type"), side_label(F.col("a"), F.col("b")).alias("side"))


def guard(rows: DataFrame, index: DataFrame, sides: Sequence[str], id_col: str = "ord", index_rows: int | None = None) -> DataFrame:
    """Rows that match no protected text, by exact value or key, on any side."""
    hit = matches(rows, index, sides, id_col, index_rows).select(id_col).distinct()
    return rows.join(hit, id_col, "left_anti")


def guard_counts(found: DataFrame, id_col: str = "ord") -> DataFrame:
    """Exact hits, hits by key only (a row is one or the other), and rows hit per set (which overlap)."""
    rows = found.groupBy(id_col).agg(F.bool_or(F.col("match_type") == "exact").alias("exact"))
    whole = rows.agg(F.count_if(F.col("exact")).alias("exact"), F.count_if(~F.col("exact")).alias("near_dup_only")).select(F.expr("stack(2, 'exact', exact, 'near_dup_only', near_dup_only) AS (what, n)"))
    return whole.unionByName(found.groupBy(F.concat(F.lit("set:"), "set").alias("what")).agg(F.countDistinct(id_col).alias("n")))


def targets(rows: DataFrame, index: DataFrame, sides: Sequence[str], id_col: str = "ord", most: int = 3, index_rows: int | None = None) -> DataFrame:
    """id, set, side, rank, target: up to ``most`` protected texts that a side matches, exact ones first."""
    hit = probes(rows, sides, id_col).join(_side(index, index_rows), ["kind", "value"])
    one = hit.groupBy(id_col, "set", "side", "target").agg(F.max(F.col("kind") == "exact").alias("exact"))
    w = Window.partitionBy(id_col, "set", "side").orderBy(F.desc("exact"), "target")
    return one.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= most).select(id_col, "set", "side", "rank", "target")


def merged(found: DataFrame, id_col: str = "ord", group: Column | None = None) -> DataFrame:
    """Several sets as one, or as the groups that ``group`` maps them to: exact wins, sides unite."""
    by = [id_col, *([group.alias("set")] if group is not None else [])]
    got = found.groupBy(*by).agg(F.bool_or(F.col("match_type") == "exact").alias("exact"), F.bool_or(F.col("side").isin("src", "both")).alias("a"), F.bool_or(F.col("side").isin("tgt", "both")).alias("b"))
    return got.select(id_col, *(["set"] if group is not None else []), F.when(F.col("exact"), "exact").otherwise("near_dup").alias("match_type"), side_label(F.col("a"), F.col("b")).alias("side"))


def by_priority(found: DataFrame, priority: Sequence[str], id_col: str = "ord") -> DataFrame:
    """One row per id: that of its set which stands first in ``priority``."""
    place = F.array_position(F.array(*map(F.lit, priority)), F.col("set"))
    return found.groupBy(id_col).agg(F.min_by(F.struct("set", "match_type", "side"), place).alias("m")).select(id_col, "m.*")


def breakdown(found: DataFrame, sets: Sequence[str]) -> DataFrame:
    """Counts by set, by set and type, by set and side, and by all three; cells of zero are there, under ``all`` where a column is summed."""
    spark = found.sparkSession
    counted = found.groupingSets([("set",), ("set", "match_type"), ("set", "side"), ("set", "match_type", "side")], "set", "match_type", "side").agg(F.count("*").alias("n"), F.grouping("match_type").alias("gt"), F.grouping("side").alias("gs"))
    counted = counted.select("set", F.when(F.col("gt") == 1, "all").otherwise(F.col("match_type")).alias("match_type"), F.when(F.col("gs") == 1, "all").otherwise(F.col("side")).alias("side"), "n")
    grid = spark.createDataFrame([(s, t, d) for s in sets for t in ("all", "exact", "near_dup") for d in ("all", "src", "tgt", "both")], "set string, match_type string, side string")
    return F.broadcast(grid).join(counted, ["set", "match_type", "side"], "left").select("set", "match_type", "side", F.coalesce("n", F.lit(0)).alias("n"))


def pattern_hits(docs: DataFrame, text_col: str, patterns: dict[str, str], known: Sequence[str] = ()) -> DataFrame:
    """name, hits, docs: matches of each pattern, and of literals that stand in a text (once each)."""
    text = F.col(text_col)
    counts = [F.struct(F.lit(n).alias("name"), F.regexp_count(text, F.lit(p)).cast("long").alias("n")) for n, p in patterns.items()]
    if known:
        present = F.size(F.filter(F.array(*map(F.lit, known)), lambda x: F.contains(text, x))).cast("long")
        counts.append(F.struct(F.lit("literals").alias("name"), present.alias("n")))
    return docs.select(F.inline(F.array(*counts))).groupBy("name").agg(F.sum("n").alias("hits"), F.count_if(F.col("n") > 0).alias("docs"))
