"""Where queries are registered, and the views that they share with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiflow.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The word and blank classes in DuckDB's dialect.
SQL_WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
SQL_WORD = r"[\p{L}\p{N}_]+"

PAIRS_SQL = """pairs AS (
  SELECT conv_id * 1000 + turn AS ord, text AS src, tgt FROM (
    SELECT conv_id, turn, role, text, lead(text) OVER w AS tgt, lead(role) OVER w AS next_role
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant')"""

EVAL_SQL = """evals AS (
  SELECT doc_id, lang AS slice, 'e' || (doc_id % 3 + 1) AS split, text AS ref,
    array_to_string(list_filter(string_split(text, ' '), lambda x, i: i % 4 <> 0), ' ') AS hyp,
    array_to_string(list_filter(string_split(text, ' '), lambda x, i: i % 5 <> 0), ' ') AS hyp_b
  FROM documents)"""


def query(name: str, sql: str | None = None):
    """Register a ``(spark, sf_dir)`` function under ``name``, with its DuckDB twin if there is one."""

    def register(f):
        if name in QUERIES:
            raise KeyError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question and answer of each exchange: ord, src, tgt."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("src"), F.lead("text").over(w).alias("tgt"), F.lead("role").over(w).alias("next_role"))
    return turns.filter("role = 'user' AND next_role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), "src", "tgt")


def evals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References with two systems' hypotheses: every fourth, and every fifth, word left out."""
    parts = F.split("text", " ")
    without = lambda n: F.array_join(F.filter(parts, lambda x, i: (i + 1) % n != 0), " ")
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.col("lang").alias("slice"), F.concat(F.lit("e"), (F.col("doc_id") % 3 + 1).cast("string")).alias("split"), F.col("text").alias("ref"), without(4).alias("hyp"), without(5).alias("hyp_b"))
