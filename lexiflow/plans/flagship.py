"""The flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.plans.registry import query
from lexiflow.sources.tables import table


@query(
    "flagship_near_dup_by_lang",
    """
    WITH k AS (
      SELECT doc_id, lang, nullif(regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g'), '') AS key FROM documents
    ), f AS (SELECT doc_id, lang, key, min(doc_id) OVER (PARTITION BY key) AS first_id FROM k)
    SELECT lang, count(*) AS n_docs, count(*) FILTER (key IS NULL OR doc_id = first_id) AS n_kept FROM f GROUP BY lang
    """,
)
def flagship_near_dup_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    key = F.nullif(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]", ""), F.lit(""))
    keyed = docs.select("doc_id", "lang", F.sha2(key, 256).alias("key"))
    first = keyed.filter("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("first_id"))
    kept = F.col("key").isNull() | (F.col("doc_id") == F.col("first_id"))
    return keyed.join(first, "key", "left").groupBy("lang").agg(F.count("*").alias("n_docs"), F.count_if(kept).alias("n_kept"))
