"""A content-addressed cache of scored chunks: only what is missing or stale is scored again."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

SCHEMA = "digest string, chunk long, ord long, score double, run string, size long"


def chunked(rows: DataFrame, order: str, columns: list[str], size: int) -> DataFrame:
    """``chunk`` of each row, and the ``digest`` of its chunk's contents in order."""
    placed = rows.withColumn("chunk", F.floor(F.col(order) / size).cast("long"))
    text = F.to_json(F.array_sort(F.collect_list(F.struct(order, *columns))))
    return placed.join(placed.groupBy("chunk").agg(F.sha2(text, 256).alias("digest")), "chunk")


def cached(spark: SparkSession, path: str) -> DataFrame:
    """What the cache holds: of each digest the last run of scoring that covers its chunk with finite numbers."""
    try:
        found = spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], SCHEMA)
    sound = F.coalesce(F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf")), F.lit(False))
    runs = found.groupBy("digest", "run").agg(F.count_if(sound).alias("good"), F.count("*").alias("n"), F.max("size").alias("size"))
    last = runs.filter((F.col("good") == F.col("size")) & (F.col("n") == F.col("size"))).groupBy("digest").agg(F.max("run").alias("run"))
    return found.join(last, ["digest", "run"])


def score_missing(rows: DataFrame, order: str, columns: list[str], path: str, size: int, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Scores of all rows: from the cache, and from ``score`` (which adds a column ``score``) for chunks it lacks, which are added to it.

    A chunk that comes back with a row short, or with a score that is no finite number, is not held: it is
    scored again at the next call, and its rows have a null score until then. Each call is a run of its
    own, so what an earlier one left behind does not count against a chunk.
    """
    spark = rows.sparkSession
    placed = chunked(rows, order, columns, size)
    missing = placed.join(cached(spark, path).select("digest").distinct(), "digest", "left_anti")
    if not missing.isEmpty():
        run = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        sizes = missing.groupBy("digest").agg(F.count("*").alias("size"))
        scored = score(missing).select("digest", "chunk", F.col(order).cast("long").alias("ord"), F.col("score").cast("double").alias("score"))
        scored.join(sizes, "digest").withColumn("run", F.lit(run)).select("digest", "chunk", "ord", "score", "run", "size").write.mode("append").parquet(path)
    return placed.select("digest", order).join(cached(spark, path).select("digest", F.col("ord").alias(order), "score"), ["digest", order], "left").select(order, "score")
