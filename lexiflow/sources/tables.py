"""Named tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiflow.session import ship

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``; an unknown name raises before anything is read."""
    if name not in TABLES:
        raise KeyError(f"unknown table {name!r}; known: {', '.join(TABLES)}")
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
