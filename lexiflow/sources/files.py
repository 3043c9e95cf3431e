"""Readers and writers of files, always with a declared schema."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ALLOWED_SPLITS = ("train", "validation")


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType, fields: Sequence[str] = ()) -> DataFrame:
    """JSON lines, gzip included. A line that does not parse stops the read; blank lines are skipped; with ``fields``, only those columns are parsed."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return df.select(*fields) if fields else df


def read_step_rows(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Rows of a run log that carry a throughput and are no evaluation."""
    return read_jsonl(spark, path, schema).filter(F.col("tok_per_sec").isNotNull() & F.col("eval").isNull())


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """One word to a line; lines that begin with ``#`` and blank lines are left out."""
    return spark.read.text(path).select(F.btrim("value").alias("word")).filter((F.col("word") != "") & ~F.col("word").startswith("#"))


def read_split(spark: SparkSession, folder: str, split: str, limit: int | None = None, order: str = "ord") -> DataFrame:
    """One split of a Parquet data set; a limit takes the first rows of the training split in order."""
    if split not in ALLOWED_SPLITS:
        raise ValueError(f"split {split!r} must not be read; allowed: {', '.join(ALLOWED_SPLITS)}")
    df = spark.read.parquet(f"{folder}/{split}")
    return df.orderBy(order).limit(limit) if limit is not None and split == "train" else df


def synthetic_copies(spark: SparkSession, n: int, vocab: int, seed: int = 0, shortest: int = 3, longest: int = 12) -> DataFrame:
    """A copy task: id, src, tgt of hash-drawn token ids; the same rows for the same arguments."""
    draw = lambda *k: F.pmod(F.xxhash64(F.lit(seed), *k), F.lit(1 << 40))
    size = (draw(F.col("id"), F.lit(-1)) % (longest - shortest + 1) + shortest).cast("int")
    tokens = F.transform(F.sequence(F.lit(1), size), lambda i: (draw(F.col("id"), i) % vocab).cast("int"))
    return spark.range(n).select(F.format_string("syn_%07d", "id").alias("id"), tokens.alias("src")).withColumn("tgt", F.col("src"))


def whitelisted(df: DataFrame, json_col: str, paths: Sequence[str]) -> DataFrame:
    """``kept``: a map from each dotted path that a JSON column has to its value as text; missing paths are left out."""
    entries = F.array(*(F.struct(F.lit(p).alias("key"), F.get_json_object(json_col, f"$.{p}").alias("value")) for p in paths))
    return df.withColumn("kept", F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())))


def literals(rows: DataFrame, json_col: str, least: int = 25) -> DataFrame:
    """Distinct string values of JSON rows: all ids, and others of ``least`` characters or more."""
    flat = rows.select(F.explode(F.from_json(json_col, "map<string,string>")).alias("key", "literal"))
    return flat.filter((F.col("key") == "id") | (F.length("literal") >= least)).select("literal").distinct()


def write_jsonl(df: DataFrame, path: str, order: str | None = None, gzip: bool = False) -> None:
    """JSON lines in parts; with ``order``, one ordered file (small tables only)."""
    out = df.coalesce(1).sortWithinPartitions(order) if order else df
    writer = out.write.mode("overwrite")
    (writer.option("compression", "gzip") if gzip else writer).json(path)


def write_shards(df: DataFrame, path: str, rows: int, order: str | None = None) -> None:
    """Parquet files of at most ``rows`` rows, each partition in ``order``. An empty table still leaves a readable file."""
    (df.sortWithinPartitions(order) if order else df).write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(path)


def write_json_atomically(path: str | Path, value: object) -> None:
    """A manifest on the driver's file system: written beside, then renamed over."""
    path = Path(path)
    fd, name = tempfile.mkstemp(dir=path.parent, suffix=".tmp")
    with os.fdopen(fd, "w", encoding="utf-8", newline="\n") as f:
        json.dump(value, f, ensure_ascii=True, indent=1, sort_keys=True)
    os.replace(name, path)


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A small frame as a Markdown table; more than ``most`` rows raise."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of over {most} rows")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|")
    head = "| " + " | ".join(df.columns) + " |"
    return "\n".join([head, "|" + "---|" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])
