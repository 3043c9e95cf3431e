"""Intermediate tables in the folder that all machines share, and helpers for Arrow stages."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession


_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, a fresh local folder serves a local master; a cluster must name one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lexiflow-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """``wanted``, with underscores before what a table already has as a column name."""
    used = {c.lower() for c in taken}
    out = []
    for name in wanted:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a reader of it.

    This cuts the lineage: a lost executor costs a rerun of reading tasks only, and a result that
    depends on row order (ids by position) is fixed for all later readers. The files go when the
    JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    # The table stands for what led to it, so the shuffle files of this job can go at once.
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before) if before is not None else spark.conf.unset(_CLEAN_UP)
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(schema).parquet(path)


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files that a materialized frame reads."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = 1 << 20, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the values of ``column`` in one slice come to about ``most`` bytes (one row at least), in at most ``rows`` rows.

    At the end of a task its free memory goes back to the system, as workers are used again and
    idle ones would keep the most they ever needed.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        array = batch.column(column)
        sizes = pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and (total + n > most or i - start >= rows):
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)
    give_back()


def give_back() -> None:
    """Return unused memory of this process to the system, where the platform can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


class RowIds:
    """Numbers rows within a task: the same for every retry, as the input splits of a scan are fixed."""

    def __init__(self) -> None:
        self.next = TaskContext.get().partitionId() << 33

    def take(self, n: int) -> range:
        got = range(self.next, self.next + n)
        self.next += n
        return got
