"""The one stateful stream: an append-only run log, watched for a value that keeps rising."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

OUT = "key string, step long, value double, rises long, flag boolean"
_STATE = "last_step long, least double, rises long"


def watch(rows: DataFrame, flag_at: int = 2) -> DataFrame:
    """Rows (key, step, value) of a stream with ``rises`` and ``flag``; state is three numbers per key.

    A value at or below the least so far sets the count back; any other, NaN included, raises it. A
    step that does not come after the last one was logged before a restart and is passed over.
    Rows of one batch are taken in order of step.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, least, rises = state.get if state.exists else (-1, float("inf"), 0)
        out = []
        for r in pd.concat(list(frames)).sort_values("step", kind="stable").itertuples(index=False):
            if r.step <= last:
                continue
            last = int(r.step)
            if r.value <= least:
                least, rises = float(r.value), 0
            else:
                rises += 1
            out.append((key[0], last, float(r.value), rises, rises >= flag_at))
        state.update((last, least, rises))
        yield pd.DataFrame(out, columns=["key", "step", "value", "rises", "flag"])

    return rows.groupBy("key").applyInPandasWithState(step, OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def stream_jsonl(spark: SparkSession, folder: str, schema: str | StructType) -> DataFrame:
    """Files of JSON lines as they come; the schema is declared, never inferred."""
    return spark.readStream.schema(schema).json(folder)
