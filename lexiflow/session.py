"""What a session needs before the library's Python functions run on executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per Spark context; without it they would have to have it installed."""
    context = spark.sparkContext
    if getattr(context, "_lexiflow_shipped", False):
        return
    top = Path(__file__).parent
    path = Path(tempfile.mkdtemp(prefix="lexiflow-")) / "lexiflow.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    context.addPyFile(str(path))
    context._lexiflow_shipped = True
