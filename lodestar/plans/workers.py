"""Python on executors: the package travels with the job, batches and idle workers stay small."""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Applications whose executors have been sent this package.
SENT: set[str] = set()
#: Bytes of an Arrow batch that goes to Python, at most, but for a single longer row.
BATCH_BYTES = 8 << 20


def send(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, and bound Arrow batches by bytes."""
    context = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")
    if context.applicationId in SENT:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="lodestar-")) / "lodestar.zip"
    with zipfile.ZipFile(archive, "w") as file:
        for path in sorted(root.rglob("*.py")):
            file.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    SENT.add(context.applicationId)


def give_back() -> None:
    """Return freed memory to the system: workers live on between tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_arrow(df: DataFrame, work: Callable, schema) -> DataFrame:
    """mapInArrow with this package on the executors."""
    send(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def group_arrow(df: DataFrame, keys: list[str], work: Callable[[pa.Table], pa.Table], schema) -> DataFrame:
    """groupBy(keys).applyInArrow with this package on the executors."""
    send(df.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        try:
            return work(table)
        finally:
            give_back()

    return df.groupBy(*keys).applyInArrow(run, schema)
