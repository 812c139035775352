"""Helpers that the training-data operators share: tables, shared storage, ranks and joins."""

from __future__ import annotations

import gc
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.plans.workers import group_arrow, map_arrow

__all__ = ["BROADCAST_ROWS", "attach", "by_text", "forget", "free_shuffles", "group_arrow", "hash_order", "ids_and_texts", "is_small", "map_arrow", "materialise", "prefix_digits", "running_total", "shared_dir", "slices", "table"]

#: Rows of a small table, and bytes where it is written out, that may be broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20
#: Rows, and bytes of their texts, that are turned into Python objects at once.
SLICE_ROWS, SLICE_BYTES = 512, 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only in local mode where none is set."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lodestar-")
        context.setCheckpointDir(found)
    return found


def place_of(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestar-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target, system = place_of(spark, path)
    system.deleteOnExit(target)
    found = spark.read.schema(df.schema).parquet(path)
    found.written_at = path
    return found


def forget(*frames: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for frame in frames:
        target, system = place_of(frame.sparkSession, frame.written_at)
        system.delete(target, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that are gone: it does so once the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def is_small(frame: DataFrame) -> bool:
    """Whether a table may be broadcast, by its rows and, if it was materialised, by its bytes."""
    if path := getattr(frame, "written_at", None):
        target, system = place_of(frame.sparkSession, path)
        if system.getContentSummary(target).getLength() > BROADCAST_BYTES:
            return False
    return frame.count() <= BROADCAST_ROWS


def attach(df: DataFrame, small: DataFrame, on: Sequence[str] | Column, how: str = "inner") -> DataFrame:
    """Join ``small``, broadcast only if it is small, else shuffled under AQE."""
    return df.join(F.broadcast(small) if is_small(small) else small, on, how)


def hash_order(key: Column) -> Column:
    """A reproducible pseudo-random order that SQL engines share: md5 of the key's text."""
    return F.md5(F.coalesce(key.cast("string"), F.lit("")))


def prefix_digits(rows: int) -> int:
    """Hex digits of an md5 that split ``rows`` into about sqrt(rows) groups of sqrt(rows)."""
    return max(1, math.ceil(math.log(max(rows, 1), 16) / 2))


def running_total(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], value: str, out: str) -> DataFrame:
    """Add the sum of ``value`` over the rows of the same keys that come earlier.

    ``bucket`` must not decrease along ``order``. Only one bucket of a key meets in a task,
    so a key that holds a third of all rows is spread; a second window runs over bucket sums.
    Keys must not be null.
    """
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, bucket, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(starts, [*keys, bucket])
        .withColumn(out, F.col("__inside") + F.col("__start"))
        .drop("__inside", "__start")
    )


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of the batches of few rows and bytes, so that little is in Python at once; a longer row comes alone."""
    for batch in batches:
        texts = [c for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_binary(c.type)]
        total = np.zeros(batch.num_rows + 1, "int64")
        for c in texts:
            total[1:] += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(total)
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(total, total[start] + most, side="right")) - 1
            end = min(max(end, start + 1), start + rows, batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def by_text(work: Callable[[list, list], dict], schema: pa.Schema) -> Callable:
    """A mapInArrow function from (doc_id, text) slices to the columns that ``work`` returns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            made = work(part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_pydict(made, schema=schema)

    return run


def ids_and_texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
