"""Row groups and column statistics from Parquet footers, read by the executors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.plans.workers import map_arrow

GROUPS = "path string, row_group int, rows long, bytes long"
STATISTICS = "path string, row_group int, rows long, column string, physical_type string, logical_type string, null_count long, distinct_count long, min_value string, max_value string"


def _footer(path: str):
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, inside = fs.FileSystem.from_uri(path)
    with system.open_input_file(inside) as file:
        return pq.read_metadata(file)


def row_count(path: str) -> int:
    return _footer(path).num_rows


def row_groups(files: DataFrame) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                footer = _footer(path)
                for k in range(footer.num_row_groups):
                    group = footer.row_group(k)
                    rows.append((path, k, group.num_rows, group.total_byte_size))
            if rows:
                a, b, c, d = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, pa.int32()), pa.array(c, pa.int64()), pa.array(d, pa.int64())], names=["path", "row_group", "rows", "bytes"])

    return map_arrow(files.select("path"), read, GROUPS)


def text_of(value) -> str | None:
    """Statistics as text that Spark casts back: ISO dates and times, plain numbers."""
    if value is None:
        return None
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, bytes):
        return value.decode("utf-8", "replace")
    return value.isoformat() if hasattr(value, "isoformat") else str(value)


def column_statistics(files: DataFrame) -> DataFrame:
    """A row per file, row group and leaf column; min and max as text, null where a footer has none."""
    names = [f.split()[0] for f in STATISTICS.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                footer = _footer(path)
                for k in range(footer.num_row_groups):
                    group = footer.row_group(k)
                    for c in range(group.num_columns):
                        chunk = group.column(c)
                        found = chunk.statistics
                        known = bool(found and found.has_min_max)
                        logical = footer.schema.column(c).logical_type.type
                        rows.append((path, k, group.num_rows, chunk.path_in_schema, chunk.physical_type, logical, found.null_count if found and found.has_null_count else None, found.distinct_count if found and found.has_distinct_count else None, text_of(found.min) if known else None, text_of(found.max) if known else None))
            if rows:
                kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)

    return map_arrow(files.select("path"), read, STATISTICS)


def file_ranges(statistics: DataFrame, column: str, kind: str) -> DataFrame:
    """path, low, high of a column per file: null where a row group has no statistics, so unknown."""
    own = statistics.where(F.lower("column") == column.lower())
    unknown = F.max((F.col("min_value").isNull() & (F.col("rows") > F.coalesce("null_count", F.lit(-1)))).cast("int")) == 1
    low, high = F.min(F.col("min_value").try_cast(kind)), F.max(F.col("max_value").try_cast(kind))
    return own.groupBy("path").agg(F.when(~unknown, low).alias("low"), F.when(~unknown, high).alias("high"), unknown.alias("unknown"))
