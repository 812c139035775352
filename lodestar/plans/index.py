"""A cached, sorted copy of one column: repeated counts and lookups skip most of it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILE, PLACE = "__file", "__place"


class ColumnIndex:
    """The column, the partition columns and the file of each row, range-partitioned and sorted.

    Cached batches keep their least and greatest values, so equality, ranges and prefixes read few.
    """

    def __init__(self, scan: DataFrame, column: str, partitions: list[str], sort_key: Callable | None = None):
        self.column, self.covers = column, frozenset([column, *partitions])
        frame = scan.select(column, *partitions, FILE)
        key = sort_key(F.col(column)) if sort_key else F.col(column)
        self.frame = frame.repartitionByRange(key).sortWithinPartitions(key).persist(StorageLevel.MEMORY_AND_DISK)

    def drop(self) -> None:
        self.frame.unpersist()

    def files(self, condition) -> list[str]:
        return [r[0] for r in self.frame.where(condition).select(FILE).distinct().collect()]


def only_files(scan: DataFrame, files: list[str]) -> DataFrame:
    """The rows of those files; Spark opens no others. Local files go by two spellings."""
    files = [f for path in files for f in ({path, re.sub("^file:/+", "file:/", path), re.sub("^file:/+", "file:///", path)})]
    return scan.where(F.col(FILE).isin(files)) if files else scan.where(F.lit(False))
