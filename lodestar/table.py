"""Tables: an entity over a directory of Parquet files."""

from __future__ import annotations

import time
import warnings
from collections.abc import Callable
from typing import Any
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.expressions import Row, of
from lodestar.operators.query import SCAN_ORDER, Query
from lodestar.plans.index import FILE, ColumnIndex, only_files
from lodestar.schema import Entity
from lodestar.sources import delta, footers
from lodestar.sources.paths import account_of, blob_uri, files, partitions
from lodestar.sources.scan import scan

#: Files that a zone map or an index may name in a filter; with more, the scan isn't narrowed.
NAMED_FILES = 2000
#: Files from which on statistics are read to rule some out; fewer are as quickly read.
PRUNE_FROM = 8
#: Footers that ``take`` reads, at most, to learn which leading files hold its rows.
LEADING = 16
BOUNDS = {
    "==": lambda low, high, v: (low <= v) & (high >= v),
    "<": lambda low, high, v: low < v,
    "<=": lambda low, high, v: low <= v,
    ">": lambda low, high, v: high > v,
    ">=": lambda low, high, v: high >= v,
}


class Table(Query):
    """The root of queries. ``ttl``: seconds for which a listing, and the indexes over it, are kept."""

    def __init__(self, spark: SparkSession, entity: Entity, source: Callable[[], Callable[[bool], DataFrame]], root: str | None = None, ttl: float = 300.0, partitions_source: Callable[[], DataFrame] | None = None, statistics: Callable[[DataFrame], DataFrame] = footers.column_statistics):
        """``partitions_source``: another listing of partitions. ``statistics``: another source of statistics: of the
        files (path, ...) to rows as ``column_statistics`` gives."""
        self.spark, self.entity, self.root = spark, entity, root
        self._source, self._partitions_source, self._ttl, self._statistics = source, partitions_source, ttl, statistics
        self._indexes: dict[str, ColumnIndex] = {}
        self._forget()
        self._opened = time.monotonic()
        super().__init__(source(), list(entity.columns), SCAN_ORDER, root=self)

    @classmethod
    def from_path(cls, spark: SparkSession, entity: Entity, root: str, ttl: float = 300.0, **hooks: Callable) -> Table:
        """A flat, Hive-partitioned or Delta-logged directory, or one file, on any Hadoop file system."""
        if not root or not root.strip():
            raise ValueError("a table needs a path")
        return cls(spark, entity, lambda: scan(spark, root, entity), root, ttl, **hooks)

    @classmethod
    def from_azure_blob(cls, spark: SparkSession, entity: Entity, connection: str, container: str, prefix: str = "", ttl: float = 300.0) -> Table:
        """By connection string: its key or signature goes to the Hadoop configuration, the path is an abfss URI."""
        settings = account_of(connection)
        account = settings.get("AccountName")
        if not account or not container:
            raise ValueError("a blob table needs an account name and a container")
        found = {}
        if key := settings.get("AccountKey"):
            found["fs.azure.account.key"] = key
        elif signature := settings.get("SharedAccessSignature"):
            found |= {"fs.azure.account.auth.type": "SAS", "fs.azure.sas.fixed.token": signature}
        return cls.from_azure_container(spark, entity, account, container, prefix, found, ttl, f"dfs.{settings.get('EndpointSuffix', 'core.windows.net')}")

    @classmethod
    def from_azure_container(cls, spark: SparkSession, entity: Entity, account: str, container: str, prefix: str = "", settings: dict[str, str] | None = None, ttl: float = 300.0, host: str = "dfs.core.windows.net") -> Table:
        """With the credentials that the Hadoop configuration has, or with ``settings`` of the account for it (a token
        provider's, say), named as there without the account."""
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for name, value in (settings or {}).items():
            conf.set(f"{name}.{account}.{host}", value)
        return cls.from_path(spark, entity, blob_uri(account, container, prefix, host), ttl)

    @classmethod
    def from_frame(cls, df: DataFrame, entity: Entity | None = None) -> Table:
        """Any DataFrame as a table: custom readers and mappers plug in here."""
        found = entity or Entity.of(df.schema)
        ordered = df.select(*found.columns, F.lit("").alias("__file"), F.monotonically_increasing_id().alias("__place"))
        plain = df.select(*found.columns)
        return cls(df.sparkSession, found, lambda: lambda with_order: ordered if with_order else plain)

    def _fresh(self) -> None:
        """Forget listings and indexes that are older than the time to live."""
        if time.monotonic() - self._opened > self._ttl:
            self.refresh()

    def refresh(self) -> None:
        for index in self._indexes.values():
            index.drop()
        self._indexes.clear()
        self._forget()
        if self.root:
            self.spark.catalog.refreshByPath(self.root)
        self._make, self._made, self._opened = self._source(), {}, time.monotonic()

    def where(self, condition: Any) -> Query:
        self._fresh()
        return super().where(condition)

    # file pruning
    def _forget(self) -> None:
        """What is known of the files' statistics."""
        for frame in getattr(self, "_ranges", {}).values():
            frame.unpersist()
        self._ranges: dict[str, DataFrame] = {}
        self._paths: list[str] | None = None
        self._within: dict[tuple, list[str] | None] = {}

    def _listed(self) -> list[str]:
        """The scan's files as Spark lists them, in their order."""
        if self._paths is None:
            self._paths = sorted(self._lean.inputFiles(), key=unquote) if self.root else []
        return self._paths

    def _ranges_of(self, column: str) -> DataFrame:
        """path, low, high and unknown of a column by file, read once."""
        if column not in self._ranges:
            kind = self.entity.columns[column].data_type.simpleString()
            self._ranges[column] = footers.file_ranges(self.column_statistics(), self.entity.file_name(column), kind).persist()
        return self._ranges[column]

    def _holding(self, bounds: tuple) -> list[str] | None:
        """Paths of the files whose statistics allow the bounds; None if that names no fewer, or too many.

        Statistics are read once for each column and kept as long as the listing. Where they can't be
        read, as without credentials for the footers, nothing is ruled out.
        """
        named = None
        for column in sorted({c for c, _, _ in bounds if not self.entity.columns[c].partition}):
            fits = F.lit(True)
            for c, op, value in bounds:
                fits = fits & BOUNDS[op](F.col("low"), F.col("high"), F.lit(value)) if c == column else fits
            try:
                found = {r[0] for r in self._ranges_of(column).where(F.col("unknown") | F.coalesce(fits, F.lit(False))).select("path").limit(NAMED_FILES + 1).collect()}
            except Exception as error:  # of the footers' file system, whatever it is
                warnings.warn(f"no statistics of {column}: {error}", stacklevel=2)
                return None
            if len(found) <= NAMED_FILES:
                named = found if named is None else named & found
        return None if named is None or len(named) >= len(self._listed()) else sorted(named)

    def within(self, bounds: tuple, ordered: bool) -> DataFrame:
        """The scan, without files that statistics rule out. The filters must apply again."""
        if not bounds or len(self._listed()) < PRUNE_FROM:
            return self._frame_of(ordered)
        if bounds not in self._within:
            self._within[bounds] = self._holding(bounds)
        if (named := self._within[bounds]) is None:
            return self._frame_of(ordered)
        found = only_files(self._df, named)
        return found if ordered else found.select(*self._lean.columns)

    def leading(self, n: int) -> DataFrame:
        """The scan, only its first files where footers show that those hold ``n`` rows."""
        paths, rows = self._listed(), 0
        for k, path in enumerate(paths[: min(LEADING, len(paths) - 1)]):
            try:
                rows += footers.row_count(path)
            except Exception:  # as above: then the whole scan is read
                break
            if rows >= n:
                return only_files(self._df, [unquote(p) for p in paths[: k + 1]])
        return self._df

    # metadata
    def files(self) -> DataFrame:
        """path, size, modified of the table's files; for a log, of its active ones."""
        if delta.is_delta(self.spark, self.root):
            return delta.snapshot(self.spark, self.root).files.select("path", "size", "modified")
        return files(self.spark, self.root)

    def partitions(self) -> DataFrame:
        """path, values, files: a row per directory (or set of the log's partition values)."""
        if self._partitions_source:
            return self._partitions_source()
        if delta.is_delta(self.spark, self.root):
            folder = F.regexp_replace("path", "/[^/]*$", "")
            return delta.snapshot(self.spark, self.root).files.groupBy(folder.alias("folder")).agg(F.first("values").alias("values"), F.sort_array(F.collect_list(F.struct("path", "size", "modified"))).alias("files")).withColumnRenamed("folder", "path")
        return partitions(files(self.spark, self.root))

    def row_groups(self) -> DataFrame:
        return footers.row_groups(self.files())

    def column_statistics(self) -> DataFrame:
        return self._statistics(self.files())

    def columns_of_files(self) -> list[str]:
        return [f.name for f in self._lean.schema.fields if not f.name.startswith("__")]

    # narrowing
    def in_range(self, column: str, low: Any = None, high: Any = None) -> Query:
        """Rows with low <= column <= high; footers rule out files first. Unknown statistics keep a file."""
        self._fresh()
        ranges = self._ranges_of(column)
        keep, rows = F.lit(True), F.lit(True)
        if low is not None:
            keep, rows = keep & (F.col("high") >= F.lit(low)), rows & (F.col(column) >= F.lit(low))
        if high is not None:
            keep, rows = keep & (F.col("low") <= F.lit(high)), rows & (F.col(column) <= F.lit(high))
        named = ranges.where(F.col("unknown") | F.coalesce(keep, F.lit(False))).select("path").limit(NAMED_FILES + 1).collect()
        base = self._df if len(named) > NAMED_FILES else only_files(self._df, [r[0] for r in named])
        return Query(base.where(rows), self.columns, SCAN_ORDER)

    def column_index(self, column: str) -> ColumnIndex:
        """The cached index of a column, built at its first use."""
        self._fresh()
        if column not in self._indexes:
            self._indexes[column] = ColumnIndex(self._df, column, [p for p in self.entity.partition_columns if p != column], self.entity.columns[column].sort_key)
        return self._indexes[column]

    def _usable(self, filters) -> tuple[ColumnIndex, Any] | None:
        row = Row(self.entity.columns)
        found = [of(row[f] if isinstance(f, str) else f(row) if callable(f) else f) for f in filters]
        reads = frozenset().union(*(e.reads for e in found))
        if not found or not all(e.reads for e in found):
            return None
        for column in self.entity.indexed_columns:
            if column in reads and reads <= frozenset([column, *self.entity.partition_columns]):
                condition = F.lit(True)
                for e in found:
                    condition = condition & e.col
                return self.column_index(column), condition
        return None

    def indexed_count(self, filters) -> int | None:
        """Count of scan and filters alone, if one indexed column and partition columns decide it."""
        usable = self._usable(filters)
        return usable[0].frame.where(usable[1]).count() if usable else None

    def lookup(self, condition: Any) -> Query:
        """where(), but the index names the files first, if it covers the condition. The filter applies again."""
        usable = self._usable([condition])
        if not usable:
            return self.where(condition)
        named = usable[0].files(usable[1])
        base = self._df if len(named) > NAMED_FILES else only_files(self._df, named)
        return Query(base, self.columns, SCAN_ORDER).where(condition)


__all__ = ["FILE", "Table"]
