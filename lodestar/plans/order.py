"""Orders without a single sorting task: boundaries and row numbers."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Key = tuple[str, bool]  # a column and whether it descends; nulls are lowest


def sort(keys: Sequence[Key], flip: bool = False) -> list[Column]:
    return [F.col(c).desc_nulls_last() if down != flip else F.col(c).asc_nulls_first() for c, down in keys]


def before(keys: Sequence[Key], other: str) -> Column:
    """Whether a row stands before the row of struct ``other`` (with the same key columns)."""
    terms, same = [], F.lit(True)
    for c, down in keys:
        a, b = (F.col(f"{other}.{c}"), F.col(c)) if down else (F.col(c), F.col(f"{other}.{c}"))
        terms.append(same & F.coalesce(a < b, a.isNull() & b.isNotNull()))
        same = same & F.col(c).eqNullSafe(F.col(f"{other}.{c}"))
    return reduce(lambda x, y: x | y, terms)


def cut(df: DataFrame, keys: Sequence[Key], edge: DataFrame, keep_before: bool, without: bool, inclusive: bool = True) -> DataFrame:
    """Rows before the edge row, or those from it on (``inclusive``, else after it); ``without``: what to keep if there is no edge.

    The edge has one row at most, so the join that brings it to every row is a broadcast of one row.
    """
    one = edge.select(F.struct(*[F.col(c) for c, _ in keys]).alias("__edge"))
    at = df.join(F.broadcast(one), F.lit(True), "left")
    inside = before(keys, "__edge")
    if not inclusive:
        inside = inside | reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__edge.{c}")) for c, _ in keys])
    return at.where(F.when(F.col("__edge").isNull(), F.lit(without)).otherwise(inside if keep_before else ~inside)).drop("__edge")


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the cluster's folder; a local one only where none is set."""
    spark: SparkSession = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        found = context.getConf().get("spark.checkpoint.dir", None)
        if not found and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="lodestar-"))
    return df.checkpoint()


def numbered(df: DataFrame, keys: Sequence[Key], name: str) -> DataFrame:
    """Rows in order with their number from 0: a range sort, and one count per partition."""
    ordered = checkpoint(df.orderBy(*sort(keys)).withColumn("__id", F.monotonically_increasing_id()))
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    counts = sorted((r["p"], r["n"]) for r in ordered.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # a row per partition
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    table = df.sparkSession.createDataFrame(starts, "p long, start long")
    return ordered.join(F.broadcast(table), part == F.col("p")).withColumn(name, F.col("start") + place).drop("__id", "p", "start")
