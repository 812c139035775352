"""DataFrames of an entity's file and partition columns, with the scan's hidden order."""

from __future__ import annotations

import json
from collections.abc import Callable
from contextlib import contextmanager
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.convert import convert
from lodestar.schema import Entity
from lodestar.sources import delta
from lodestar.sources.paths import NO_VALUE, PARQUET, files

FILE, PLACE = "__file", "__place"
INFERENCE = "spark.sql.sources.partitionColumnTypeInference.enabled"


class MissingColumn(ValueError):
    """An entity's column that the files don't have."""


@contextmanager
def text_partitions(spark: SparkSession):
    """Partition values stay text, so that each is read as declared and '06' is not 6."""
    before = spark.conf.get(INFERENCE)
    spark.conf.set(INFERENCE, "false")
    try:
        yield
    finally:
        spark.conf.set(INFERENCE, before)


def raw(spark: SparkSession, root: str, entity: Entity) -> tuple[DataFrame, dict[str, str]]:
    """The files' DataFrame and, by partition property, the name of its text column."""
    keys = {p: entity.file_name(p) for p in entity.partition_columns}
    merge = str(any(c.allow_missing for c in entity.columns.values())).lower()
    if delta.is_delta(spark, root):
        return _delta(spark, root, keys, merge)
    reader = spark.read.option("mergeSchema", merge).option("pathGlobFilter", PARQUET)
    if keys and _irregular(spark, root, keys):
        return _mixed(reader.option("recursiveFileLookup", "true").parquet(root), keys)
    with text_partitions(spark):
        return reader.parquet(root), keys


def _irregular(spark: SparkSession, root: str, keys: dict[str, str]) -> bool:
    """Whether some file lies outside a folder of every key; Spark's own discovery needs all inside."""
    missing = [~F.col("path").rlike(f"(?i)/{key}=[^/]+/") for key in keys.values()]
    return not files(spark, root).where(reduce(lambda a, b: a | b, missing)).isEmpty()


def _mixed(df: DataFrame, keys: dict[str, str]) -> tuple[DataFrame, dict[str, str]]:
    """Partitioned and unpartitioned folders together: values from the paths; filters on them still prune files."""
    named = {}
    for p, key in keys.items():
        found = F.regexp_extract(F.col("_metadata.file_path"), f"(?i)/{key}=([^/]+)/", 1)
        value = F.url_decode(F.replace(found, F.lit("+"), F.lit("%2B")))
        df = df.withColumn(f"__part_{p}", F.when((value != "") & (value != NO_VALUE), value))
        named[p] = f"__part_{p}"
    return df, named


def _delta(spark: SparkSession, root: str, keys: dict[str, str], merge: str) -> tuple[DataFrame, dict[str, str]]:
    shot = delta.snapshot(spark, root)
    active = [r["path"] for r in shot.files.select("path").collect()]  # the log's own metadata: a path a file
    if not active:
        schema = T.StructType.fromJson(json.loads(shot.schema)) if shot.schema else T.StructType()
        return spark.createDataFrame([], schema), keys
    in_path = all(f"/{k.lower()}=" in p.lower() for p in active for k in shot.partition_columns)
    reader = spark.read.option("mergeSchema", merge)
    if in_path:
        with text_partitions(spark):
            return reader.option("basePath", root).parquet(*active), keys
    df = reader.option("recursiveFileLookup", "true").parquet(*active)
    values = shot.files.select(_whole(F.col("path")).alias("__name"), F.col("values").alias("__values")).dropDuplicates(["__name"])
    df = df.withColumn(FILE, F.col("_metadata.file_path")).withColumn(PLACE, F.col("_metadata.row_index")).withColumn("__name", _whole(F.col(FILE)))
    df = df.join(values, "__name")
    named = {}
    for p, key in keys.items():
        df = df.withColumn(f"__part_{p}", F.col("__values")[key])
        named[p] = f"__part_{p}"
    return df, named


def _whole(path: Column) -> Column:
    """One spelling of a file's path: without scheme, authority and escapes."""
    plain = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    return F.regexp_replace(plain, "^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "")


def scan(spark: SparkSession, root: str, entity: Entity) -> Callable[[bool], DataFrame]:
    """The entity's properties as declared; called with True, also the hidden file and place of each row."""
    df, keys = raw(spark, root, entity)
    there = {f.name.lower(): f for f in df.schema.fields}
    out, missing = [], []
    for p, c in entity.columns.items():
        if c.partition:
            value = F.col(f"`{keys[p]}`") if keys[p].lower() in there else F.lit(None)
            value = value.cast("string")
            text = isinstance(c.data_type, T.StringType)
            out.append((F.lower(value) if text else convert(value, T.StringType(), c.data_type, p)).alias(p))
            continue
        found = there.get(entity.file_name(p).lower())
        if found is not None:
            out.append(convert(F.col(f"`{found.name}`"), found.dataType, c.data_type, p).alias(p))
        elif c.allow_missing:
            out.append(F.lit(None).cast(c.data_type).alias(p))
        else:
            missing.append(entity.file_name(p))
    if missing:
        raise MissingColumn(f"columns {', '.join(missing)} are not in the files; there are {', '.join(df.columns)}")
    if FILE in df.columns:
        order = [F.col(FILE), F.col(PLACE)]
    elif "_metadata" in _metadata(df):
        order = [F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(PLACE)]
    else:
        order = [F.lit("").alias(FILE), F.monotonically_increasing_id().alias(PLACE)]
    return lambda ordered: df.select(*out, *order) if ordered else df.select(*out)


def _metadata(df: DataFrame) -> list[str]:
    try:
        df.select("_metadata")
        return ["_metadata"]
    except AnalysisException:
        return []
