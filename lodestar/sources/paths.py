"""Paths, listings and Hive-style partition values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARQUET = "*.[pP][aA][rR][qQ][uU][eE][tT]"
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def is_parquet(path: str) -> bool:
    return path.lower().endswith(".parquet")


def parse_partition_values(path: str) -> dict[str, str]:
    """key=value segments of a path, both sides non-empty; of equal keys the last."""
    pairs = (s.split("=", 1) for s in path.replace("\\", "/").split("/") if "=" in s)
    return {k: v for k, v in pairs if k and v}


def normalise_prefix(prefix: str) -> str:
    """Without leading and with one trailing slash; '' stays."""
    prefix = prefix.strip("/")
    return f"{prefix}/" if prefix else ""


def blob_uri(account: str, container: str, prefix: str = "", host: str = "dfs.core.windows.net") -> str:
    return f"abfss://{container}@{account}.{host}/{normalise_prefix(prefix)}"


def account_of(connection: str) -> dict[str, str]:
    """The settings of a storage connection string."""
    return dict(part.split("=", 1) for part in connection.split(";") if "=" in part)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def values_map(path: Column) -> Column:
    """parse_partition_values of a path as a map column."""
    pairs = F.filter(F.split(path, "/"), lambda s: s.rlike("^[^=]+=.+$"))
    keyed = F.transform(pairs, lambda s: F.struct(F.substring_index(s, "=", 1).alias("key"), F.url_decode(F.replace(s.substr(F.instr(s, "=") + 1, F.length(s)), F.lit("+"), F.lit("%2B"))).alias("value")))
    last = F.filter(keyed, lambda p, k: ~F.exists(F.slice(keyed, k + 2, F.greatest(F.size(keyed), F.lit(1))), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def files(spark: SparkSession, root: str) -> DataFrame:
    """path, size, modified of every Parquet file below root; file contents aren't read.

    Names that start with _ or . are Spark's own and hidden.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", PARQUET).load(root)
    return listed.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def partitions(listed: DataFrame) -> DataFrame:
    """path, values and files of every directory that holds Parquet files."""
    folder = F.regexp_replace("path", "/[^/]*$", "")
    grouped = listed.groupBy(folder.alias("folder")).agg(F.sort_array(F.collect_list(F.struct("path", "size", "modified"))).alias("files"))
    return grouped.select(F.col("folder").alias("path"), values_map(F.col("folder")).alias("values"), "files")
