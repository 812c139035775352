"""Delta-style transaction logs, replayed as a DataFrame: JSON commits only, no time travel."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.sources.paths import exists

LOG = "_delta_log"
ACTIONS = """
    add struct<path: string, partitionValues: map<string, string>, size: bigint, modificationTime: bigint, dataChange: boolean, deletionVector: struct<storageType: string>>,
    remove struct<path: string, deletionTimestamp: bigint, dataChange: boolean>,
    metaData struct<id: string, name: string, schemaString: string, partitionColumns: array<string>, configuration: map<string, string>>,
    protocol struct<minReaderVersion: int, minWriterVersion: int, readerFeatures: array<string>>
"""
#: Reader features that change which rows a file has or how its columns are named.
REFUSED = {"deletionVectors", "columnMapping", "v2Checkpoint", "typeWidening"}


class UnsupportedTable(ValueError):
    """A log that needs a reader this engine isn't."""


@dataclass(frozen=True)
class Snapshot:
    files: DataFrame  # path (decoded, absolute), values, size, modified
    partition_columns: tuple[str, ...]
    schema: str | None
    version: int


def is_delta(spark: SparkSession, root: str) -> bool:
    return exists(spark, f"{root.rstrip('/')}/{LOG}")


def actions(spark: SparkSession, root: str) -> DataFrame:
    """Commits' actions with their version and their line in the commit."""
    log = spark.read.schema(ACTIONS).option("pathGlobFilter", "*.json").json(f"{root.rstrip('/')}/{LOG}")
    version = F.coalesce(F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)\.json$", 1).try_cast("bigint"), F.lit(-1))
    return log.select("*", version.alias("version"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("line"))


def snapshot(spark: SparkSession, root: str) -> Snapshot:
    """The active files after all commits: per path the last action, an add before a remove of one version."""
    root = root.rstrip("/")
    log = actions(spark, root)
    last = log.agg(
        F.max_by("metaData", F.when(F.col("metaData").isNotNull(), F.struct("version", "line"))).alias("m"),
        F.max_by("protocol", F.when(F.col("protocol").isNotNull(), F.struct("version", "line"))).alias("p"),
        F.max("version").alias("v"),
    ).first()
    versions = log.where("version >= 0").select("version").distinct().agg(F.min("version").alias("least"), F.max("version").alias("most"), F.count("*").alias("n")).first()
    if versions["n"] and (versions["least"] or versions["n"] != versions["most"] + 1):
        raise UnsupportedTable(f"the log has {versions['n']} commits between versions {versions['least']} and {versions['most']}: the others are missing or only in a checkpoint")
    protocol, meta = last["p"], last["m"]
    if protocol:
        refused = REFUSED.intersection(protocol["readerFeatures"] or ())
        mapped = meta and (meta["configuration"] or {}).get("delta.columnMapping.mode", "none") != "none"
        if refused or mapped or (protocol["minReaderVersion"] or 1) > 3:
            raise UnsupportedTable(f"reader version {protocol['minReaderVersion']}, features {sorted(refused)}{', column mapping' if mapped else ''}")
    moved = log.where("add is not null or remove is not null").select(F.coalesce("add.path", "remove.path").alias("path"), "add", F.struct("version", F.col("add").isNotNull().alias("added"), "line").alias("turn"))
    active = moved.groupBy("path").agg(F.max_by("add", "turn").alias("add"), F.max_by(F.col("add").isNotNull(), "turn").alias("here")).where("here")
    decoded = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))
    whole = F.when(decoded.rlike("^([a-zA-Z][a-zA-Z0-9+.-]*:|/)"), decoded).otherwise(F.concat(F.lit(f"{root}/"), decoded))
    files = active.select(whole.alias("path"), F.col("add.partitionValues").alias("values"), F.col("add.size").alias("size"), F.timestamp_millis("add.modificationTime").alias("modified"))
    return Snapshot(files, tuple(meta["partitionColumns"] or ()) if meta else (), meta["schemaString"] if meta else None, last["v"] if last["v"] is not None else -1)
