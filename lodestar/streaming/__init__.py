"""The same entities as streams of arriving files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.schema import Entity
from lodestar.sources.paths import PARQUET


def read_stream(spark: SparkSession, entity: Entity, root: str) -> DataFrame:
    """Files of the declared schema as they arrive; partition columns come from their paths."""
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(entity.file_name(p), c.data_type, True) for p, c in entity.columns.items() if not c.partition])
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", PARQUET).parquet(root)
    out = []
    for p, c in entity.columns.items():
        if c.partition:
            found = F.regexp_extract(F.col("_metadata.file_path"), f"(?i)/{entity.file_name(p)}=([^/]+)/", 1)
            value = F.when(found != "", F.url_decode(found))
            out.append((F.lower(value) if c.type == "string" else value.cast(c.data_type)).alias(p))
        else:
            out.append(F.col(f"`{entity.file_name(p)}`").alias(p))
    return stream.select(*out)
