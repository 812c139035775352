"""Widening-only conversion from file types to declared types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The declared types that each file type may widen to. Unsigned file types arrive as
#: the next wider signed type.
WIDER = {
    "boolean": ("boolean",),
    "tinyint": ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"),
    "smallint": ("smallint", "int", "bigint", "float", "double", "decimal"),
    "int": ("int", "bigint", "float", "double", "decimal"),
    "bigint": ("bigint", "float", "double", "decimal"),
    "float": ("float", "double", "decimal"),
    "double": ("double", "decimal"),
    "decimal": ("decimal", "double"),
    "string": ("string", "tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "boolean", "date", "timestamp", "timestamp_ntz", "time"),
    "date": ("date", "timestamp", "timestamp_ntz"),
    "timestamp": ("timestamp", "timestamp_ntz", "date"),
    "timestamp_ntz": ("timestamp_ntz", "timestamp", "date"),
    "time": ("time",),
    "binary": ("binary",),
}


class ConversionError(TypeError):
    """A file type that doesn't widen to the declared type."""


def kind(data_type: T.DataType) -> str:
    return data_type.simpleString().split("(")[0].split("<")[0]


def widens(source: T.DataType, target: T.DataType) -> bool:
    if source == target:
        return True
    return kind(target) in WIDER.get(kind(source), ())


def parse_time(text: Column, target: str) -> Column:
    """ISO dates and times, or month/day/year; anything else raises."""
    slashed = F.try_to_timestamp(text, F.lit("MM/dd/yyyy"))
    parsed = F.coalesce(text.try_cast("timestamp"), slashed)
    failed = F.raise_error(F.concat(F.lit("not a date or time: "), text))
    return F.when(text.isNotNull() & parsed.isNull(), failed.cast(target)).otherwise(parsed.cast(target))


def convert(value: Column, source: T.DataType, target: T.DataType, name: str = "column") -> Column:
    """``value`` of file type ``source`` as the declared type; an unchanged type stays a plain column."""
    if source == target:
        return value
    if not widens(source, target):
        raise ConversionError(f"{name}: {source.simpleString()} does not convert to {target.simpleString()}")
    if kind(source) == "string" and kind(target) in ("date", "timestamp", "timestamp_ntz"):
        return parse_time(value, target.simpleString())
    return value.cast(target)
