"""Entities: declared, fixed schemas of tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import types as T


@dataclass(frozen=True)
class Column:
    """A property and the file column or partition key it comes from.

    ``type``: a DDL name. ``name``: in the file, by default the property's. ``partition``: the value
    comes from the directory or log. ``allow_missing``: null where files lack the column; only with
    ``nullable``. ``indexed``: Table.count and Table.where may use a cached index. ``sort_key``:
    an expression of the column that orders it, instead of itself.
    """

    type: str
    name: str | None = None
    nullable: bool = True
    partition: bool = False
    allow_missing: bool = False
    indexed: bool = False
    sort_key: Callable | None = None

    def __post_init__(self):
        if self.allow_missing and not self.nullable:
            raise ValueError("allow_missing needs a nullable column")

    @cached_property
    def data_type(self) -> T.DataType:
        """Parsed at first use: a declaration needs no session."""
        return T.StructType.fromDDL(f"x {self.type}")["x"].dataType


class Entity:
    """Properties by name: ``Entity(id=Column("bigint"), region=Column("string", partition=True))``."""

    def __init__(self, **columns: Column):
        if not columns:
            raise ValueError("an entity needs at least one column")
        self.columns = columns

    def file_name(self, prop: str) -> str:
        return self.columns[prop].name or prop

    @property
    def partition_columns(self) -> list[str]:
        return [p for p, c in self.columns.items() if c.partition]

    @property
    def indexed_columns(self) -> list[str]:
        return [p for p, c in self.columns.items() if c.indexed]

    @property
    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(p, c.data_type, c.nullable) for p, c in self.columns.items()])

    @classmethod
    def of(cls, schema: T.StructType) -> Entity:
        """The entity that a DataFrame's schema describes."""
        return cls(**{f.name: Column(f.dataType.simpleString(), nullable=f.nullable) for f in schema.fields})
