"""Lodestar: a typed, composable query engine on PySpark.

Declare a table once as an ``Entity``, open a flat, Hive-partitioned or Delta-logged directory of
Parquet files as a ``Table``, and query it with composable operators. Everything stays a DataFrame.
"""

from lodestar.functions.expressions import Expr, lit
from lodestar.operators.query import Group, Query
from lodestar.schema import Column, Entity
from lodestar.table import Table

__all__ = ["Column", "Entity", "Expr", "Group", "Query", "Table", "lit"]
