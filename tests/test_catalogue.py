"""Every query of the catalogue against DuckDB."""

import pytest

from lodestar.queries import FOUND
from tests.oracle import of_spark, of_sql


@pytest.mark.parametrize("name", list(FOUND))
def test_query(spark, small, name):
    make, sql = FOUND[name]
    assert of_spark(make(spark, small)) == of_sql(sql, small)
