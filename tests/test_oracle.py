"""Every query with SQL gives DuckDB's rows."""

import pytest

from batchloom import queries

from .conftest import SF, same_rows


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    same_rows(queries.QUERIES[name](spark, SF), queries.SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
