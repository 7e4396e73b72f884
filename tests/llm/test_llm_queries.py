"""The queries with SQL against DuckDB, on the smallest tables."""

import pytest
from test_queries import SF, duck, rows  # noqa: F401

from daytable.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):  # noqa: F811
    mine, theirs = QUERIES[name](spark, SF), duck.execute(SQL[name])
    columns = [c[0] for c in theirs.description]
    assert sorted(mine.columns) == sorted(columns)
    assert rows(mine.columns, mine.collect()) == rows(columns, theirs.fetchall())
