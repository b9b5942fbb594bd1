"""The training-data queries that SQL can express, against it."""

from __future__ import annotations

import duckdb
import pytest

from tests.test_queries import SMALL, TABLES, rows
from threshmill.llm import queries, sql


@pytest.mark.parametrize("name", sorted(sql.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    mine, theirs = queries.QUERIES[name](spark, SMALL).toPandas(), duck.execute(sql.ORACLE_SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)
