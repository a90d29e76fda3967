"""Every query that has SQL against it, on whole tables."""

from __future__ import annotations

import duckdb
import pytest

from textloom.llm import catalogue

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, name):
    connection = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    frame = catalogue.queries()[name](spark, sf_dir)
    columns = sorted(frame.columns)
    told = connection.sql(SQL[name])
    assert sorted(told.columns) == columns
    places = [told.columns.index(c) for c in columns]
    assert sorted(tuple(r[i] for i in places) for r in told.fetchall()) == sorted(map(tuple, frame.select(columns).collect()))
