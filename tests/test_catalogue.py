"""Every query against its SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__
from textloom.plans import catalogue

SQL = catalogue.oracle_sql()
TABLES = "documents benchmark labels conversations embeddings pages".split()


@pytest.fixture(scope="module")
def connection(sf_dir):
    found = duckdb.connect()
    for t in TABLES:
        found.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return found


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, connection, name):
    frame = catalogue.queries()[name](spark, sf_dir)
    columns = sorted(frame.columns)
    told = connection.sql(SQL[name])
    assert sorted(told.columns) == columns
    places = [told.columns.index(c) for c in columns]
    expected = sorted(tuple(str(r[i]) for i in places) for r in told.fetchall())
    assert sorted(tuple(map(str, r)) for r in frame.select(columns).collect()) == expected


def test_entry(spark):
    assert set(catalogue.queries()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
