"""Every registered query against its SQL in DuckDB, row for row."""

import duckdb
import pytest

import __spark_entry__
from conftest import TABLES

NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
SQL = __spark_entry__.oracle_sql()
QUERIES = __spark_entry__.queries()


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in NAMES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{TABLES}/{name}.parquet'")
    return connection


def plain(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(repr(float(r[i])) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


def test_every_check_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, database, name):
    df = QUERIES[name](spark, TABLES)
    plan = df._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    rows = df.collect()
    assert rows
    if name in SQL:
        result = database.execute(SQL[name])
        columns = [d[0] for d in result.description]
        assert sorted(columns) == sorted(df.columns)
        assert plain(rows, df.columns) == plain(result.fetchall(), columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
