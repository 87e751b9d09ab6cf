"""Every query with SQL gives the same rows in DuckDB."""

from collections import Counter

import pytest

from tidemark import oracle, queries, source_oracle, source_queries

QUERIES, SQL = queries.QUERIES | source_queries.QUERIES, oracle.SQL | source_oracle.SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    connection.sql("SET timezone = 'UTC'")
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return connection


def plain(value):
    return round(value, 6) + 0.0 if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = duck.sql(SQL[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert got == Counter(tuple(plain(r[i]) for i in at) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    rows = {r.verdict: r.pairs for r in __spark_entry__.entry(spark).collect()}
    assert rows == {"likely_legitimate": 89, "unclassified": 41, "confirmed_waste": 1}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
