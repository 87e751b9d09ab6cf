from collections import Counter

import pytest

from tidemark.llm import oracle, queries


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query(spark, sf_dir, name):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = connection.sql(oracle.SQL[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == Counter(tuple(r[i] for i in at) for r in found.fetchall())
