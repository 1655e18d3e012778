"""Corpus queries that SQL can express against DuckDB on the smallest tables."""

import duckdb
import pytest

from lexispark.llm import registry

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "pages"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    rel = duck.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, D).select(*rel.columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(rel.fetchall(), key=str)
