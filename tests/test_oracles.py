"""Every registered query against its SQL counterpart in DuckDB, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from litspan.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(round(r[i], 6)) if isinstance(r[i], float) else repr(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in registry.ORACLES:
        assert got
        return
    expected = duck.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert got == rows(expected.columns, expected.fetchall())
    spark.catalog.clearCache()
