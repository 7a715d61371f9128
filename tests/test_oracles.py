"""Each query with SQL gives the same rows as DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from lalespark.plans import registry


def _plain(v):
    return str(round(v, 9)) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    want = duck.sql(registry.ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    have = sorted(tuple(_plain(r[c]) for c in cols) for r in df.collect())
    assert have == sorted(tuple(_plain(r[k]) for k in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_rows_only(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0
