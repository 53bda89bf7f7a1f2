"""Every catalogued query against its SQL in DuckDB, at the smallest scale."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans import catalog, catalog_words  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    rows = df.collect()
    assert len(df.columns) == len(set(df.columns))
    if name not in catalog.ORACLE_SQL:
        return
    want = duck.sql(catalog.ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    got = sorted((tuple(plain(r[c]) for c in cols) for r in rows), key=str)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)


def test_entry(spark):
    assert entry.entry(spark).columns == ["q", "c", "score", "rnk"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
