"""Every query with an oracle against DuckDB on the smallest tables."""

import decimal

import duckdb
import pytest

from riftstats.plans import registry
from riftstats.sources.fixtures import Tables

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, SF)


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return f"{float(v) + 0.0:.5f}"
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.ALL))
def test_same_rows(name, tables, duck):
    query, sql = registry.ALL[name]
    df = query(tables)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    rel = duck.sql(sql)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


def test_names_agree():
    assert set(registry.oracle_sql()) <= set(registry.queries())
