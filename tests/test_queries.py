"""Every registered query with SQL against DuckDB on the smallest tables."""

import math
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ENGINE = [n for n in entry.queries() if n != "pipeline" and not n.startswith("op")]


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, Decimal)):
        return None if math.isnan(v) else round(float(v), 6)
    return v


@pytest.mark.parametrize("name", ENGINE)
def test_query(spark, small, duck, name):
    df = entry.queries()[name](spark, small)
    names = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    sql = entry.oracle_sql().get(name)
    if sql:
        found = duck.sql(sql)
        at = [found.columns.index(c) for c in names]
        assert sorted(found.columns) == names
        assert got == sorted(repr([plain(r[i]) for i in at]) for r in found.fetchall())
    else:
        assert got


def test_entry(spark):
    assert entry.entry(spark).count() == 10
