"""Registered queries against their SQL in DuckDB, at the smallest scale."""

import math

import duckdb
import pytest

import __spark_entry__
from tidemark import queries as panels

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else str(v)


@pytest.mark.parametrize("name", sorted(panels.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    df = panels.queries()[name](spark, SF)
    found = duck.execute(panels.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(plain(r[names.index(c)]) for c in df.columns) for r in found.fetchall())
    assert sorted(tuple(plain(v) for v in r) for r in df.collect()) == want


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["region_id", "section", "period", "ytd", "period_flow", "prior_year_period_flow"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
