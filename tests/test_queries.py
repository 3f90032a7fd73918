"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import decimal
import math

import duckdb
import pytest

import __spark_entry__
from lexspark.plans import catalog

#: Every query with SQL is compared on the larger tables; those without are run whole on the smaller ones.
SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value) if isinstance(value, decimal.Decimal) else repr(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    found = duck.execute(catalog.ORACLE_SQL[name])
    place = {c[0]: i for i, c in enumerate(found.description)}
    assert sorted(place) == names
    assert got == sorted(tuple(plain(r[place[c]]) for c in names) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    df = catalog.QUERIES[name](spark, SMALL)
    assert len(df.collect()) > 0 and df.columns


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
