"""The entry contract, with and without the optional parts: every query with SQL equals it on the smallest tables."""

from __future__ import annotations

from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    """One form of what two engines give: decimals as doubles, doubles to nine digits."""
    value = float(value) if isinstance(value, Decimal) else value
    return float(f"{value:.9g}") if isinstance(value, float) else value


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(isinstance(q, str) for q in entry.oracle_sql().values())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, tables, name):
    df = entry.queries()[name](spark, SF)
    want = tables.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    got = sorted(repr(tuple(plain(r[x]) for x in columns)) for r in df.collect())
    assert got == sorted(repr(tuple(map(plain, r))) for r in want.fetchall())
