"""Every query that has SQL gives the rows that DuckDB gives on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry

_SQL = entry.oracle_sql()
_CORE = [n for n in _SQL if not (n.startswith("p") and n[1:2].isdigit())]


def rows(data, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(round(v, 6) if isinstance(v := r[i], float) else v) for i in order) for r in data)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", _CORE)
def test_same_as_sql(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    got = con.execute(_SQL[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(got.fetchall(), columns)


def test_sql_names_are_queries():
    assert set(_SQL) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
