"""The p queries run over the smallest tables; those with SQL give DuckDB's rows."""

from __future__ import annotations

import os

import duckdb
import pytest

from casemill.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    got = queries.QUERIES[name](spark, sf)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.SQL[name]})").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


COLUMNS = {
    "p1_found": "segment_id bigint, part_name string, line_no int, defect string", "p3_found": "record_id bigint, field_name string, pos int, entry_id int", "p4_found": "spelling_a string, spelling_b string",
    "p5_found": "field_name string, record_a bigint, record_b bigint", "p6_found": "segment_id bigint", "p10_found": "doc_id bigint, reading_band int",
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs_with_distinct_rows(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    if name in COLUMNS:
        assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == COLUMNS[name]
    rows = df.collect()
    assert rows
    if name.endswith("_found"):
        assert len(set(rows)) == len(rows)
