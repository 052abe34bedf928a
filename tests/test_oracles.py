"""Every registered query against its SQL twin on the smallest data set."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry_points
from check import TABLES, compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry_points.queries()))
def test_query_matches_sql(spark, tables, name):
    fn, sql = entry_points.queries()[name], entry_points.oracle_sql().get(name)
    text, _ = compare(spark, tables, name, fn, sql, SF)
    assert text.startswith(("ok", "rows")), text


def test_entry(spark):
    rows = entry_points.entry(spark)
    assert rows.count() > 0 and "final_class" in rows.columns
