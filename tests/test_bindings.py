"""Each query over the small tables against DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from tidemill.plans import catalogue

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_rows_as_sql(spark, name):
    for path in glob.glob(f"{SF}/*.parquet"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got = catalogue.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    mine = sorted((tuple(map(str, r)) for r in got.select(cols).collect()))
    theirs = sorted(tuple(map(str, r)) for r in duckdb.sql(f"SELECT {', '.join(cols)} FROM ({catalogue.ORACLES[name]})").fetchall())
    assert mine == theirs
