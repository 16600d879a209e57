"""Queries of this subpackage with SQL twins against DuckDB."""

import os
import sys

import duckdb
import pandas as pd
import pytest

from callweave.llm import queries

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from test_queries import SF, rows  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twin(spark, name):
    c = duckdb.connect()
    for table in ("documents", "benchmark"):
        c.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want, got = c.execute(queries.ORACLES[name]).df(), queries.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want) > 0
    for name in got.columns:  # a whole number with nulls is a float in one of the two frames
        if pd.api.types.is_numeric_dtype(got[name]) and pd.api.types.is_numeric_dtype(want[name]):
            got[name], want[name] = got[name].astype(float), want[name].astype(float)
    assert rows(got) == rows(want)
