"""Every query with SQL against DuckDB over the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from callweave.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("null" if pd.isna(x) else f"{x:.6f}" if isinstance(x, float) else str(int(x)) if isinstance(x, bool) else str(x) for x in r) for r in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name not in registry.ORACLES:
        assert len(got) > 0
        return
    want = duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want) and len(got) > 0
    numeric = [c for c in got.columns if pd.api.types.is_float_dtype(got[c]) or pd.api.types.is_float_dtype(want[c])]
    for c in numeric:
        got[c], want[c] = got[c].astype(float), want[c].astype(float)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
