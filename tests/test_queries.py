"""Every registered query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
SLOW = {"hocr_ingest"}  # run by test_layout's round trip


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for k in df.columns:
        df[k] = df[k].astype(float) if df[k].dtype.kind in "iufb" else df[k].map(lambda x: "" if x is None or x is pd.NA or x != x else str(float(x)) if not isinstance(x, str) else x)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - SLOW))
def test_query(spark, duck, name):
    got, want = plain(entry.queries()[name](spark, DATA).toPandas()), plain(duck.sql(entry.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    for k in got.columns:
        same = np.isclose(got[k], want[k], equal_nan=True) if got[k].dtype.kind == "f" and want[k].dtype.kind == "f" else got[k] == want[k]
        assert same.all(), k


def test_entry(spark):
    assert entry.entry(spark).columns == ["page_id", "dominant_deg", "fraction", "adjust_deg"]
