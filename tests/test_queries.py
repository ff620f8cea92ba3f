"""Every query against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from sparkloom.plans import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, (np.ndarray, list)):
        return [plain(x) for x in v]
    if isinstance(v, np.generic):
        v = v.item()
    if v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
        return None
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLE:
        assert len(got) > 0
        return
    want = sql.sql(ORACLE[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda f: sorted(repr([plain(x) for x in r]) for r in f[columns].values.tolist())
    assert rows(got) == rows(want)
