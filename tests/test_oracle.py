"""Every core query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidemark.plans import extra, more, prep, profile, scores, series, training_core

ROOT = "/root/testdata/sf0.001"
MODULES = (training_core, prep, series, profile, scores, extra, more)
SQL = {n: s for m in MODULES for n, s in m.ORACLE.items()}
NAMES = [(m, n) for m in MODULES for n in m.QUERIES if n in SQL]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{ROOT}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, float, np.number)):  # a column of whole numbers with nulls may come as floats
        return round(float(v), 5) + 0.0
    return str(v)[:10] if hasattr(v, "year") else v


def rows(df):
    return sorted(tuple(map(repr, map(plain, r))) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize(("module", "name"), NAMES, ids=[n for _, n in NAMES])
def test_same_rows(spark, duck, module, name):
    got, want = module.QUERIES[name](spark, ROOT).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
