"""Every query against its SQL on the small tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from folio.plans import catalog


def canon(df):
    out = []
    for row in df[sorted(df.columns)].itertuples(index=False):
        cells = []
        for x in row:
            if isinstance(x, list | np.ndarray):
                x = str(list(x))
            elif x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and np.isnan(x)):
                x = "NULL"
            elif isinstance(x, bool | np.bool_):
                x = str(bool(x))
            elif isinstance(x, int | float | np.integer | np.floating):
                x = f"{float(x):.6f}"
            cells.append(str(x))
        out.append("|".join(cells))
    return sorted(out)


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, data, con):
    got = entry.queries()[name](spark, data).toPandas()
    assert len(got)
    if name in catalog.ORACLES:
        want = con.execute(catalog.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canon(got) == canon(want)


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0


def test_core_does_not_need_the_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for f in glob.glob(f"{root}/folio/**/*.py", recursive=True):
        if f"{os.sep}llm{os.sep}" not in f:
            text = open(f).read()
            assert "folio.llm" not in text and "import llm" not in text, f
