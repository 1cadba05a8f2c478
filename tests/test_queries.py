"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from weftline.plans import registry
from weftline.sources.corpora import TABLES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def cells(df: pd.DataFrame):
    empty = lambda v: v is None or v is pd.NA or v is pd.NaT or v != v
    cell = lambda v: "~" if empty(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    cols = sorted(df.columns)
    return cols, sorted(tuple(map(cell, r)) for r in df[cols].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DIR).toPandas()
    assert len(got)
    if name in registry.SQL:
        assert cells(duck.sql(registry.SQL[name]).df()) == cells(got)
