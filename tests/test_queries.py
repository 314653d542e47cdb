"""Every query against its SQL on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from clausework import queries


@pytest.fixture(scope="module")
def views(tiny):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for f in glob.glob(f"{tiny}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, tiny, views, name):
    got, want = queries.QUERIES[name](spark, tiny).toPandas(), views.sql(queries.SQL[name]).df()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    a, b = (x[cols].astype(str).sort_values(cols).reset_index(drop=True) for x in (got, want))
    assert len(a) == len(b)
    assert (a == b).all().all()


def test_entry_is_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())
