"""Queries against their SQL over the smallest data."""

import glob
import math
import os
from collections import Counter
from decimal import Decimal

import pytest

from lakeassay.plans import catalog


@pytest.fixture(scope="module")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(sf + "/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    got = Counter(repr(tuple(map(plain, r))) for r in df.collect())
    found = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    want = Counter(repr(tuple(plain(r[i]) for i in order)) for r in found.fetchall())
    assert got == want


def test_entry(spark, sf):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
