"""The subpackage's queries over the smallest data; SQL where there is some."""

import glob
import os

import pytest

from lakeassay.llm import queries

COLUMNS = {"p6_found": ["doc_id", "item_id"], "p7_found": ["mix_id", "source"], "p8_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    assert df.columns == COLUMNS.get(name, df.columns)
    assert df.count() > 0


def test_targets_against_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(sf + "/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    for name, sql in queries.ORACLES.items():
        assert sorted(map(tuple, queries.QUERIES[name](spark, sf).collect())) == sorted(con.execute(sql).fetchall())
