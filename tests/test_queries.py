"""Every registered query against its DuckDB twin on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from weftgraph.plans.oracle import ORACLE_SQL
from weftgraph.plans.queries import QUERIES

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_each_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_twin(spark, con, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    found = con.execute(ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    expected = sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in found.fetchall())
    assert got == expected


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["node", "ring"] and df.count() > 0
