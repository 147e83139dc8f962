"""Queries of the training-data operators against their DuckDB twins on the smallest tables."""

import glob
import os

import duckdb
import pytest

from weftgraph.llm.queries import ORACLE_SQL, QUERIES

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_twin(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    found = con.execute(ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    got = sorted(tuple(r[c] for c in columns) for r in df.collect())
    assert got == sorted(tuple(r[names.index(c)] for c in columns) for r in found.fetchall())
