"""Every registered query against its SQL in DuckDB."""

import glob
import os

import __spark_entry__ as entry
import duckdb
import pytest
from loomlog.plans.queries import ORACLE_SQL, QUERIES

from tests.conftest import rows


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(want.columns)
    at = [want.columns.index(c) for c in order]
    text = lambda v: "NULL" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
    assert rows(got) == sorted(tuple(text(r[i]) for i in at) for r in want.fetchall())


def test_entry(spark):
    got = entry.entry(spark)
    assert got.count() > 0 and set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())
