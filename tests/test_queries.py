"""Every registered query against its SQL twin on the smallest test tables."""

import os

import pytest

import __spark_entry__ as entry_points
from tidemark.workloads import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def normal(df):
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, duck, name):
    got = normal(QUERIES[name](spark, SF_DIR).toPandas())
    want = normal(duck.sql(ORACLES[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got:
        same = (got[c] == want[c]) | (got[c].isna() & want[c].isna())
        assert same.all(), (c, got[c][~same].head().tolist(), want[c][~same].head().tolist())


def test_entry(spark):
    assert {r["event_type"] for r in entry_points.entry(spark).collect()} == {"click", "purchase", "signup", "view"}
