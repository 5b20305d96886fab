"""Every registered query with SQL against DuckDB on the smallest tables."""

import datetime
import os

import duckdb
import pandas as pd
import pytest

from loomgraph.plans.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v) or v is pd.NaT:
            return None
        if isinstance(v, datetime.datetime) and (v.hour, v.minute, v.second, v.microsecond) == (0, 0, 0, 0):
            return str(v.date())
        if isinstance(v, float):
            return round(v, 9)
        return str(v) if not hasattr(v, "item") else (round(v.item(), 9) if isinstance(v.item(), float) else str(v.item()))

    rows = df[sorted(df.columns)].astype(object).itertuples(index=False)
    return sorted((tuple(str(float(c)) if isinstance(c, float) else c for c in map(cell, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_is_its_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    a, b = plain(got), plain(want)
    try:
        assert a == b
    except AssertionError:  # whole numbers that pandas made floats
        loose = lambda rows: sorted([tuple(None if c is None else c.removesuffix(".0") for c in r) for r in rows], key=str)
        assert loose(a) == loose(b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_have_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
