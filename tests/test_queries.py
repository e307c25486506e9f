"""Every core query with SQL against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from stressline.plans import queries as Q

@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in os.listdir(sf):
        c.sql(f"create view {t.split('.')[0]} as from '{sf}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    got, want = Q.QUERIES[name](spark, sf).toPandas(), duck.sql(Q.ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got) == len(want)
    text = lambda df: sorted(df[cols].map(lambda v: "-" if v is None or v != v else f"{float(v) + 0.0:.5f}" if isinstance(v, (int, float)) else str(v)[:10]).agg("|".join, axis=1))
    assert text(got) == text(want)
