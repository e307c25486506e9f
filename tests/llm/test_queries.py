"""Every corpus query with SQL against it on the smallest tables."""

import os

import duckdb
import pytest

from stressline.llm import registry


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in os.listdir(sf):
        c.sql(f"create view {t.split('.')[0]} as from '{sf}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf, duck, name):
    got, want = registry.queries()[name](spark, sf).toArrow(), duck.sql(registry.oracle_sql()[name]).to_arrow_table()
    cols = sorted(got.column_names)
    assert cols == sorted(want.column_names)
    rows = lambda t: sorted(map(str, zip(*(t[c].to_pylist() for c in cols), strict=True)))
    assert rows(got) == rows(want)


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 14))
