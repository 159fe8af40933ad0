"""Every catalogue query against its own SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from touchline.plans import catalog

from .conftest import SF

QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()
#: Two hundred feature rows a competition are needed, which the smallest tables lack; test_backtest runs them with smaller bounds.
LARGE = {n for n in QUERIES if n.startswith("walk_forward")} | {"logistic_coefficients", "logistic_1x2"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return v if v is None or isinstance(v, (int, bool)) else str(v)[:19]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - LARGE))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    if name not in ORACLE:
        assert mine
        return
    got = duck.sql(ORACLE[name])
    assert sorted(got.columns) == cols
    at = [got.columns.index(c) for c in cols]
    assert mine == sorted(repr([plain(r[i]) for i in at]) for r in got.fetchall())
