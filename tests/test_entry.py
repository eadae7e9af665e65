import math
from datetime import date, datetime
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from pagewarden.plans.views import TABLES


def test_contract(spark):
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries)
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "n_card", "n_email", "n_phone", "masked"] and df.count() > 0


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, (str, date, datetime)):
        return v
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracle_agrees(spark, sf, duck, name):
    got = entry.queries()[name](spark, sf)
    want = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    order = sorted(names)
    assert sorted(got.columns) == order
    rows = sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=repr)
    assert rows == sorted((tuple(plain(dict(zip(names, r))[c]) for c in order) for r in want.fetchall()), key=repr)
