"""Every registered bar and ledger query against DuckDB on the small tables."""

import datetime
import math

import duckdb
import pytest

from barloom.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows, columns):
    order = sorted(columns)

    def one(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v + 0.0:.5g}"
        return str(v if not isinstance(v, datetime.datetime) else v.replace(tzinfo=None))

    at = [columns.index(c) for c in order]
    return sorted(tuple(one(r[i]) for i in at) for r in rows)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    cur = duck.execute(SQL[name])
    columns = [c[0] for c in cur.description]
    want = cur.fetchall()
    assert sorted(columns) == sorted(df.columns) and len(got) == len(want)
    assert plain(got, df.columns) == plain(want, columns)
