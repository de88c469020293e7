"""Every query of the catalog against its SQL in DuckDB, and market analytics on small planted tables."""

from __future__ import annotations

import datetime as dt
import os

import duckdb
import pandas as pd
import pytest

from tallyforge.operators import market
from tallyforge.plans import catalog, extension  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(frame):
    def text(v):
        if v is None or (not isinstance(v, list | dict) and pd.isna(v)):
            return "null"
        return f"{v:.6f}" if isinstance(v, float) else str(v).removesuffix(" 00:00:00")

    cols = sorted(frame.columns)
    return cols, sorted(tuple(map(text, r)) for r in frame[cols].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, duck, name):
    assert plain(catalog.QUERIES[name](spark, DATA).toPandas()) == plain(duck.execute(catalog.SQL[name]).df())


DAY = dt.datetime(2024, 1, 1)


def bars(spark, *rows):
    return spark.createDataFrame([(i, DAY + dt.timedelta(d), float(o), float(h), float(lo), float(c), v) for i, d, o, h, lo, c, v in rows], "instrument string, start timestamp, open double, high double, low double, close double, volume bigint")


def test_planted_bars(spark):
    b = bars(spark, ("a", 0, 10, 12, 9, 11, 5), ("a", 1, 20, 21, 19, 20, 5), ("a", 3, 20, 19, 18, 18, 1), ("b", 0, 1, 1, 0, 1, 1), ("b", 2, 1, 1, 1, 1, -1), ("b", 3, 1, 1, 1, 1, 1))
    assert {(r.instrument, r.start.day) for r in market.insane(b).collect()} == {("a", 4), ("b", 1), ("b", 3)}
    assert [(r.instrument, r.start.day) for r in market.overnight_gaps(b).collect()] == [("a", 2)]
    assert {(r.instrument, r.start.day) for r in market.missing_sessions(b).collect()} == {("a", 3), ("b", 2)}
    assert market.bars(spark.createDataFrame([], "instrument string, ts timestamp, tick_id int, price double")).isEmpty()


def test_as_of_takes_the_last_at_or_before(spark):
    at = lambda h: DAY + dt.timedelta(hours=h)
    left = spark.createDataFrame([("a", at(1), 1), ("a", at(5), 2), ("b", at(5), 3)], "k string, ts timestamp, n int")
    right = spark.createDataFrame([("a", at(2), 1, 10.0), ("a", at(5), 2, 20.0), ("a", at(5), 3, 30.0), ("a", at(6), 4, 40.0)], "k string, ts timestamp, rid int, v double")
    assert {r.n: r.v for r in market.as_of(left, right, "k", "ts", ["v"], "rid").collect()} == {1: None, 2: 30.0, 3: None}
