"""Extension operators on small planted tables."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import directory, ingest, research
from tallyforge.plans import extension
from tallyforge.plans.catalog import QUERIES

DAY = dt.datetime(2024, 1, 1)
BAR = "instrument string, start timestamp, open double, high double, low double, close double, volume bigint"


def day(n):
    return DAY + dt.timedelta(n)


def bars(spark, *rows):
    return spark.createDataFrame([(i, day(n), c, c, c, c, 1) for i, n, c in rows], BAR)


def test_an_alias_means_what_it_meant_then(spark):
    aliases = spark.createDataFrame([("FPT", 1, day(0), day(5)), (" fpt ", 2, day(5), None), ("FPT.HM", 2, day(0), None), ("X", 4, day(0), None), ("x", 3, day(0), None), (None, 9, day(0), None)], "alias string, instrument int, valid_from timestamp, valid_to timestamp")
    asked = [("a", "fpt", day(4)), ("b", "FPT", day(5)), ("c", "fpt.hm", day(9)), ("d", "FPT", day(-1)), ("e", "x\t", day(1)), ("f", None, day(1)), ("g", " ", day(1))]
    got = directory.resolved(spark.createDataFrame(asked, "mention string, alias string, at timestamp"), aliases)
    assert {r.mention: r.instrument for r in got.collect()} == {"a": 1, "b": 2, "c": 2, "d": None, "e": 3, "f": None, "g": None}


def test_search_orders_what_is_found(spark):
    rows = spark.createDataFrame([("FPT", "FPT Corp"), ("FPTS", "Securities"), ("ABC", "fpt retail"), ("DEF", "The FPT fund"), ("GHI", "50% _other"), (None, None)], "ticker string, name string")
    assert {r.ticker: r.place for r in directory.search(rows, " fpt").collect()} == {"FPT": 0, "FPTS": 1, "ABC": 2, "DEF": 3}
    assert [r.ticker for r in directory.search(rows, "% _").collect()] == ["GHI"]  # no wildcards
    assert directory.search(rows, " \t").isEmpty()


def test_ingest_keeps_the_newest_valid_row_of_a_key(spark):
    rows = [("a", day(0), 1.0, 2.0, 1.0, 2.0, 1, 1), ("a", day(0), 1.0, 2.0, 1.0, 2.0, 1, 2), ("a", day(0), 1.0, 0.5, 1.0, 2.0, 1, 3), (None, day(0), 1.0, 1.0, 1.0, 1.0, 1, 4), ("b", day(0), 1.0, None, 1.0, 1.0, 1, 5)]
    got = ingest.judged(spark.createDataFrame(rows, BAR + ", seq int"), ["instrument", "start"], ["seq"])
    assert {r.seq: r.fault for r in got.collect()} == {1: "duplicate", 2: None, 3: "invalid", 4: "invalid", 5: "invalid"}
    expected = spark.createDataFrame([("a", 2), ("z", 2)], "instrument string, n int")
    scores = {r.instrument: r for r in ingest.quality(got, expected, 98.0, (1, 1, 1, 3)).collect()}
    assert scores["a"].completeness == 50 and scores["a"].validity == pytest.approx(200 / 3) == scores["a"].consistency
    assert (scores["z"].completeness, scores["z"].overall) == (0, 49)


def test_gaps_by_venue(spark):
    rows = bars(spark, ("a", 0, 100.0), ("a", 1, 108.0), ("b", 0, 100.0), ("b", 1, 108.0), ("c", 0, 0.0), ("c", 1, 5.0)).withColumn("venue", F.when(F.col("instrument") == "a", "HOSE").when(F.col("instrument") == "b", "HNX"))
    assert [(r.instrument, r.bound) for r in ingest.beyond_limits(rows).collect()] == [("a", 0.07)]


def test_actions_change_only_what_lies_before_them(spark):
    acts = spark.createDataFrame([("a", day(1), 0.5), ("a", day(3), 0.5), ("z", day(1), 0.1)], "instrument string, ex_start timestamp, factor double")
    got = research.adjusted(bars(spark, ("a", 0, 8.0), ("a", 1, 4.0), ("a", 2, 4.0), ("a", 3, 2.0), ("b", 0, 7.0)), acts)
    assert {(r.instrument, r.start.day): round(r.adjusted_close, 9) for r in got.collect()} == {("a", 1): 2, ("a", 2): 2, ("a", 3): 2, ("a", 4): 2, ("b", 1): 7}
    assert got.columns[:7] == [c.split()[0] for c in BAR.split(", ")]


def test_risk_of_positions(spark):
    held = spark.createDataFrame([("p", "bank", 60.0), ("p", "bank", -20.0), ("p", "tech", 20.0), ("q", None, 0.0)], "book string, sector string, value double")
    got = {(r.book, r.sector): (r.value, r.share, r.concentration) for r in research.exposures(held, "book", "sector").collect()}
    assert got[("p", "bank")] == (40, 0.8, pytest.approx(0.68)) and got[("q", None)] == (0, None, None)
    losses = research.stressed(held, "book", "sector", {"down": {"": -0.1, "bank": -0.15}}).collect()
    assert {r.book: round(r.loss, 9) for r in losses} == {"p": 8, "q": 0}


def test_empty_tables(spark):
    none = bars(spark)
    rets = spark.createDataFrame([], "instrument string, start timestamp, ret double")
    acts = spark.createDataFrame([], "instrument string, ex_start timestamp, factor double")
    for got in (research.adjusted(none, acts), research.factors(none), research.watchlist(none), research.performance(rets, research.market_returns(rets)), ingest.judged(none, ["instrument", "start"], ["volume"])):
        assert got.isEmpty()


def test_no_task_writes_a_part_of_the_stream_that_grows_with_the_table(spark, tmp_path, monkeypatch):
    spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").limit(600).repartition(6).write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(extension.files, "work_folder", lambda s, name: f"{tmp_path}/{name}")
    want = extension._judged(spark, str(tmp_path)).select("order_key", "line", "supplier", "fault").collect()
    assert sorted(map(repr, QUERIES["stream_ingest"](spark, str(tmp_path)).collect())) == sorted(map(repr, want))
    assert len(list((tmp_path / "ingest/inbox").glob("part-*.parquet"))) > 4  # two a go, before
