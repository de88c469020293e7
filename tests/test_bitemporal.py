"""What was known when, and ranks within sectors, against plain Python."""

from __future__ import annotations

import datetime as dt
import random
import statistics
from collections import defaultdict

from pyspark.sql import functions as F

from tallyforge.operators import bitemporal, directory, research

DAY = dt.datetime(2024, 1, 1)
ACTION = "instrument string, ex_start timestamp_ntz, known_at timestamp_ntz, version bigint, factor double, withdrawn boolean"


def day(n):
    return DAY + dt.timedelta(n)


ACTIONS = [("a", day(5), day(5), 1, 0.5, False), ("a", day(5), day(8), 2, 0.25, None), ("a", day(7), day(6), 3, 0.8, False), ("a", day(7), day(9), 4, None, True), ("b", day(3), day(20), 5, 0.1, False), ("b", day(2), None, 6, 0.1, False), ("a", day(7), day(30), 7, 0.9, False)]


def test_versions_supersede_each_other_from_when_they_are_known(spark):
    facts = spark.createDataFrame(ACTIONS, ACTION)
    got = bitemporal.known(facts, ["instrument", "ex_start"], ["factor"], [day(4), day(6), day(8), day(10), day(30)]).collect()
    told = defaultdict(dict)
    for r in got:
        told[r.moment][r.instrument, r.ex_start] = r.factor
    assert day(4) not in told
    assert told[day(6)] == {("a", day(5)): 0.5, ("a", day(7)): 0.8}
    assert told[day(8)] == {("a", day(5)): 0.25, ("a", day(7)): 0.8}
    assert told[day(10)] == {("a", day(5)): 0.25}
    assert told[day(30)] == {("a", day(5)): 0.25, ("a", day(7)): 0.9, ("b", day(3)): 0.1}
    assert bitemporal.known(facts.limit(0), ["instrument"], ["factor"], [day(1)]).isEmpty()


def test_bars_are_adjusted_by_what_was_known(spark):
    bars = spark.createDataFrame([(i, day(n), 100.0, "x") for i in "ab" for n in range(12)], "instrument string, start timestamp_ntz, close double, moment_of string")
    got = bitemporal.adjusted_as_known(bars, spark.createDataFrame(ACTIONS, ACTION), [day(6), day(10), day(30)])
    assert got.columns == ["instrument", "start", "close", "moment_of", "moment", "factor", "adjusted_close"]
    close = {(r.moment, r.instrument, r.start): round(r.adjusted_close, 6) for r in got.collect()}
    assert len(close) == 2 * (6 + 10 + 12)
    assert close[day(6), "a", day(4)] == 40.0 and close[day(10), "a", day(4)] == 25.0 and close[day(30), "a", day(4)] == 22.5
    assert close[day(6), "a", day(5)] == 80.0 and close[day(10), "a", day(5)] == 100.0  # an ex-day is not adjusted by its own action
    assert close[day(10), "b", day(1)] == 100.0 and close[day(30), "b", day(1)] == 10.0


def test_the_newest_published_period(spark):
    rows = [("a", 2022, day(1), 1, 5.0, False), ("a", 2023, day(3), 2, 6.0, False), ("a", 2022, day(5), 3, 5.5, False), ("a", 2023, day(7), 4, None, True)]
    made = spark.createDataFrame(rows, "instrument string, period int, known_at timestamp_ntz, version int, value double, withdrawn boolean")
    got = {r.moment: (r.period, r.value) for r in bitemporal.published(made, [day(2), day(6), day(8)], ["value"]).collect()}
    assert got == {day(2): (2022, 5.0), day(6): (2023, 6.0), day(8): (2022, 5.5)}


def test_ranks_and_medians_of_sectors(spark):
    rng = random.Random(6)
    rows = [(k, rng.choice(["x", "x", "x", "y", None]), rng.choice(["p", None]), rng.choice([None, 1.0, 1.0, 1.0, 2.5, -3.0, float(rng.randint(0, 50))])) for k in range(500)] + [(900, "alone", "p", 7.0)]
    df = spark.createDataFrame(rows, "k int, sector string, kind string, v double")
    for ranges in (64, 3):
        got = {r.k: r for r in research.against_sector(df, "v", "sector", "kind", ranges=ranges).collect()}
        groups = defaultdict(list)
        for _, sector, kind, v in rows:
            if v is not None:
                groups[sector, kind].append(v)
        assert len(got) == sum(map(len, groups.values()))
        for k, sector, kind, v in rows:
            if v is not None:
                own = groups[sector, kind]
                share = sum(x < v for x in own) / (len(own) - 1) if len(own) > 1 else 0.0
                assert (got[k].median, got[k].percentile) == (statistics.median(own), share)
    assert research.against_sector(df.filter(F.lit(False)), "v", "sector").isEmpty()


def test_aliases_that_overlap_nest_and_meet(spark):
    rng = random.Random(3)
    ranges = []
    for k in range(300):
        a = rng.randint(0, 120)
        ranges.append((rng.choice(["X", " x", "y", "Z z", None, ""]), rng.randint(1, 40), None if rng.random() < 0.03 else day(a), None if rng.random() < 0.1 else day(a + rng.randint(-2, 30))))
    asked = [(k, rng.choice(["x", "Y ", "z Z", "q", None, " "]), None if rng.random() < 0.05 else day(rng.randint(-5, 160))) for k in range(400)]
    asked += asked[:20]  # repeated mentions stay rows of their own
    aliases = spark.createDataFrame(ranges, "alias string, instrument int, valid_from timestamp_ntz, valid_to timestamp_ntz")
    got = directory.resolved(spark.createDataFrame(asked, "mention int, alias string, at timestamp_ntz").repartition(3), aliases)

    def plain(alias, at):
        key = (alias or "").strip().upper()
        held = [(a, -i) for n, i, a, b in ranges if key and at and a and (n or "").strip().upper() == key and a <= at and (b is None or at < b)]
        return -max(held)[1] if held else None

    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(repr((m, n, at, plain(n, at))) for m, n, at in asked)
    stretches = defaultdict(list)
    for r in directory.holders(aliases).orderBy("key", "begun").collect():
        stretches[r.key].append((r.begun, r.instrument))
    assert all(a[0] < b[0] and a[1] != b[1] for x in stretches.values() for a, b in zip(x, x[1:], strict=False))
