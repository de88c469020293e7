"""The way from factors to a portfolio, volume by direction and costs, against plain Python."""

from __future__ import annotations

import datetime as dt
import math
import random
import statistics

import pytest

from tallyforge.operators import market, portfolio, selection

DAY = dt.datetime(2024, 1, 1)
BAR = "instrument string, start timestamp_ntz, open double, high double, low double, close double, volume bigint"
STATEMENT = "instrument string, published timestamp_ntz, statement bigint, shares double, earnings double, equity double"
VALUES = "instrument string, start timestamp_ntz, " + ", ".join(f"{n} double" for n in selection.FACTORS)


def bars(spark, rows):
    return spark.createDataFrame([(i, DAY + dt.timedelta(d), c, c, c, c, v) for i, d, c, v in rows], BAR)


def values(spark, rows):
    return spark.createDataFrame([(i, DAY + dt.timedelta(d), *(f.get(n) for n in selection.FACTORS)) for i, d, f in rows], VALUES)


def test_factors_see_the_last_statement_and_none_of_the_future(spark):
    rows = [("a", d, 10.0 + d, 100) for d in range(5)] + [("b", d, 5.0, 0) for d in range(5)]
    facts = [
        ("a", DAY + dt.timedelta(1), 1, 2.0, 8.0, 4.0),
        ("a", DAY + dt.timedelta(3), 3, 2.0, 9.0, 0.0),
        ("a", DAY + dt.timedelta(3), 2, 2.0, 16.0, 4.0),  # the same instant: statement 3 is the later one
        ("b", DAY, 4, -1.0, 0.0, None),
        (None, DAY, 5, 1.0, 1.0, 1.0),
        ("a", None, 6, 1.0, 1.0, 1.0),
        ("z", DAY, 7, 1.0, 1.0, 1.0),
    ]
    got = {(r.instrument, r.start.day - 1): r for r in selection.factor_values(bars(spark, rows), spark.createDataFrame(facts, STATEMENT), 2).collect()}
    assert len(got) == len(rows)
    assert got["a", 0].value is None and got["a", 0].momentum is None
    assert got["a", 2].value == pytest.approx(8 / 24) and got["a", 2].quality == 2 and got["a", 2].growth is None
    assert got["a", 2].momentum == pytest.approx(0.2) and got["a", 2].liquidity == pytest.approx(1150) and got["a", 2].size == pytest.approx(math.log(24))
    assert got["a", 3].growth == pytest.approx(9 / 16 - 1) and got["a", 3].quality is None
    assert got["b", 4].size is None and got["b", 4].value == 0 and got["b", 4].quality is None
    assert selection.factor_values(bars(spark, []), spark.createDataFrame([], STATEMENT)).isEmpty()


def test_universe_takes_the_most_liquid_of_each_session(spark):
    rows = [("a", 0, {"liquidity": 5.0}), ("b", 0, {"liquidity": 5.0}), ("c", 0, {"liquidity": 9.0}), ("d", 0, {}), ("a", 1, {"liquidity": 1.0})]
    got = {(r.instrument, r.start.day) for r in selection.universe(values(spark, rows), 2).collect()}
    assert got == {("c", 1), ("a", 1), ("a", 2)}


def test_scores_and_choice_are_those_of_plain_python(spark):
    rng, weights = random.Random(5), {"momentum": 1.0, "size": -0.5, "growth": 2.0}
    rows = [(f"i{k:02}", d, {n: None if rng.random() < 0.2 else rng.gauss(0, 1) ** 3 for n in ("momentum", "size")} | {"growth": 7.0}) for d in range(4) for k in range(30)]
    rows += [("i90", 0, {}), ("only", 9, {"momentum": 1.0})]
    expected = {}
    for d in {d for _, d, _ in rows}:
        own = [(i, f) for i, day, f in rows if day == d]
        told = []
        for i, f in own:
            total = size = 0.0
            for n, w in weights.items():
                known = [g[n] for _, g in own if g.get(n) is not None]
                if f.get(n) is not None and min(known) < max(known):
                    total += w * max(-1.5, min(1.5, (f[n] - statistics.fmean(known)) / statistics.pstdev(known)))
                    size += abs(w)
            if size:
                told.append((-round(total / size, 9), i))
        for place, (score, i) in enumerate(sorted(told)[:5], 1):
            expected[d, place] = (i, pytest.approx(-score), 1 / min(5, len(told)))
    z = selection.normalised(values(spark, rows), tuple(weights), clip=1.5)
    got = selection.chosen(selection.scored(z, weights), 5).collect()
    assert {(r.start.day - 1, r.place): (r.instrument, r.score, r.weight) for r in got} == expected
    assert all(r["at"] - r.start == dt.timedelta(1) for r in got)
    with pytest.raises(ValueError):
        selection.scored(z, {"luck": 1.0})


def test_first_of_a_session_are_picked_before_the_shuffle(spark):
    plan = selection.universe(values(spark, []), 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_volume_by_direction(spark):
    rows = [("a", 0, 1.0, 9), ("a", 1, 2.0, 10), ("b", 0, 1.0, 9), ("b", 1, 0.5, 4), ("c", 0, 1.0, 9), ("c", 1, 1.0, 3), ("c", 2, 2.0, None), ("new", 1, 1.0, 50)]
    got = {r.start.day: (r.advancing, r.declining, r.unchanged, r.ratio) for r in market.breadth_by_volume(bars(spark, rows)).collect()}
    assert got == {2: (10, 4, 3, 2.5), 3: (0, 0, 0, None)}


def test_costs_go_off_the_first_session(spark):
    day = lambda d: DAY + dt.timedelta(d)
    weights = spark.createDataFrame([("p", day(0), "a", 1.0), ("p", day(2), "b", 1.0)], "portfolio string, at timestamp_ntz, instrument string, weight double")
    rets = spark.createDataFrame([(i, day(d), 0.1) for i in "ab" for d in range(4)], "instrument string, start timestamp_ntz, ret double")
    got = [r.ret for r in portfolio.curve(weights, rets, cost=0.01).orderBy("start").collect()]
    assert got == pytest.approx([0.09, 0.1, 0.08, 0.1])
