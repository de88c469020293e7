"""Lots, the funnel and the provider adapter against plain Python."""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict, deque

import pyarrow as pa
import pytest
from pyarrow import parquet
from pyspark.sql import functions as F

from tallyforge.operators import portfolio
from tallyforge.operators.running import running
from tallyforge.sources import provider

DAY = dt.datetime(2024, 1, 1)
TRADE = "instrument string, at timestamp, trade bigint, side int, quantity bigint, price bigint"
BAR = "instrument string, start timestamp_ntz, open double, high double, low double, close double, volume bigint"


def made_trades(seed=4):
    rng = random.Random(seed)
    rows = [(rng.choice("abc"), DAY + dt.timedelta(rng.randint(0, 200)), k, rng.choice([1, -1]), rng.randint(1, 40), rng.randint(1, 900)) for k in range(300)]
    rows += [("long", DAY, 1000, 1, 5, 10), ("long", DAY, 1001, 1, 5, 20), ("short", DAY, 1002, -1, 3, 7), ("short", DAY + dt.timedelta(1), 1003, -1, 1, 9)]
    return rows


def fifo(rows):
    """Trade by trade: a queue of open units for each instrument."""
    queue, realised, mark = defaultdict(deque), defaultdict(int), {}
    for i, _, _, side, quantity, price in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        open_ = queue[i]
        mark[i] = price
        while quantity and open_ and open_[0][0] == -side:
            _, left, was = open_.popleft()
            q = min(left, quantity)
            realised[i] += q * (price - was) * -side
            quantity -= q
            if left > q:
                open_.appendleft((-side, left - q, was))
        if quantity:
            open_.append((side, quantity, price))
    return {i: (realised[i], sum(s * q * (mark[i] - p) for s, q, p in x), sum(s * q for s, q, _ in x)) for i, x in queue.items()}


@pytest.mark.parametrize("width", [portfolio.WIDTH, 7])
def test_profit_is_that_of_first_in_first_out(spark, width):
    rows = made_trades()
    bad = [(None, DAY, 1, 1, 1, 1), ("a", DAY, 9999, 1, 0, 5), ("a", DAY, 9998, 0, 5, 5), ("a", DAY, 9997, 1, None, 5)]
    got = portfolio.profit(spark.createDataFrame(rows + bad, TRADE).repartition(3), width=width).collect()
    assert {r.instrument: (r.realised, r.unrealised, r.open_quantity) for r in got} == fifo(rows)
    assert all(r.total == r.realised + r.unrealised for r in got)
    assert portfolio.profit(spark.createDataFrame([], TRADE)).isEmpty()


@pytest.mark.parametrize("most", [0, 104])
def test_large_instruments_are_summed_in_pieces(spark, most):
    got = portfolio.profit(spark.createDataFrame(made_trades(), TRADE).repartition(3), width=7, most=most).collect()
    assert {r.instrument: (r.realised, r.unrealised, r.open_quantity) for r in got} == fifo(made_trades())


def test_lots_are_one_shuffle(spark):
    plan = portfolio.matched_lots(spark.createDataFrame(made_trades(), TRADE))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_lots_keep_every_unit(spark):
    rows = made_trades(8)
    lots = portfolio.matched_lots(spark.createDataFrame(rows, TRADE), width=16).collect()
    for side, name in ((1, "bought"), (-1, "sold")):
        units = defaultdict(int)
        for r in lots:
            if r[name] is not None:
                units[r.instrument, r[name]] += r.quantity
        want = defaultdict(int)
        for i, _, _, s, q, p in rows:
            if s == side:
                want[i, p] += q
        assert units == want


def test_running_totals(spark):
    rows = [(g, k, k * k % 7) for g in ("x", "y") for k in range(40)]
    df = spark.createDataFrame(rows, "g string, k int, v int")
    for back in (False, True):
        for own in (False, True):
            got = running(df, ["g"], F.floor(F.col("k") / 6), ["k"], {"s": ("sum", F.col("v")), "low": ("min", F.col("v")), "high": ("max", F.col("v"))}, back=back, own=own)
            for r in got.collect():
                part = [v for g, k, v in rows if g == r.g and (k > r.k if back else k < r.k or (own and k == r.k)) or (own and back and g == r.g and k == r.k)]
                assert (r.s, r.low, r.high) == ((sum(part), min(part), max(part)) if part else (None, None, None))


def test_the_funnel_does_not_look_ahead(spark):
    rng = random.Random(2)
    days = [(i, DAY + dt.timedelta(k), *[float(x) for x in (rng.randint(5, 9), 12, 3, rng.randint(5, 9))], 1) for i in "ab" for k in range(100) if rng.random() < 0.8]
    frame = spark.createDataFrame(days, BAR)
    got = {(r.instrument, r.start): r for r in portfolio.funnel(frame, best=1).collect()}
    cut = DAY + dt.timedelta(70)
    # What comes later changes nothing of what was said before.
    before = {(r.instrument, r.start): r for r in portfolio.funnel(frame.filter(F.col("start") <= F.lit(cut)), best=1).collect()}
    week = cut - dt.timedelta(cut.weekday())
    assert before and all(got[k] == r for k, r in before.items() if r.start < week)
    for r in got.values():
        assert r.week_start + dt.timedelta(7) <= r.start + dt.timedelta(1)
        end = (r.month_start.replace(day=28) + dt.timedelta(4)).replace(day=1)
        assert end <= r.week_start + dt.timedelta(7)
        own = [d for d in days if d[0] == r.instrument and r.month_start <= d[1] < end]
        assert r.month_up == (own[-1][5] > own[0][2])
    assert all(r.chosen == (r.month_up and r.week_place <= 1 and r.entry) for r in got.values())
    assert portfolio.funnel(spark.createDataFrame([], BAR)).isEmpty()


def test_rolled_up_bars_are_those_of_all_ticks(spark):
    days = spark.createDataFrame([("a", DAY + dt.timedelta(k), float(k), k + 2.0, k - 1.0, k + 1.0, k) for k in range(20)], BAR)
    got = sorted(tuple(r) for r in portfolio.rolled_up(days, "week").collect())
    assert got[0] == ("a", DAY, 0.0, 8.0, -1.0, 7.0, 21) and len(got) == 3


@pytest.fixture(scope="module")
def lines(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lines") / "lineitem.parquet")
    n = 40
    parquet.write_table(pa.table({"l_orderkey": list(range(n)), "l_linenumber": [1] * n, "l_partkey": [k % 3 for k in range(n)], "l_quantity": [2.0] * n, "l_extendedprice": [10.0 + k for k in range(n)], "l_discount": [0.09 if k % 10 == 0 else 0.0 for k in range(n)], "l_shipdate": [DAY + dt.timedelta(k) for k in range(n)]}), path, row_group_size=10)
    return path


def test_provider_rows_and_errors(spark, lines):
    provider.register(spark)
    rows = spark.read.format("bars").options(provider="order_lines", location=lines).load()
    got = {r.reference: r for r in rows.collect()}
    assert len(got) == 40 and rows.rdd.getNumPartitions() == 4
    assert got["3-1"].open == 6.5 and got["3-1"].volume == 2 and got["3-1"].error is None and got["3-1"].payload is None
    assert got["10-1"].high is None and got["10-1"].error == "high" and "n/a" in got["10-1"].payload and got["10-1"].close == 10.0


def test_provider_reads_only_pages_in_bounds(spark, lines):
    provider.register(spark)
    rows = spark.read.format("bars").options(provider="order_lines", location=lines).load()
    asked = rows.filter(f"start >= TIMESTAMP_NTZ '{DAY + dt.timedelta(12)}' AND start < TIMESTAMP_NTZ '{DAY + dt.timedelta(18)}'")
    assert asked.count() == 6 and asked.rdd.getNumPartitions() == 1
    assert rows.filter(f"start > TIMESTAMP_NTZ '{DAY + dt.timedelta(500)}'").count() == 0
    with pytest.raises(Exception, match="one of the providers"):
        spark.read.format("bars").options(provider="nobody", location=lines).load().count()


def test_text_that_is_no_number():
    made = provider.bars_of(pa.RecordBatch.from_pydict({n: pa.array(["1", "x", None]) for n in ("instrument", "open", "high", "low", "close", "volume")} | {"start": pa.array(["2024-01-01 00:00:00", "never", None]), "reference": pa.array(["r1", "r2", None])}))
    assert made.column("error").to_pylist() == [None, "close,high,instrument,low,open,start,volume", None]
    assert made.column("open").to_pylist() == [1.0, None, None] and made.column("payload").to_pylist()[0::2] == [None, None]


def test_curves_fill_sparse_rebalancings(spark):
    rng = random.Random(7)
    weights = [(p, DAY + dt.timedelta(k), i, rng.choice([0.2, -0.1, 0.4])) for p in "pq" for k in (0, 3, 4, 11) for i in "abcd" if rng.random() < 0.6]
    weights += [("p", DAY, "a", 0.1), (None, DAY, "a", 1.0), ("q", DAY + dt.timedelta(99), "a", 1.0)]
    rets = [(i, DAY + dt.timedelta(k), rng.uniform(-0.2, 0.2)) for i in "abce" for k in range(-2, 20) if k != 7 and rng.random() < 0.9]
    rets += [("d", DAY + dt.timedelta(12), -9.0)]
    w = spark.createDataFrame(weights, "portfolio string, at timestamp_ntz, instrument string, weight double")
    r = spark.createDataFrame(rets, "instrument string, start timestamp_ntz, ret double")
    got = {(x.portfolio, x.start): x for x in portfolio.curve(w, r).collect()}
    of = defaultdict(lambda: defaultdict(float))
    for p, at, i, x in weights:
        if p:
            of[p, at][i] += x
    earned = {(i, d): x for i, d, x in rets}
    sessions = sorted({d for _, d, _ in rets})
    want = {}
    for p in "pq":
        times = sorted(at for q, at in of if q == p)
        value, peak, last = 1.0, 1.0, None
        for d in sessions:
            now = max((t for t in times if t <= d), default=None)
            if now is None:
                continue
            held = of[p, now]
            moved = 0.0
            if now != last:
                before = of[p, times[times.index(now) - 1]] if times.index(now) else {}
                moved = sum(abs(held.get(i, 0) - before.get(i, 0)) for i in {*held, *before})
            last = now
            gain = sum(x * earned.get((i, d), 0.0) for i, x in held.items())
            value = 0.0 if gain <= -1 else value * (1 + gain)
            peak = max(peak, value)
            want[p, d] = (sum(map(abs, held.values())), moved, gain, value, value / peak - 1)
    assert got.keys() == want.keys()
    for k, x in want.items():
        assert (got[k].exposure, got[k].turnover, got[k].ret, got[k].value, got[k].drawdown) == pytest.approx(x, abs=1e-9)
    assert portfolio.curve(w.limit(0), r).isEmpty() and portfolio.curve(w, r.limit(0)).isEmpty()


def test_calmar(spark):
    rows = [("p", DAY + dt.timedelta(k), v, d) for k, v, d in ((0, 1.0, 0.0), (100, 0.8, -0.2), (365, 1.1, 0.0))] + [("q", DAY, 1.0, 0.0)]
    got = {r.portfolio: r.calmar for r in portfolio.calmar(spark.createDataFrame(rows, "portfolio string, start timestamp_ntz, value double, drawdown double")).collect()}
    assert got == {"p": pytest.approx(0.5), "q": None}


def test_limits_say_no(spark):
    held = spark.createDataFrame([("p", DAY, "a", "s", 0.5), ("p", DAY, "a", "s", 0.1), ("p", DAY, "b", "s", -0.4), ("p", DAY, "c", "t", -0.7)], "portfolio string, start timestamp_ntz, instrument string, sector string, weight double")
    curves = spark.createDataFrame([("p", DAY, 1.5, -0.1, 0.0), ("p", DAY + dt.timedelta(1), 1.5, -0.3, -0.2), ("q", DAY, None, 0.0, 0.0)], "portfolio string, start timestamp_ntz, exposure double, drawdown double, ret double")
    made = portfolio.limits(held, curves, {"position": 0.7, "sector": 0.6, "leverage": 1.5, "drawdown": -0.2, "daily_loss": -0.2})
    got = {(r.portfolio, (r.start - DAY).days, r["limit"]): (r.value, r.may_proceed) for r in made.collect()}
    assert got["p", 0, "position"] == (0.7, True) and got["p", 0, "sector"] == (pytest.approx(0.7), False) and got["p", 0, "leverage"] == (1.5, True)
    assert got["p", 1, "position"] == (0.0, True) and got["p", 1, "drawdown"] == (-0.3, False) and got["p", 1, "daily_loss"] == (-0.2, True)
    assert got["q", 0, "leverage"] == (None, False)
    asked = spark.createDataFrame([("p", DAY + dt.timedelta(hours=5), 1), ("p", DAY + dt.timedelta(1, 60), 2), ("q", DAY + dt.timedelta(3), 3), ("r", DAY, 4)], "portfolio string, at timestamp_ntz, n int")
    assert {r.n: r.may_proceed for r in portfolio.orders_that_may_proceed(asked, made).collect()} == {1: True, 2: False, 3: False, 4: True}
    with pytest.raises(ValueError, match="no such limits"):
        portfolio.limits(held, curves, {"luck": 1.0})
