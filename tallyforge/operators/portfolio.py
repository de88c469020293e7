"""Profit by lots, the funnel over several timeframes, and curves of portfolios (an extension with definitions of our own).

Trades: (instrument, at, trade, side, quantity, price) with side 1 for a purchase and -1 for a sale, whole quantities above
0, and prices in the smallest unit of money as whole numbers. Bars: (instrument, start, open, high, low, close, volume).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.market import as_of
from tallyforge.operators.running import running

#: Units of an instrument's running quantity that make a piece.
WIDTH = 1 << 16
#: Trades of an instrument that one task may order at once; those of a larger one are summed in pieces.
MOST = 1_000_000


def _cuts(known: DataFrame) -> DataFrame:
    """The lots of instruments that fit a task each: one shuffle by instrument, which every window then keeps to."""
    rows = known.repartition("instrument")
    ends = rows.withColumn("upto", F.sum("quantity").over(Window.partitionBy("instrument", "side").orderBy("at", "trade").rowsBetween(Window.unboundedPreceding, 0)))
    price = lambda side: F.max(F.when(F.col("side") == side, F.struct("upto", "price")))
    points = ends.groupBy("instrument", "upto").agg(price(1).alias("buy"), price(-1).alias("sell"))
    up = Window.partitionBy("instrument").orderBy("upto")
    # The highest units first: the last purchase seen is the first one that ends there or later.
    down = Window.partitionBy("instrument").orderBy(F.desc("upto")).rowsBetween(Window.unboundedPreceding, 0)
    cover = points.withColumns({"bought": F.min("buy").over(down), "sold": F.min("sell").over(down)})
    return cover.withColumn("since", F.lag("upto").over(up)).select("instrument", "upto", "bought", "sold", "since")


def _pieced(known: DataFrame, width: int) -> DataFrame:
    """The same of instruments of any size, in pieces."""
    ends = running(known, ["instrument", "side"], F.date_trunc("month", "at"), ["at", "trade"], {"upto": ("sum", F.col("quantity"))})
    price = lambda side: F.max(F.when(F.col("side") == side, F.struct("upto", "price")))
    points = ends.groupBy("instrument", "upto").agg(price(1).alias("buy"), price(-1).alias("sell"))
    piece = F.floor((F.col("upto") - 1) / width)
    # The purchase and the sale that hold the units under a point are the first ones that end there or later.
    cover = running(points, ["instrument"], piece, ["upto"], {"bought": ("min", F.col("buy")), "sold": ("min", F.col("sell"))}, back=True)
    return running(cover, ["instrument"], piece, ["upto"], {"since": ("max", F.col("upto"))}, own=False).select("instrument", "upto", "bought", "sold", "since")


def matched_lots(trades: DataFrame, *, width: int = WIDTH, most: int = MOST) -> DataFrame:
    """(instrument, quantity, bought, sold): units that went in at one price and out at another, first in, first out.

    Lined up in order of (at, trade), the purchases of an instrument are intervals of its running purchased quantity and the
    sales are intervals of its running sold one; where two overlap, so many units of the one met the other. A unit that was
    sold first and bought later is matched alike. Units that were never sold have no `sold`, units sold short and not bought
    back have no `bought`. Trades with a null or without a quantity above 0 are left out.
    """
    known = trades.dropna(subset=["instrument", "at", "trade", "side", "quantity", "price"]).filter("quantity > 0 AND side IN (1, -1)")
    large = known.groupBy("instrument").count().filter(F.col("count") > most).select("instrument")
    if large.isEmpty():
        cuts = _cuts(known)
    else:  # broadcast: at most one for each `most` rows
        cuts = _cuts(known.join(F.broadcast(large), "instrument", "left_anti")).unionByName(_pieced(known.join(F.broadcast(large), "instrument", "left_semi"), width))
    return cuts.select("instrument", (F.col("upto") - F.coalesce("since", F.lit(0))).alias("quantity"), F.col("bought.price").alias("bought"), F.col("sold.price").alias("sold"))


def profit(trades: DataFrame, *, width: int = WIDTH, most: int = MOST) -> DataFrame:
    """(instrument, realised, unrealised, total, open_quantity): open units are valued at the instrument's last price; a
    negative open quantity is sold short."""
    last = trades.dropna(subset=["instrument", "at", "trade", "price"]).groupBy("instrument").agg(F.max_by("price", F.struct("at", "trade")).alias("mark"))
    lots = matched_lots(trades, width=width, most=most).join(last, "instrument")
    q, gain = F.col("quantity"), F.coalesce("sold", "mark") - F.coalesce("bought", "mark")
    open_ = F.col("sold").isNull() | F.col("bought").isNull()
    held = F.when(F.col("sold").isNull(), q).when(F.col("bought").isNull(), -q).otherwise(0)
    sums = lots.groupBy("instrument").agg(F.sum(F.when(~open_, q * gain).otherwise(0)).alias("realised"), F.sum(F.when(open_, q * gain).otherwise(0)).alias("unrealised"), F.sum(held).alias("open_quantity"))
    return sums.select("instrument", "realised", "unrealised", (F.col("realised") + F.col("unrealised")).alias("total"), "open_quantity")


def rolled_up(bars: DataFrame, unit: str) -> DataFrame:
    """Bars of a coarser calendar unit from finer ones (of one that nests in it: days in weeks or months)."""
    start = F.date_trunc(unit, "start").cast(bars.schema["start"].dataType)
    return bars.groupBy("instrument", start.alias("begun")).agg(F.min_by("open", "start").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "start").alias("close"), F.sum("volume").alias("volume")).withColumnRenamed("begun", "start")


def funnel(days: DataFrame, *, best: int = 10) -> DataFrame:
    """(instrument, start, close, week_start, week_place, month_start, month_up, entry, chosen) of daily bars that have a
    completed week and a completed month before.

    A day sees the last week that ended by the day's end, and that week the last month that ended by its end: nothing looks
    ahead. month_up: the month closed above its open. week_place: the place of the week's gain among all instruments' gains
    of that week. entry: the day closed above the instrument's day before. chosen: all three, with a place of `best` or less.
    """
    ended = lambda unit: F.expr(f"start + INTERVAL '1' {unit}").cast(days.schema["start"].dataType)
    months = rolled_up(days, "month").select("instrument", ended("MONTH").alias("at"), F.col("start").alias("month_start"), (F.col("close") > F.col("open")).alias("month_up"))
    gains = rolled_up(days, "week").withColumn("gain", F.col("close") / F.nullif(F.col("open"), F.lit(0.0)))
    place = F.rank().over(Window.partitionBy("start").orderBy(F.desc_nulls_last("gain")))
    weeks = gains.select("instrument", F.expr("start + INTERVAL '7' DAY").cast(days.schema["start"].dataType).alias("at"), F.col("start").alias("week_start"), place.alias("week_place"))
    weeks = as_of(weeks, months, "instrument", "at", ["month_start", "month_up"], "month_start")
    before = F.lag("close").over(Window.partitionBy("instrument").orderBy("start"))
    seen = days.select("instrument", ended("DAY").alias("at"), "start", "close", F.coalesce(F.col("close") > before, F.lit(False)).alias("entry"))
    rows = as_of(seen, weeks, "instrument", "at", ["week_start", "week_place", "month_start", "month_up"], "week_start")
    chosen = F.col("month_up") & (F.col("week_place") <= best) & F.col("entry")
    return rows.filter("month_start IS NOT NULL").select("instrument", "start", "close", "week_start", "week_place", "month_start", "month_up", "entry", chosen.alias("chosen"))


def _changes(weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Weights by (portfolio, at, instrument), and (portfolio, at, prior): rebalancings and the one before each."""
    own = weights.dropna(subset=["portfolio", "at", "instrument", "weight"]).groupBy("portfolio", "at", "instrument").agg(F.sum("weight").alias("weight"))
    times = own.select("portfolio", "at").distinct()
    return own, times.withColumn("prior", F.lag("at").over(Window.partitionBy("portfolio").orderBy("at")))


def turnover(weights: DataFrame) -> DataFrame:
    """(portfolio, at, turnover): at each rebalancing, the sum of what weights change by, those of instruments that come or
    go included."""
    own, times = _changes(weights)
    new = own.select("portfolio", "at", "instrument", "weight")
    old = times.filter("prior IS NOT NULL").join(own.withColumnRenamed("at", "prior"), ["portfolio", "prior"]).select("portfolio", "at", "instrument", F.col("weight").alias("before"))
    both = new.join(old, ["portfolio", "at", "instrument"], "full_outer")
    change = F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("before", F.lit(0.0)))
    return both.groupBy("portfolio", "at").agg(F.sum(change).alias("turnover"))


def curve(weights: DataFrame, rets: DataFrame, *, cost: float = 0.0) -> DataFrame:
    """(portfolio, start, exposure, turnover, ret, value, drawdown) of each portfolio and session from its first rebalancing on.

    weights: (portfolio, at, instrument, weight), all of a portfolio's holdings at each rebalancing; they hold from the
    session of `at` on until the next one. rets: (instrument, start, ret); a holding without one earns nothing that day. The
    value starts at 1 and compounds; `cost` of the turnover goes off the return of a rebalancing's first session; a day that loses all or more leaves 0 from then on.
    """
    own, times = _changes(weights)
    sessions = rets.select("start").distinct()
    spans = times.select("portfolio", "at", F.lead("at").over(Window.partitionBy("portfolio").orderBy("at")).alias("until"))
    # Days meet a portfolio's rebalancings in one sorted pass, by `as_of`.
    first = times.groupBy("portfolio").agg(F.min("at").alias("since"))
    last = sessions.agg(F.max("start")).first()[0]
    ahead = F.sequence("since", F.lit(last).cast(weights.schema["at"].dataType), F.expr("INTERVAL '1' DAY"))
    days = first.filter(F.col("since") <= F.lit(last).cast(weights.schema["at"].dataType)).select("portfolio", F.explode(ahead).alias("start"))
    days = days.join(sessions, "start", "left_semi")
    marked = as_of(days.select("portfolio", F.col("start").alias("at"), "start"), spans.select("portfolio", "at", F.col("at").alias("held_since")), "portfolio", "at", ["held_since"], "held_since")
    held = marked.select("portfolio", "start", F.col("held_since").alias("at")).join(own, ["portfolio", "at"]).join(rets, ["instrument", "start"], "left")
    daily = held.groupBy("portfolio", "start").agg(F.sum(F.abs("weight")).alias("exposure"), F.sum(F.col("weight") * F.coalesce("ret", F.lit(0.0))).alias("ret"), F.max("at").alias("at"))
    moved = turnover(weights)
    begun = F.row_number().over(Window.partitionBy("portfolio", "at").orderBy("start")) == 1
    rows = daily.join(moved, ["portfolio", "at"]).withColumn("turnover", F.when(begun, F.col("turnover")).otherwise(0.0))
    if cost:
        rows = rows.withColumn("ret", F.col("ret") - F.lit(float(cost)) * F.col("turnover"))
    along = running(rows, ["portfolio"], F.date_trunc("year", "start"), ["start"], {"log": ("sum", F.log1p(F.greatest("ret", F.lit(-1.0) + 1e-12))), "lost": ("max", (F.col("ret") <= -1).cast("int"))})
    valued = along.withColumn("value", F.when(F.col("lost") == 1, 0.0).otherwise(F.exp("log")))
    peaks = running(valued, ["portfolio"], F.date_trunc("year", "start"), ["start"], {"peak": ("max", F.greatest(F.col("value"), F.lit(1.0)))})
    return peaks.select("portfolio", "start", "exposure", "turnover", "ret", "value", (F.col("value") / F.col("peak") - 1).alias("drawdown"))


def calmar(curves: DataFrame, *, days_a_year: int = 365) -> DataFrame:
    """(portfolio, calmar): the yearly growth of a curve by its deepest drawdown; null without one."""
    whole = curves.groupBy("portfolio").agg(F.max_by("value", "start").alias("end"), F.min("drawdown").alias("deepest"), F.datediff(F.max("start"), F.min("start")).alias("days"))
    growth = F.pow(F.col("end"), F.lit(float(days_a_year)) / F.nullif(F.col("days"), F.lit(0))) - 1
    return whole.select("portfolio", (growth / F.abs(F.nullif(F.col("deepest"), F.lit(0.0)))).alias("calmar"))


#: What may be limited, and whether the value must stay above its bound (else below).
LIMITS = {"position": False, "sector": False, "leverage": False, "drawdown": True, "daily_loss": True}


def limits(holdings: DataFrame, curves: DataFrame, bounds: dict[str, float]) -> DataFrame:
    """(portfolio, start, limit, value, bound, may_proceed) for each portfolio, day and limit that has a bound.

    holdings: (portfolio, start, instrument, sector, weight); curves: those of `curve`. `position` is the largest weight of an
    instrument, `sector` the largest sum of weights of a sector, both without sign, `leverage` the exposure, `drawdown` and
    `daily_loss` are the curve's drawdown and return, bounded by what they may not fall under. A value at its bound is within
    it; a day without holdings has no position and no sector, and may proceed; an unknown value may not.
    """
    if unknown := set(bounds) - set(LIMITS):
        raise ValueError(f"no such limits: {sorted(unknown)}")
    key = ["portfolio", "start"]
    one = holdings.groupBy(*key, "sector", "instrument").agg(F.sum("weight").alias("w"))
    sectors = one.groupBy(*key, "sector").agg(F.max(F.abs("w")).alias("position"), F.abs(F.sum("w")).alias("sector_sum"))
    largest = sectors.groupBy(*key).agg(F.max("position").alias("position"), F.max("sector_sum").alias("sector"), F.lit(True).alias("held"))
    days = curves.select(*key, F.col("exposure").alias("leverage"), "drawdown", F.col("ret").alias("daily_loss")).join(largest, key, "left")
    days = days.withColumns({c: F.when(F.col("held"), F.col(c)).otherwise(0.0) for c in ("position", "sector")})
    each = F.array(*(F.struct(F.lit(n).alias("limit"), F.col(n).cast("double").alias("value"), F.lit(float(b)).alias("bound"), F.coalesce(F.col(n) >= b if LIMITS[n] else F.col(n) <= b, F.lit(False)).alias("may_proceed")) for n, b in bounds.items()))
    return days.select(*key, F.explode(each).alias("x")).select(*key, "x.*")


def orders_that_may_proceed(orders: DataFrame, judged: DataFrame) -> DataFrame:
    """orders (portfolio, at, ...) with `may_proceed`: whether all limits of the last day before the order's own were kept. A
    portfolio without such a day may proceed."""
    days = judged.groupBy("portfolio", "start").agg(F.every("may_proceed").alias("may_proceed"))
    known = days.select("portfolio", F.expr("start + INTERVAL '1' DAY").cast(orders.schema["at"].dataType).alias("at"), "start", "may_proceed")
    kept = as_of(orders, known, "portfolio", "at", ["may_proceed"], "start")
    return kept.withColumn("may_proceed", F.coalesce("may_proceed", F.lit(True)))
