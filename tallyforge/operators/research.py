"""Price adjustment, ratios, factors and portfolio risk (an extension with definitions of our own).

Bars are those of tallyforge.operators.market; returns are (instrument, start, ret).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.running import running


def adjusted(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """bars with `factor`, the product of the factors (over 0) of all actions (instrument, ex_start, factor) after them,
    and `adjusted_close`. The raw columns stay. One shuffle of both by instrument; no range join."""
    shape = bars.columns
    day = bars.select("instrument", "start", F.lit(0.0).alias("_log"), F.lit(1).alias("_bar"), F.struct(*shape).alias("_own"))
    acts = actions.select("instrument", F.col("ex_start").cast(bars.schema["start"].dataType).alias("start"), F.log("factor").alias("_log"), F.lit(0).alias("_bar"), F.lit(None).cast(day.schema["_own"].dataType).alias("_own"))
    # From the newest back; a bar of the ex-day itself comes before the action of that day and is not changed by it.
    later = Window.partitionBy("instrument").orderBy(F.desc("start"), F.desc("_bar")).rowsBetween(Window.unboundedPreceding, 0)
    got = day.unionByName(acts).withColumn("factor", F.exp(F.sum("_log").over(later))).filter("_bar = 1")
    return got.select("_own.*", "factor").withColumn("adjusted_close", F.col("close") * F.col("factor"))


def _per(a: str, b: str) -> Column:
    return F.col(a) / F.nullif(F.col(b), F.lit(0.0))


def ratios(statements: DataFrame) -> DataFrame:
    """statements with ten ratios; null where a divisor is 0 or a part is missing. Columns needed: price, shares,
    earnings, equity, ebitda, debt, cash, assets, revenue, current_assets, current_liabilities, free_cash_flow, tax_rate,
    operating_income."""
    c = F.col
    rows = statements.withColumns({"_cap": c("price") * c("shares"), "_invested": c("debt") + c("equity"), "_after_tax": c("operating_income") * (1 - c("tax_rate"))}).withColumn("_value", c("_cap") + c("debt") - c("cash"))
    made = {
        "price_earnings": _per("_cap", "earnings"), "price_book": _per("_cap", "equity"), "value_ebitda": _per("_value", "ebitda"), "return_equity": _per("earnings", "equity"), "return_assets": _per("earnings", "assets"),
        "return_invested": _per("_after_tax", "_invested"), "net_margin": _per("earnings", "revenue"), "debt_equity": _per("debt", "equity"), "current_ratio": _per("current_assets", "current_liabilities"), "cash_yield": _per("free_cash_flow", "_cap"),
    }
    return rows.withColumns(made).drop("_cap", "_invested", "_after_tax", "_value")


#: Ranges of values into which a sector is cut.
RANGES = 64


def against_sector(rows: DataFrame, value: str, *by: str, ranges: int = RANGES) -> DataFrame:
    """rows with a value, and beside it the `median` of its sector (and of what else `by` names) and `percentile`, the
    share of the others there that are lower (0 where there is no other).

    No task holds a sector: equal values are counted before they meet, a sector is cut into ranges of about equal counts,
    and a value's rank is the count of the ranges before its own and of the values before it there. A median is what stands
    at the middle ranks.
    """
    some = rows.filter(F.col(value).isNotNull())
    counts = some.groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    cuts = some.groupBy(*by).agg(F.count(F.lit(1)).alias("_all"), F.percentile_approx(value, F.array(*(F.lit(k / ranges) for k in range(1, ranges))), ranges * 8).alias("_cuts"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    placed = counts.alias("l").join(cuts.alias("r"), same).select("l.*", "_all", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).alias("_range"))
    # A null among `by` is a sector of its own; a struct of the columns compares as equal where they are null alike.
    ranked = running(placed.withColumn("_by", F.to_json(F.struct(*by), {"ignoreNullFields": "false"})), ["_by"], F.col("_range"), ["_v"], {"_before": ("sum", F.col("_n"))}, own=False)
    before = F.coalesce("_before", F.lit(0))
    ranked = ranked.select("_by", "_v", "_n", "_all", before.alias("_before"))
    middle = [F.floor((F.col("_all") - 1) / 2), F.ceil((F.col("_all") - 1) / 2)]
    holds = [(F.col("_before") <= m) & (m < F.col("_before") + F.col("_n")) for m in middle]
    medians = ranked.filter(holds[0] | holds[1]).groupBy("_by").agg(F.avg("_v").alias("median"))
    share = F.when(F.col("_all") > 1, F.col("_before") / (F.col("_all") - 1)).otherwise(0.0)
    known = ranked.join(medians, "_by").select("_by", "_v", share.alias("percentile"), "median")
    own = some.withColumns({"_by": F.to_json(F.struct(*by), {"ignoreNullFields": "false"}), "_v": F.col(value)})
    return own.join(known, ["_by", "_v"]).select(*rows.columns, "percentile", "median")


def factors(bars: DataFrame, length: int = 20, keep: tuple[str, ...] = ()) -> DataFrame:
    """(instrument, start, what of bars to keep, momentum, volatility, liquidity): the return over `length` bars, the standard deviation of the
    last `length` one-bar returns, and the mean of close times volume of the last `length` bars. Null before there are
    that many."""
    order = Window.partitionBy("instrument").orderBy("start")
    last = order.rowsBetween(1 - length, 0)
    rows = bars.withColumns({"_ret": F.col("close") / F.nullif(F.lag("close").over(order), F.lit(0.0)) - 1, "_turned": F.col("close") * F.col("volume")})
    full = lambda x, c: F.when(F.count(c).over(last) == length, x)
    made = {"momentum": F.col("close") / F.nullif(F.lag("close", length).over(order), F.lit(0.0)) - 1, "volatility": full(F.stddev_samp("_ret").over(last), "_ret"), "liquidity": full(F.avg("_turned").over(last), "_turned")}
    return rows.withColumns(made).select("instrument", "start", *keep, *made)


def market_returns(rets: DataFrame) -> DataFrame:
    """(start, market): the mean return of all instruments that have one, by session."""
    return rets.groupBy("start").agg(F.avg("ret").alias("market"))


def performance(rets: DataFrame, market: DataFrame, *, periods: int = 252, free: float = 0.0, tail: float = 0.05) -> DataFrame:
    """By instrument, over sessions in which the market has a return too: Sharpe and Sortino ratios (annualised by
    `periods`; `free` is the risk-free return of one period), the mean of the returns at or under the `tail` quantile
    (cvar), and beta and alpha (a period's) against the market. Null where a divisor is 0 or too few rows are there."""
    both = rets.join(market, "start").withColumn("excess", F.col("ret") - free)
    worst = both.groupBy("instrument").agg(F.percentile("ret", F.lit(tail)).alias("_var"))
    rows = both.join(worst, "instrument")
    own = rows.groupBy("instrument").agg(
        F.avg("excess").alias("_m"), F.stddev_samp("excess").alias("_s"), F.sqrt(F.avg(F.least("excess", F.lit(0.0)) * F.least("excess", F.lit(0.0)))).alias("_d"), F.avg(F.when(F.col("ret") <= F.col("_var"), F.col("ret"))).alias("cvar"),
        F.covar_pop("ret", "market").alias("_c"), F.var_pop("market").alias("_v"), F.avg("ret").alias("_r"), F.avg("market").alias("_k"),
    )
    year = float(periods) ** 0.5
    beta = F.col("_c") / F.nullif(F.col("_v"), F.lit(0.0))
    return own.withColumns({"sharpe": F.col("_m") / F.nullif(F.col("_s"), F.lit(0.0)) * year, "sortino": F.col("_m") / F.nullif(F.col("_d"), F.lit(0.0)) * year, "beta": beta}).withColumn("alpha", F.col("_r") - free - F.col("beta") * (F.col("_k") - free)).select("instrument", "sharpe", "sortino", "cvar", "beta", "alpha")


def exposures(positions: DataFrame, portfolio: str, group: str) -> DataFrame:
    """(portfolio, group, value, share, concentration) of positions with a value: the group's value, its share of the
    portfolio's gross value, and the sum of the squared shares of the portfolio's groups."""
    sums = positions.groupBy(portfolio, group).agg(F.sum("value").alias("value"), F.sum(F.abs("value")).alias("_gross"))
    within = Window.partitionBy(portfolio)
    shared = sums.withColumn("share", F.col("_gross") / F.nullif(F.sum("_gross").over(within), F.lit(0.0))).drop("_gross")
    return shared.withColumn("concentration", F.sum(F.col("share") * F.col("share")).over(within))


def stressed(positions: DataFrame, portfolio: str, group: str, shocks: dict[str, dict[str, float]]) -> DataFrame:
    """(portfolio, scenario, loss) for each named scenario of shocks by group (share of value; "" is any other group).
    The scenarios are a parameter and ride along as an array."""
    def change(by: dict[str, float]) -> Column:
        out = F.lit(float(by.get("", 0.0)))
        for g, x in by.items():
            out = F.when(F.col(group) == g, F.lit(float(x))).otherwise(out) if g else out
        return out

    each = F.explode(F.array(*(F.struct(F.lit(n).alias("scenario"), (-F.col("value") * change(by)).alias("loss")) for n, by in shocks.items()))).alias("s")
    return positions.select(portfolio, each).groupBy(portfolio, "s.scenario").agg(F.sum("s.loss").alias("loss"))


def over_limit(exposed: DataFrame, most: float) -> DataFrame:
    """Rows of `exposures` whose share is over the limit: what may not grow further."""
    return exposed.filter(F.col("share") > most)


def watchlist(bars: DataFrame, length: int = 20) -> DataFrame:
    """The last bar of each instrument: (instrument, start, price, change, volume, value, volume_ratio), with the change
    against the close before and the volume by the mean of the `length` bars before."""
    order = Window.partitionBy("instrument").orderBy("start")
    made = {"change": F.col("close") - F.lag("close").over(order), "volume_ratio": F.col("volume") / F.avg("volume").over(order.rowsBetween(-length, -1)), "_next": F.lead("start").over(order)}
    return bars.withColumns(made).filter("_next is null").select("instrument", "start", F.col("close").alias("price"), "change", "volume", (F.col("close") * F.col("volume")).alias("value"), "volume_ratio")
