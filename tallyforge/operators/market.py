"""Market-data analytics (an extension with definitions of our own).

Ticks: (instrument, ts, tick_id, price). Bars: (instrument, day, open, high, low, close, volume).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bars(ticks: DataFrame, unit: str = "day") -> DataFrame:
    """Bars of a calendar unit; volume is the number of ticks; ticks of one instant are ordered by tick_id."""
    at = F.struct("ts", "tick_id")
    return (
        ticks.groupBy("instrument", F.date_trunc(unit, "ts").alias("start"))
        .agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count(F.lit(1)).alias("volume"))
    )


def minute_bars(ticks: DataFrame, minutes: int) -> DataFrame:
    """Bars of 5, 15, 30 or so minutes from midnight UTC, as `bars`, with the traded value (sum of prices)."""
    at, step = F.struct("ts", "tick_id"), 60 * minutes
    start = F.timestamp_seconds(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / step) * step)
    return (
        ticks.groupBy("instrument", start.alias("start"))
        .agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count(F.lit(1)).alias("volume"), F.sum("price").alias("value"))
    )


def insane(rows: DataFrame) -> DataFrame:
    """Bars whose high or low doesn't bound open and close, with a negative volume, or with a price of 0 or less."""
    sane = (F.col("high") >= F.greatest("open", "close")) & (F.col("low") <= F.least("open", "close")) & (F.col("volume") >= 0) & (F.least("open", "high", "low", "close") > 0)
    return rows.filter(~F.coalesce(sane, F.lit(False)))


def overnight_gaps(rows: DataFrame, bound: float = 0.3) -> DataFrame:
    """(instrument, start, gap) where open is `bound` or more away from the close before, as a share of it."""
    before = F.lag("close").over(Window.partitionBy("instrument").orderBy("start"))
    return rows.withColumn("gap", F.col("open") / F.nullif(before, F.lit(0.0)) - 1).filter(F.abs("gap") >= bound).select("instrument", "start", "gap")


def missing_sessions(rows: DataFrame) -> DataFrame:
    """(instrument, start) of sessions, days on which any instrument traded, without a bar between an instrument's
    first and last one."""
    span = rows.groupBy("instrument").agg(F.min("start").alias("a"), F.max("start").alias("b"))
    days = span.select("instrument", F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("start"))
    open_ = days.join(rows.select("start").distinct(), "start", "left_semi")
    return open_.join(rows.select("instrument", "start"), ["instrument", "start"], "left_anti").select("instrument", "start")


def volume_ratio(rows: DataFrame, length: int = 20) -> DataFrame:
    """(instrument, start, ratio): volume by the mean of the `length` bars before, without the bar itself."""
    before = Window.partitionBy("instrument").orderBy("start").rowsBetween(-length, -1)
    return rows.withColumn("ratio", F.col("volume") / F.avg("volume").over(before)).filter("ratio is not null").select("instrument", "start", "ratio")


def breadth(rows: DataFrame) -> DataFrame:
    """Advancers, decliners and unchanged by session, against each instrument's bar before."""
    before = F.lag("close").over(Window.partitionBy("instrument").orderBy("start"))
    moved = rows.withColumn("move", F.col("close") - before).filter("move is not null")
    return moved.groupBy("start").agg(F.count_if(F.col("move") > 0).alias("advancers"), F.count_if(F.col("move") < 0).alias("decliners"), F.count_if(F.col("move") == 0).alias("unchanged"))


def breadth_by_volume(rows: DataFrame) -> DataFrame:
    """(start, advancing, declining, unchanged, ratio): the volume of the instruments that `breadth` counts by session, and the
    advancing volume by the declining one (null where that is 0). A null volume is 0."""
    before = F.lag("close").over(Window.partitionBy("instrument").orderBy("start"))
    moved = rows.withColumn("move", F.signum(F.col("close") - before)).filter("move is not null")
    of = lambda sign: F.sum(F.when(F.col("move") == sign, F.coalesce("volume", F.lit(0))).otherwise(0))
    sums = moved.groupBy("start").agg(of(1).alias("advancing"), of(-1).alias("declining"), of(0).alias("unchanged"))
    return sums.withColumn("ratio", F.col("advancing") / F.nullif("declining", F.lit(0)))


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, values: list[str], tie: str) -> DataFrame:
    """left with the values of the last right row of its key at or before its instant (the highest tie of one instant).

    One shuffle of the union by key and one sorted pass: no range join, and nothing is broadcast.
    """
    own = [c for c in left.columns if c not in (key, ts)]
    l = left.select(key, ts, F.lit(1).alias("_side"), F.lit(None).cast(right.schema[tie].dataType).alias("_tie"), F.struct(*own).alias("_own"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_v"))  # noqa: E741
    r = right.select(key, ts, F.lit(0).alias("_side"), F.col(tie).alias("_tie"), F.lit(None).cast(l.schema["_own"].dataType).alias("_own"), F.struct(*values).alias("_v"))
    w = Window.partitionBy(key).orderBy(ts, "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r).withColumn("_v", F.last("_v", ignorenulls=True).over(w)).filter("_side = 1")
    return both.select(key, ts, "_own.*", *(F.col(f"_v.{v}").alias(v) for v in values))


def returns(rows: DataFrame) -> DataFrame:
    """(instrument, start, ret): close over the close before, less one."""
    before = F.lag("close").over(Window.partitionBy("instrument").orderBy("start"))
    return rows.withColumn("ret", F.col("close") / F.nullif(before, F.lit(0.0)) - 1).filter("ret is not null").select("instrument", "start", "ret")


def factor_ranks(values: DataFrame) -> DataFrame:
    """(instrument, start, value) with z-score and rank (1 is the highest) within each session."""
    within = Window.partitionBy("start")
    z = (F.col("value") - F.avg("value").over(within)) / F.nullif(F.stddev_pop("value").over(within), F.lit(0.0))
    return values.withColumns({"z": z, "place": F.rank().over(within.orderBy(F.desc("value")))})


def drawdowns(rows: DataFrame) -> DataFrame:
    """(instrument, start, drawdown): close below its highest so far, as a share of that."""
    peak = F.max("close").over(Window.partitionBy("instrument").orderBy("start").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("drawdown", F.col("close") / F.nullif(peak, F.lit(0.0)) - 1).select("instrument", "start", "drawdown")


def risk(rets: DataFrame) -> DataFrame:
    """By instrument: bars, mean and standard deviation of returns, and their 5 % quantile (value at risk)."""
    return rets.groupBy("instrument").agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("deviation"), F.percentile("ret", F.lit(0.05)).alias("var_5"))


def breaches(cash: DataFrame, held: DataFrame, key: str, tolerance: float = 0.0) -> DataFrame:
    """Reconciliation of (key, amount) in two books: keys that one lacks, or whose amounts differ by more."""
    a, b = cash.select(key, F.col("amount").alias("left_amount")), held.select(key, F.col("amount").alias("right_amount"))
    differ = F.col("left_amount").isNull() | F.col("right_amount").isNull() | (F.abs(F.col("left_amount") - F.col("right_amount")) > tolerance)
    return a.join(b, key, "full_outer").filter(differ)
