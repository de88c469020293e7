"""From a universe through factors, normalised and ranked, to a portfolio's weights (an extension with definitions of our own).

Bars are those of tallyforge.operators.market. Statements are (instrument, published, statement, shares, earnings, equity),
where `statement` numbers them and tells which of one instant is the later one.

Sessions are judged by themselves: means and deviations are aggregates that rows are joined to, and of a session's ranks only
the first are kept, which Spark does before rows are shuffled. No window spans more than one session or one instrument.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators import research
from tallyforge.operators.market import as_of

FACTORS = ("momentum", "volatility", "liquidity", "size", "value", "quality", "growth")


def _by(a: str | Column, b: str | Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def factor_values(bars: DataFrame, statements: DataFrame, length: int = 20) -> DataFrame:
    """(instrument, start, and the seven FACTORS) of each bar, by the last statement published at or before it.

    momentum, volatility, liquidity: as in `research.factors`; size: the logarithm of close times shares; value: earnings by
    that; quality: earnings by equity; growth: earnings by those of the instrument's statement before, less one. A factor is
    null where a part is missing or a divisor is 0, size also where its argument is not over 0. Statements without an
    instrument or a time don't count.
    """
    known = statements.dropna(subset=["instrument", "published"])
    before = F.lag("earnings").over(Window.partitionBy("instrument").orderBy("published", "statement"))
    facts = known.withColumns({"growth": _by(F.col("earnings"), before) - 1, "start": F.col("published").cast(bars.schema["start"].dataType)})
    rows = as_of(research.factors(bars, length, keep=("close",)), facts, "instrument", "start", ["shares", "earnings", "equity", "growth"], "statement")
    worth = F.col("close") * F.col("shares")
    made = {"size": F.when(worth > 0, F.log(worth)), "value": _by(F.col("earnings"), worth), "quality": _by(F.col("earnings"), F.col("equity"))}
    return rows.withColumns(made).select("instrument", "start", *FACTORS)


def _first(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of each session, with `place` from 1."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("start").orderBy(*order))).filter(F.col("place") <= n)


def universe(values: DataFrame, most: int) -> DataFrame:
    """The `most` instruments of the highest liquidity of each session (ties: the lower instrument); without one: not in it."""
    return _first(values.filter("liquidity IS NOT NULL"), most, F.desc("liquidity"), F.asc("instrument")).drop("place")


def normalised(values: DataFrame, names: tuple[str, ...] = FACTORS, *, clip: float = 3.0) -> DataFrame:
    """values with each named factor as its z-score among its session's known ones, cut off at `clip` deviations either way.
    Null stays null, and so does a factor that is the same for all of a session."""
    told = [f(n).alias(f"_{k}_{n}") for n in names for k, f in (("mean", F.avg), ("dev", F.stddev_pop), ("low", F.min), ("high", F.max))]
    rows = values.join(values.groupBy("start").agg(*told), "start")

    def z(n: str) -> Column:
        x = (F.col(n) - F.col(f"_mean_{n}")) / F.col(f"_dev_{n}")
        return F.when(F.col(n).isNotNull() & (F.col(f"_low_{n}") < F.col(f"_high_{n}")), F.greatest(F.lit(-clip), F.least(F.lit(clip), x)))

    return rows.withColumns({n: z(n) for n in names}).select(values.columns)


def scored(z: DataFrame, weights: dict[str, float]) -> DataFrame:
    """z with `score`, the mean of the factors that are known, by their weights (a negative one: less is better); null where
    none is known."""
    if unknown := set(weights) - set(z.columns):
        raise ValueError(f"no such factors: {sorted(unknown)}")
    total, size = F.lit(0.0), F.lit(0.0)
    for n, w in weights.items():
        total = total + F.coalesce(F.col(n) * float(w), F.lit(0.0))
        size = size + F.when(F.col(n).isNotNull(), abs(float(w))).otherwise(0.0)
    return z.withColumn("score", _by(total, size))


def chosen(rows: DataFrame, best: int, *, digits: int = 9) -> DataFrame:
    """(start, at, instrument, place, score, weight): the `best` scores of each session in equal parts, to be held from the day
    after it on. Scores are compared to `digits` decimals; ties go to the lower instrument."""
    some = rows.filter("score IS NOT NULL").withColumn("score", F.round("score", digits))
    first = _first(some, best, F.desc("score"), F.asc("instrument"))
    n = F.count(F.lit(1)).over(Window.partitionBy("start"))
    after = F.expr("start + INTERVAL '1' DAY").cast(rows.schema["start"].dataType)
    return first.select("start", after.alias("at"), "instrument", "place", "score", (F.lit(1.0) / n).alias("weight"))


def selected(bars: DataFrame, statements: DataFrame, weights: dict[str, float], *, length: int = 20, most: int = 500, best: int = 50, clip: float = 3.0) -> DataFrame:
    """The whole way: `factor_values`, `universe`, `normalised` within it, `scored`, `chosen`."""
    within = universe(factor_values(bars, statements, length), most)
    return chosen(scored(normalised(within, tuple(weights), clip=clip), weights), best)
