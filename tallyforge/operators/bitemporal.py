"""What was known when: facts that hold at one time and were learnt at another (an extension with definitions of our own).

A fact is a row (key columns, known_at, version, values, withdrawn). Later versions of one key supersede earlier ones from
the moment they are known; a withdrawn version ends the fact until another one comes. `moments` are the times from which one
looks back, a short list.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators import research


def _moments(moments: list[dt.datetime], like: str) -> Column:
    return F.explode(F.array(*(F.lit(m).cast(like) for m in moments)))


def known(facts: DataFrame, key: list[str], values: list[str], moments: list[dt.datetime], *, version: str = "version") -> DataFrame:
    """(moment, key, values): each fact as it was known at each moment. Facts without known_at were never known.

    One shuffle by (moment, key) with map-side pre-aggregation; a key's versions are never held together.
    """
    each = facts.withColumn("moment", _moments(moments, facts.schema["known_at"].dataType.simpleString())).filter("known_at <= moment")
    last = F.max_by(F.struct("withdrawn", *values), F.struct("known_at", version)).alias("_last")
    return each.groupBy("moment", *key).agg(last).filter(~F.coalesce(F.col("_last.withdrawn"), F.lit(False))).select("moment", *key, *(F.col(f"_last.{v}").alias(v) for v in values))


def adjusted_as_known(bars: DataFrame, actions: DataFrame, moments: list[dt.datetime]) -> DataFrame:
    """Bars before each moment, adjusted by the actions (instrument, ex_start, factor) as they were known then: columns of
    bars, moment, factor, adjusted_close. Raw columns stay, and so does every earlier answer."""
    kept = known(actions, ["instrument", "ex_start"], ["factor"], moments)
    own = F.struct("moment", "instrument").alias("instrument")
    seen = bars.withColumn("moment", _moments(moments, bars.schema["start"].dataType.simpleString())).filter(F.col("start") < F.col("moment"))
    acts = kept.withColumn("moment", F.col("moment").cast(bars.schema["start"].dataType)).select(own, "ex_start", "factor")
    rest = [c for c in bars.columns if c != "instrument"]
    got = research.adjusted(seen.select(own, *rest), acts)
    return got.select("instrument.instrument", *rest, "instrument.moment", "factor", "adjusted_close")


def published(statements: DataFrame, moments: list[dt.datetime], values: list[str]) -> DataFrame:
    """(moment, instrument, period, values): of each instrument the newest period of which a figure was known at each moment,
    as it was known then."""
    seen = known(statements, ["instrument", "period"], values, moments)
    newest = F.row_number().over(Window.partitionBy("moment", "instrument").orderBy(F.desc("period")))
    return seen.withColumn("_turn", newest).filter("_turn = 1").drop("_turn")
