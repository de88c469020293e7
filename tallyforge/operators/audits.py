"""Constraints as queries: each gives the rows that break it, none if all is well."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import codes


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with `n`. Nulls count as equal."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def orphans(children: DataFrame, parents: DataFrame, foreign: str, key: str = "id") -> DataFrame:
    """Children whose reference has no parent; a null reference has none."""
    known = parents.select(F.col(key).alias("_parent"))
    return children.join(known, F.col(foreign) == F.col("_parent"), "left_anti")


def referenced(parents: DataFrame, children: DataFrame, foreign: str, key: str = "id") -> DataFrame:
    """Parents that must not go because a child refers to them."""
    used = children.select(F.col(foreign).alias("_used"))
    return parents.join(used, F.col(key) == F.col("_used"), "left_semi")


def active_ticker_conflicts(instruments: DataFrame) -> DataFrame:
    """(exchange_id, ticker) held by several instruments that are not delisted."""
    return duplicates(instruments.filter(codes.is_active(F.col("status"))), "exchange_id", "ticker")


def bad_exchanges(exchanges: DataFrame) -> DataFrame:
    """Rows that break a rule of their columns."""
    c = F.col
    good = c("id").isNotNull() & c("code").eqNullSafe(codes.exchange_code(c("code"))) & c("name").eqNullSafe(codes.name(c("name"), 200)) & codes.is_time_zone(c("time_zone_id")) & ~codes.mic_is_bad(c("mic"))
    return exchanges.filter(~F.coalesce(good & (c("updated_at_utc") >= c("created_at_utc")) & c("code").isNotNull() & c("name").isNotNull(), F.lit(False)))


def bad_instruments(instruments: DataFrame) -> DataFrame:
    """Rows that break a rule of their columns, unknown enumeration numbers included."""
    c = F.col
    good = c("id").isNotNull() & ~codes.is_nil(c("exchange_id")) & (c("ticker") == codes.ticker(c("ticker"))) & (c("name") == codes.name(c("name"), 300)) & (c("currency") == codes.currency(c("currency")))
    good = good & c("asset_type").isin(*codes.ASSET_TYPES) & c("status").isin(*codes.STATUSES) & ~codes.date_is_before(c("delisted_on"), c("listed_on")) & (c("updated_at_utc") >= c("created_at_utc"))
    return instruments.filter(~F.coalesce(good, F.lit(False)))


def violations(exchanges: DataFrame, instruments: DataFrame) -> dict[str, DataFrame]:
    """All constraints of the two tables by name."""
    return {
        "exchange rules": bad_exchanges(exchanges),
        "instrument rules": bad_instruments(instruments),
        "exchange ids are unique": duplicates(exchanges, "id"),
        "instrument ids are unique": duplicates(instruments, "id"),
        "exchange codes are unique": duplicates(exchanges, "code"),
        "instruments have an exchange": orphans(instruments, exchanges, "exchange_id"),
        "active tickers are unique in an exchange": active_ticker_conflicts(instruments),
    }
