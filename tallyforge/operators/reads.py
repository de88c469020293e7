"""The reads of the reference tables. Predicates are plain comparisons, so they reach the Parquet scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions import codes


def by_id(rows: DataFrame, id_: str) -> DataFrame:
    """The row of an id, of any status; none or one."""
    return rows.filter(F.col("id") == F.lit(id_).cast(rows.schema["id"].dataType)).limit(1)


def _held(instruments: DataFrame, exchange_id, ticker: str) -> DataFrame:
    return instruments.filter((F.col("exchange_id") == exchange_id) & (F.col("ticker") == ticker))


def active_by_ticker(instruments: DataFrame, exchange_id, ticker: str) -> DataFrame:
    """Who holds a ticker now: not delisted; the lowest id if a broken table has several."""
    return _held(instruments, exchange_id, ticker).filter(codes.is_active(F.col("status"))).orderBy("id").limit(1)


def ticker_history(instruments: DataFrame, exchange_id, ticker: str) -> DataFrame:
    """All that hold or held a ticker under their present one, the newest first, ids from the highest on ties."""
    return _held(instruments, exchange_id, ticker).orderBy(F.desc("created_at_utc"), F.desc("id"))


def ticker_is_taken(instruments: DataFrame, exchange_id, ticker: str) -> bool:
    return not _held(instruments, exchange_id, ticker).filter(codes.is_active(F.col("status"))).isEmpty()


def exchange_by_code(exchanges: DataFrame, code: str) -> DataFrame:
    """The exchange of a code, which is normalised first; none for a code that is not valid."""
    return exchanges.filter(F.col("code") == codes.exchange_code(F.lit(code))).limit(1)


def exchanges_listed(exchanges: DataFrame) -> DataFrame:
    return exchanges.orderBy("code")


def current_holders(instruments: DataFrame) -> DataFrame:
    """active_by_ticker for all pairs at once: the lowest active id of each (exchange_id, ticker)."""
    active = instruments.filter(codes.is_active(F.col("status")))
    return active.groupBy("exchange_id", "ticker").agg(F.min("id").alias("id"))


def tickers_taken(pairs: DataFrame, instruments: DataFrame) -> DataFrame:
    """pairs (exchange_id, ticker) with `taken`, whether an active instrument holds the ticker."""
    held = instruments.filter(codes.is_active(F.col("status"))).select("exchange_id", "ticker").distinct().withColumn("_held", F.lit(True))
    return pairs.join(held, ["exchange_id", "ticker"], "left").withColumn("taken", F.coalesce("_held", F.lit(False))).drop("_held")


def histories(instruments: DataFrame) -> DataFrame:
    """ticker_history for all pairs at once, with the turn of each holder (1 is the newest)."""
    turn = Window.partitionBy("exchange_id", "ticker").orderBy(F.desc("created_at_utc"), F.desc("id"))
    return instruments.withColumn("turn", F.row_number().over(turn))


def liveness(spark: SparkSession) -> DataFrame:
    """A constant row, made without reading anything."""
    return spark.range(1).select(F.lit("Healthy").alias("status"))


def round_trip(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT 1 AS one")


def answering(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, status) of each table: Healthy if a row can be read from it. One row of each is looked at."""
    found = None
    for name, rows in tables.items():
        one = rows.limit(1).agg(F.when(F.count(F.lit(1)) > 0, "Healthy").otherwise("Unhealthy").alias("status")).select(F.lit(name).alias("name"), "status")
        found = one if found is None else found.unionByName(one)
    return found
