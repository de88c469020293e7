"""Loaders: Parquet with declared schemas, a database by JDBC, and the test tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from tallyforge.sources.schemas import TABLES


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A reference table as Parquet; the schema is declared, never inferred."""
    return spark.read.schema(TABLES[table]).parquet(f"{folder}/{table}")


def table_of(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def jdbc_options(environment: dict[str, str] | None = None) -> dict[str, str]:
    """Reader options from DB_HOST, DB_PORT, DB_NAME, DB_USER and DB_PASSWORD; blank counts as unset."""
    env = {k: v.strip() for k, v in (os.environ if environment is None else environment).items()}
    get = lambda k, d: env.get(k) or d
    number = get("DB_PORT", "5432")
    if not number.lstrip("+").isdigit() or not 1 <= int(number) <= 65535:
        raise ValueError(f"DB_PORT is not a port: {number!r}")
    if not env.get("DB_PASSWORD"):
        raise ValueError("DB_PASSWORD is needed")
    return {"url": f"jdbc:postgresql://{get('DB_HOST', 'localhost')}:{int(number)}/{get('DB_NAME', 'reference')}", "user": get("DB_USER", "reference"), "password": env["DB_PASSWORD"], "driver": "org.postgresql.Driver"}


def id_ranges(parts: int) -> list[str]:
    """Conditions on a column of UUIDs that cut it into ranges of equal width, each of which an index on id can answer; ids
    drawn at random fall evenly into them, and a null is in the first."""
    if parts < 1:
        raise ValueError("a table is read in one part at least")
    cuts = [str(uuid.UUID(int=(i << 128) // parts)) for i in range(parts)]
    low = [f"id >= '{c}'" for c in cuts]
    high = [f"id < '{c}'" for c in cuts[1:]]
    if parts == 1:
        return ["1 = 1"]
    return [f"({high[0]} OR id IS NULL)", *(f"{a} AND {b}" for a, b in zip(low[1:], high[1:], strict=False)), low[-1]]


def load_jdbc(spark: SparkSession, table: str, options: dict[str, str], *, parts: int = 8) -> DataFrame:
    """A table by JDBC, read in parallel by ranges of its id (needs the driver's jar)."""
    reader = spark.read.options(**{k: v for k, v in options.items() if k != "url"})
    return reader.jdbc(options["url"], table, predicates=id_ranges(parts), properties={"driver": options["driver"]})


def save_jdbc(df: DataFrame, table: str, options: dict[str, str]) -> None:
    df.write.format("jdbc").options(**options).option("dbtable", table).mode("append").save()
