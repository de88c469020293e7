"""The two reference tables: schemas, rules and versions."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(*f) for f in fields])


_S, _I, _D, _T = T.StringType(), T.IntegerType(), T.DateType(), T.TimestampType()

EXCHANGES = _schema(("id", _S, False), ("code", _S, False), ("name", _S, False), ("time_zone_id", _S, False), ("mic", _S, True), ("created_at_utc", _T, False), ("updated_at_utc", _T, False))
INSTRUMENTS = _schema(
    ("id", _S, False), ("exchange_id", _S, False), ("ticker", _S, False), ("name", _S, False), ("asset_type", _I, False), ("currency", _S, False), ("status", _I, False), ("listed_on", _D, True), ("delisted_on", _D, True), ("created_at_utc", _T, False), ("updated_at_utc", _T, False)
)
TABLES = {"exchanges": EXCHANGES, "instruments": INSTRUMENTS}

#: Schema versions in order; each names what the tables are from then on, and a version can be undone to the one before.
VERSIONS: list[tuple[str, dict[str, T.StructType]]] = [("1_empty", {}), ("2_reference_tables", TABLES)]


def ddl(table: str, schema: T.StructType, database: str = "reference") -> str:
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in schema.fields)
    return f"CREATE TABLE IF NOT EXISTS {database}.{table} ({columns}) USING parquet"


def migrate(spark, *, to: str | None = None, database: str = "reference") -> list[str]:
    """Brings the catalog's tables to a version (the last by default), up or down; gives the statements it ran."""
    names = [n for n, _ in VERSIONS]
    want = dict(VERSIONS)[to or names[-1]]
    ran = [f"CREATE DATABASE IF NOT EXISTS {database}"]
    spark.sql(ran[0])
    have = {r.tableName for r in spark.sql(f"SHOW TABLES IN {database}").collect()} & set(TABLES)
    ran += [f"DROP TABLE {database}.{t}" for t in sorted(have - set(want))]
    ran += [ddl(t, s, database) for t, s in want.items() if t not in have]
    for statement in ran[1:]:
        spark.sql(statement)
    return ran


def with_retry(work, *, attempts: int = 10, step: float = 2.0, most: float = 15.0, sleep=None) -> bool:
    """Runs work until it succeeds, with bounded growing pauses; False, without an error, if it never does."""
    import time

    for n in range(1, attempts + 1):
        try:
            work()
            return True
        except Exception:
            if n == attempts:
                return False
            (sleep or time.sleep)(min(step * n, most))
    return False
