"""Expressions over settings and status texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.codes import trimmed

#: A check's status as it is shown.
SHOWN = {"Healthy": "online", "Degraded": "degraded", "Unhealthy": "offline"}
UNKNOWN = "unknown"


def split_list(x: Column) -> Column:
    """Comma-separated items, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(x, ","), trimmed), lambda e: e != "")


def without_trailing_slash(x: Column) -> Column:
    return F.regexp_replace(x, r"/+\z", "")


def percent_encoded(x: Column) -> Column:
    """Everything but ASCII letters, digits and _.-~ as %XX of UTF-8 (url_encode alone makes form encoding)."""
    return F.replace(F.replace(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def database_url(user: Column, secret: Column, host: Column, port: Column, database: Column, scheme: str = "postgresql") -> Column:
    return F.concat(F.lit(f"{scheme}://"), percent_encoded(user), F.lit(":"), percent_encoded(secret), F.lit("@"), percent_encoded(host), F.lit(":"), port.cast("string"), F.lit("/"), percent_encoded(database))


def or_default(x: Column, default: Column) -> Column:
    """Trimmed; the default where nothing is left."""
    return F.coalesce(F.nullif(trimmed(x), F.lit("")), default)


def port(x: Column, default: int, low: int = 1, high: int = 65535) -> Column:
    """A whole number in range, the default for blank, null for anything else."""
    plain = trimmed(x)
    value = plain.try_cast("int")
    return F.when(x.isNull() | (plain == ""), F.lit(default)).when(plain.rlike(r"\A[+-]?[0-9]+\z") & value.between(low, high), value)


def shown_status(x: Column, reachable: Column) -> Column:
    """Status as shown; everything is unknown where the service behind can't be reached."""
    shown = F.lit(UNKNOWN)
    for name, word in SHOWN.items():
        shown = F.when(x == name, F.lit(word)).otherwise(shown)
    return F.when(F.coalesce(reachable, F.lit(False)), shown).otherwise(F.lit(UNKNOWN))


def retry_delay(attempt: Column, step: float = 2.0, most: float = 15.0) -> Column:
    """Seconds before another attempt: growing by a step, bounded."""
    return F.least(attempt * step, F.lit(most))
