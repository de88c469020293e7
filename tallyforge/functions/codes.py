"""Normalisation and validation of codes, names, ids, instants and enumerations, as column expressions.

Codes are tested for ASCII before they are upper-cased, because case mapping of other letters differs between engines.
A `try` form gives null for bad input; `strict` raises at run time.
"""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column
from pyspark.sql import functions as F

NIL_UUID = "00000000-0000-0000-0000-000000000000"
#: The persisted numbers of the two enumerations.
ASSET_TYPES = {0: "Unspecified", 1: "Equity", 2: "Etf", 3: "Index", 4: "Futures", 5: "CoveredWarrant", 6: "Bond"}
STATUSES = {0: "Pending", 1: "Listed", 2: "Suspended", 3: "Delisted"}
PENDING, LISTED, SUSPENDED, DELISTED = range(4)


def is_blank(x: Column) -> Column:
    """Null, empty or only Unicode white space."""
    return x.isNull() | x.rlike(r"(?U)\A\s*\z")


def trimmed(x: Column) -> Column:
    """Without Unicode white space at either end (trim() strips plain spaces only)."""
    return F.regexp_replace(x, r"(?U)\A\s+|\s+\z", "")


def utf16_length(x: Column) -> Column:
    """Length in UTF-16 units, where characters beyond the basic plane count twice."""
    return (F.octet_length(F.encode(x, "UTF-16BE")) / 2).cast("int")


def length_between(x: Column, low: int, high: int) -> Column:
    return utf16_length(x).between(low, high)


def is_ascii_alphanumeric(x: Column) -> Column:
    return x.rlike(r"\A[A-Za-z0-9]+\z")


def is_ascii_letters(x: Column) -> Column:
    return x.rlike(r"\A[A-Za-z]+\z")


def _code(x: Column, pattern: str) -> Column:
    plain = trimmed(x)
    return F.when(plain.rlike(rf"\A{pattern}\z"), F.upper(plain))


def ticker(x: Column) -> Column:
    """1 to 20 ASCII letters and digits, upper-cased; else null."""
    return _code(x, "[A-Za-z0-9]{1,20}")


def exchange_code(x: Column) -> Column:
    """2 to 12 ASCII letters and digits, upper-cased; else null."""
    return _code(x, "[A-Za-z0-9]{2,12}")


def currency(x: Column) -> Column:
    """3 ASCII letters, upper-cased; else null. No list of currencies is consulted."""
    return _code(x, "[A-Za-z]{3}")


def mic(x: Column) -> Column:
    """4 ASCII letters and digits, upper-cased; null for blank and for bad input (tell them apart with mic_is_bad)."""
    return _code(x, "[A-Za-z0-9]{4}")


def mic_is_bad(x: Column) -> Column:
    return ~is_blank(x) & mic(x).isNull()


def name(x: Column, most: int) -> Column:
    """Trimmed, not blank, `most` UTF-16 units at most; else null."""
    plain = trimmed(x)
    return F.when(~is_blank(x) & length_between(plain, 1, most), plain)


def strict(parsed: Column, source: Column, what: str) -> Column:
    """parsed, or an error that names the field and the value where it is null."""
    return F.when(parsed.isNotNull(), parsed).otherwise(F.raise_error(F.concat(F.lit(f"{what} is not valid: "), F.coalesce(source.cast("string"), F.lit("null")))).cast("string"))


def is_time_zone(x: Column) -> Column:
    """Whether x names a zone of the platform's database; null is none."""
    return F.coalesce(x.isin(*sorted(available_timezones())), F.lit(False))


def is_nil(x: Column) -> Column:
    """Whether an id is missing: null, blank or all zeros."""
    return is_blank(x) | (F.lower(trimmed(x)) == NIL_UUID)


def ordered_uuid(at: Column, *seed: Column) -> Column:
    """A version-7 UUID: 48 bits of milliseconds, the rest from a digest of the seed. The same seed gives the same id,
    so a task that runs again makes no new one; order inside a millisecond is not promised."""
    digest = F.md5(F.concat_ws("\x1f", *(s.cast("string") for s in seed)).cast("binary"))
    millis = F.lpad(F.lower(F.hex(F.unix_millis(at))), 12, "0")
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(F.substring(digest, 4, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat(F.substring(millis, 1, 8), F.lit("-"), F.substring(millis, 9, 4), F.lit("-7"), F.substring(digest, 1, 3), F.lit("-"), variant, F.substring(digest, 5, 3), F.lit("-"), F.substring(digest, 9, 12))


def utc_now(clock: Column | None = None) -> Column:
    """The current instant, the same for all rows of a query, or that of a clock that is given (for tests and replays)."""
    return F.current_timestamp() if clock is None else clock.cast("timestamp")


def is_utc_text(x: Column) -> Column:
    """Whether an instant's text ends in Z or a zero offset. A parsed timestamp has no offset left to check."""
    return F.coalesce(x.rlike(r"(?:[Zz]|[+-]00:?00)\z"), F.lit(False))


def date_is_before(x: Column, y: Column) -> Column:
    """x before y; false if either is missing."""
    return F.coalesce(x < y, F.lit(False))


def _mapped(x: Column, pairs: list[tuple]) -> Column:
    out = F.when(x == pairs[0][0], F.lit(pairs[0][1]))
    for a, b in pairs[1:]:
        out = out.when(x == a, F.lit(b))
    return out


def label(x: Column, names: dict[int, str]) -> Column:
    """Name of an enumeration's number; null if unknown."""
    return _mapped(x, list(names.items()))


def number(x: Column, names: dict[int, str]) -> Column:
    """Number of an enumeration's name; null if unknown."""
    return _mapped(x, [(b, a) for a, b in names.items()])


def is_active(status: Column) -> Column:
    """Anything but delisted: pending and suspended count."""
    return status != DELISTED
