from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import codes, settings


def values(spark, expression, inputs, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("x"))).collect()]


def test_ticker(spark):
    good = {"abc": "ABC", "  abc\t": "ABC", " xy9": "XY9", "a" * 20: "A" * 20, "7": "7"}
    assert values(spark, codes.ticker, list(good)) == list(good.values())
    assert values(spark, codes.ticker, ["A.B", "A:B", "A-B", "A B", None, "", " \n", "a" * 21, "ß", "ı", "abc\nd", "é"]) == [None] * 12


def test_exchange_code_and_currency(spark):
    assert values(spark, codes.exchange_code, ["xy", " abcdefghijkl ", "x", "a-b", "a" * 13, None, ""]) == ["XY", "ABCDEFGHIJKL", None, None, None, None, None]
    assert values(spark, codes.currency, ["eur", " Usd\n", "eu", "euro", "e1r", None]) == ["EUR", "USD", None, None, None, None]


def test_mic_blank_is_not_bad(spark):
    inputs = ["abcd", " ab12 ", "abc", "abcde", "ab-c", None, "  "]
    assert values(spark, codes.mic, inputs) == ["ABCD", "AB12", None, None, None, None, None]
    assert values(spark, codes.mic_is_bad, inputs) == [False, False, True, True, True, False, False]


def test_blank_trim_and_length(spark):
    inputs = [None, "", " \t\n", "   ", " x ", "a b"]
    assert values(spark, codes.is_blank, inputs) == [True, True, True, True, False, False]
    assert values(spark, codes.trimmed, [" a b\n", "x"]) == ["a b", "x"]
    assert values(spark, codes.utf16_length, ["", "ab", "\U0001f600"]) == [0, 2, 2]
    assert values(spark, lambda x: codes.name(x, 4), [" ab ", "abcd", "abcde", "\U0001f600\U0001f600x", " ", None]) == ["ab", "abcd", None, None, None, None]


def test_strict_raises(spark):
    with pytest.raises(Exception, match="ticker is not valid"):
        values(spark, lambda x: codes.strict(codes.ticker(x), x, "ticker"), ["A.B"])


def test_zone_nil_and_utc(spark):
    assert values(spark, codes.is_time_zone, ["Europe/Oslo", "Nowhere/City", None]) == [True, False, False]
    assert values(spark, codes.is_nil, [codes.NIL_UUID, None, " ", "5b1e8c1c-0000-7000-8000-000000000001"]) == [True, True, True, False]
    assert values(spark, codes.is_utc_text, ["2024-01-01T00:00:00Z", "2024-01-01T00:00:00+00:00", "2024-01-01T00:00:00+07:00", None, "2024-01-01"]) == [True, True, False, False, False]


def test_ordered_uuid(spark):
    got = [r[0] for r in spark.range(3).select(codes.ordered_uuid(F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("id")), F.col("id"))).collect()]
    assert got == sorted(got) and len(set(got)) == 3
    assert all(re.fullmatch(r"[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}", x) for x in got)


def test_enumerations(spark):
    assert values(spark, lambda x: codes.label(x, codes.ASSET_TYPES), [0, 6, 7, None], "int") == ["Unspecified", "Bond", None, None]
    assert values(spark, lambda x: codes.number(x, codes.STATUSES), ["Delisted", "Gone"]) == [3, None]
    assert values(spark, codes.is_active, [0, 1, 2, 3], "int") == [True, True, True, False]


def test_settings(spark):
    assert values(spark, settings.split_list, ["a, b ,,c", "", " , "]) == [["a", "b", "c"], [], []]
    assert values(spark, settings.without_trailing_slash, ["http://x/", "http://x", "x//"]) == ["http://x", "http://x", "x"]
    assert values(spark, settings.percent_encoded, ["a b@:/*~é-_.+"]) == ["a%20b%40%3A%2F%2A~%C3%A9-_.%2B"]
    assert values(spark, lambda x: settings.or_default(x, F.lit("d")), ["v", " v ", " ", None]) == ["v", "v", "d", "d"]
    assert values(spark, lambda x: settings.port(x, 5432), ["1", " 65535 ", "0", "65536", "x", "", None, "1.5"]) == [1, 65535, None, None, None, 5432, 5432, None]
    assert values(spark, lambda x: settings.shown_status(x, F.lit(True)), ["Healthy", "Degraded", "Unhealthy", "Odd", None]) == ["online", "degraded", "offline", "unknown", "unknown"]
    assert values(spark, lambda x: settings.shown_status(x, F.lit(False)), ["Healthy"]) == ["unknown"]
    assert values(spark, settings.retry_delay, [1, 3, 50], "int") == [2.0, 6.0, 15.0]
    one = spark.range(1).select(settings.database_url(F.lit("u:s"), F.lit("p@/"), F.lit("h"), F.lit(5432), F.lit("d"))).first()[0]
    assert one == "postgresql://u%3As:p%40%2F@h:5432/d"
