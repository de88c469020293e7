"""Incremental ingest: resumed, repeated, late and superseding rows."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import types as T

from tallyforge.operators.ingest import judged
from tallyforge.streaming.ingest import Ingest

SHAPE = T.StructType().add("instrument", "string").add("start", "timestamp")
for name in ("open", "high", "low", "close"):
    SHAPE = SHAPE.add(name, "double")
SHAPE = SHAPE.add("volume", "long").add("seq", "long")
DAY = dt.datetime(2024, 1, 1)


def bar(instrument, day, close, seq, **more):
    return tuple({"instrument": instrument, "start": None if day is None else DAY + dt.timedelta(day), "open": close, "high": close, "low": close, "close": close, "volume": 1, "seq": seq, **more}.values())


FILES = [
    [bar("a", 0, 1.0, 1), bar("a", 0, 2.0, 3), bar("b", 0, 1.0, 1), bar("c", 0, -1.0, 1), bar(None, 0, 1.0, 1), bar("d", None, 1.0, 1)],
    [bar("a", 0, 3.0, 2), bar("b", 0, 4.0, 5), bar("b", 9, 4.0, 1, high=1.0), bar("a", 9, 1.0, 1)],
    [bar("b", 0, 5.0, 7), bar("b", 0, 6.0, 7), bar("a", 9, 2.0, 1), bar("e", 1, 1.0, 1), bar("c", 0, None, 2)],
    [],
]


class Broken(Ingest):
    def _commit(self, raw, accepted, rejects, number):
        if number == 1:
            raise OSError("the machine went away before the batch was audited")
        super()._commit(raw, accepted, rejects, number)


def put(spark, folder, n):
    spark.createDataFrame(FILES[n], SHAPE).coalesce(1).write.mode("append").parquet(f"{folder}/inbox")


def stream(spark, folder):
    return spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(f"{folder}/inbox")


def told(df):
    return sorted(repr(tuple(r)) for r in df.select("instrument", "start", "close", "seq", "fault").collect())


def test_a_stream_that_broke_off_resumes(spark, tmp_path):
    to = [c(str(tmp_path), SHAPE, ("instrument", "start"), ("seq", "close")) for c in (Broken, Ingest)]
    put(spark, tmp_path, 0)
    to[1].start(stream(spark, tmp_path)).awaitTermination()
    put(spark, tmp_path, 1)
    with pytest.raises(Exception, match="went away"):
        to[0].start(stream(spark, tmp_path)).awaitTermination()
    assert to[1].audit(spark).count() == 1 and to[1].raw(spark).count() == len(FILES[0])  # what was written is not seen
    put(spark, tmp_path, 2)
    to[1].start(stream(spark, tmp_path)).awaitTermination()
    every = spark.createDataFrame([r for f in FILES for r in f], SHAPE)
    want = told(judged(every, ["instrument", "start"], ["seq", "close"]))
    assert told(to[1].judged(spark)) == want
    for number in (1, 2):  # batches that run again leave all as it was
        to[1].batch(spark.createDataFrame(FILES[number], SHAPE), number)
    assert told(to[1].judged(spark)) == want
    audit = {r.batch: r for r in to[1].audit(spark).collect()}
    assert sum(r.rows for r in audit.values()) == every.count() and audit[0].invalid == 3 and audit[0].duplicate == 1
    assert {r.source for r in to[1].raw(spark).collect()} == {"stream"}


def test_late_rows_are_rejected(spark, tmp_path):
    to = Ingest(str(tmp_path), SHAPE, ("instrument", "start"), ("seq",), delay_days=3)
    for number, rows in enumerate(FILES):
        to.batch(spark.createDataFrame(rows, SHAPE), number)
    late = to.rejects(spark).filter("fault = 'late'").select("instrument", "seq", "batch").collect()
    assert sorted(map(tuple, late)) == [("b", 7, 2), ("b", 7, 2), ("e", 1, 2)]
    assert {(r.instrument, r.start.day): r.close for r in to.canonical(spark).collect()} == {("a", 1): 2.0, ("b", 1): 4.0, ("a", 10): 1.0}
    with pytest.raises(ValueError, match="event time"):
        Ingest(str(tmp_path), SHAPE, ("instrument",), ("seq",))


def test_no_rows(spark, tmp_path):
    to = Ingest(str(tmp_path), SHAPE, ("instrument", "start"), ("seq",))
    assert to.judged(spark).isEmpty()
    to.batch(spark.createDataFrame([], SHAPE), 0)
    assert to.judged(spark).isEmpty() and to.audit(spark).first()["rows"] == 0
