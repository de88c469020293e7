"""Experiment records: one for each set of parameters and input versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.sources import experiments

SHAPE = "k int, text string, v double"


def test_versions_follow_rows_not_their_order(spark):
    rows = [(1, "a", 1.0), (2, None, None), (2, None, None), (3, "", 2.5)]
    base = experiments.version(spark.createDataFrame(rows, SHAPE))
    assert base == experiments.version(spark.createDataFrame(rows[::-1], SHAPE).repartition(3))
    others = [rows[:-1], [*rows, rows[0]], [rows[0], *rows[2:]], [(1, "a", 1.5), *rows[1:]], [(1, None, 1.0), *rows[1:]], []]
    told = [experiments.version(spark.createDataFrame(x, SHAPE)) for x in others]
    assert len({base, *told}) == len(others) + 1
    assert experiments.version(spark.createDataFrame(rows, SHAPE.replace("k int", "key int"))) != base


def test_a_repeated_run_adds_nothing(spark, tmp_path):
    calls = []

    def results():
        calls.append(1)
        return spark.range(2).toDF("n")

    run = lambda parameters, inputs: experiments.recorded(spark, str(tmp_path), "e", parameters, inputs, results)
    first = run({"a": 1, "b": "é"}, {"bars": "v1"})
    assert first[1] and run({"b": "é", "a": 1}, {"bars": "v1"}) == (first[0], False) and len(calls) == 1
    assert run({"a": 2, "b": "é"}, {"bars": "v1"})[1] and run({"a": 1, "b": "é"}, {"bars": "v2"})[1]
    at = F.lit("2024-02-03 04:05:06")
    assert experiments.recorded(spark, str(tmp_path), "e", {"a": 1, "b": "é"}, {"bars": "v1"}, results, code="c2", clock=at)[1]
    got = experiments.records(spark, str(tmp_path))
    assert {(r.code_version, r.recorded_at.year == 2024) for r in got.collect()} == {("", False), ("c2", True)}
    got = got.filter("code_version = ''")
    assert got.count() == 6 and got.select("key").distinct().count() == 3
    assert {r.parameters for r in got.collect()} == {'{"a": 1, "b": "é"}', '{"a": 2, "b": "é"}'}
