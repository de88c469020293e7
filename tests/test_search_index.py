"""The gram index finds what a full scan finds, and reads its own posting lists only."""

from __future__ import annotations

import random

import pytest

from tallyforge.operators import directory, search_index

SHAPE = "ticker string, name string, n int"


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rng = random.Random(1)
    bag = ["an", "na", "ba", "ß", "é", "Ab", " ", "x", "%", "\U0001f600"]
    rows = [(k, *["".join(rng.choice(bag) for _ in range(rng.randint(0, 6))) if rng.random() < 0.9 else None for _ in range(2)], k) for k in range(400)]
    rows += [(900, "anan", "banana", 1), (901, " ", "", 1), (902, "aaa", "aaaa aaaa", 1)]
    df = spark.createDataFrame(rows, f"id int, {SHAPE}")
    folder = str(tmp_path_factory.mktemp("index"))
    search_index.build(df, folder, key="id", buckets=8)
    return df, folder


@pytest.mark.parametrize("text", ["an", "ANA", " banana ", "a", "ß", "abab", "aaaa", "%", "nobody", "", "  ", "\U0001f600x", "anban"])
def test_search_by_index(spark, indexed, text):
    df, folder = indexed
    got = search_index.search(spark, folder, text, key="id", buckets=8)
    assert sorted(map(repr, (tuple(r) for r in got.select("id", "ticker", "name", "n", "place").collect()))) == sorted(map(repr, (tuple(r) for r in directory.search(df, text).select("id", "ticker", "name", "n", "place").collect())))


def test_a_search_reads_its_own_grams(spark, indexed):
    _, folder = indexed
    plan = search_index.candidates(spark, folder, "banana", key="id", buckets=8)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(gram, [ANA,BAN,NAN])]" in plan


def test_an_index_of_nothing(spark, tmp_path):
    for rows in ([(1, None, " ", 1)], []):
        df = spark.createDataFrame(rows, f"id int, {SHAPE}")
        search_index.build(df, str(tmp_path), key="id")  # the second time it is written anew
        assert search_index.search(spark, str(tmp_path), "a", key="id").isEmpty()
