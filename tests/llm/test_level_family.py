"""The family of suffix levels: opened again, merged by equal ranks, one writer at a time."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyforge.llm.suffixes import Family


def members(spark, grams):
    shape = "suffix binary, doc bigint, at int"
    return spark.createDataFrame([(g.encode().ljust(32, b"."), i, i) for i, g in enumerate(grams)], shape)


def hit(rows):
    return {bytes(r.suffix).rstrip(b".").decode() for r in rows.collect()}


def in_levels(family):
    return {bytes(r.suffix).rstrip(b".").decode() for _, path in family.levels for r in family.array(path).collect()}


def test_batches_over_families_opened_again(spark, tmp_path):
    rng, seen = random.Random(5), Counter()
    for turn in range(7):
        batch = [f"g{rng.randint(0, 60)}" for _ in range(30)]
        family = Family(spark, f"file://{tmp_path}/family", buckets=3)
        assert family.turn == turn and in_levels(family) == set(seen)
        got = hit(family.add(members(spark, batch)))
        assert got == {g for g in batch if g in seen or batch.count(g) > 1}
        seen.update(batch)
        assert [r for r, _ in family.levels] == [k for k in range(3, -1, -1) if (turn + 1) >> k & 1]
    held = Family(spark, f"file://{tmp_path}/family", buckets=9)
    assert held.buckets == 3 and in_levels(held) == set(seen)
    assert sum((Counter({bytes(r.suffix).rstrip(b".").decode(): r.n}) for _, p in held.levels for r in held.array(p).collect()), Counter()) == seen
    for _, path in held.levels:  # one sorted file a bucket at most, which the merge-scan relies on
        files = [r.f for r in held.array(path).select(F.input_file_name().alias("f")).distinct().collect()]
        buckets = [f.rsplit("_", 1)[1].split(".")[0] for f in files]
        assert len(buckets) == len(set(buckets)) and held.array(path).count() == held.array(path).select("suffix").distinct().count()


def test_the_second_of_two_writers_is_refused(spark, tmp_path):
    at = f"file://{tmp_path}/family"
    Family(spark, at, buckets=2).add(members(spark, ["a"]))
    one, two = Family(spark, at), Family(spark, at)
    one.add(members(spark, ["b"]))
    with pytest.raises(RuntimeError, match="another writer"):
        two.add(members(spark, ["c"]), last=True)
    assert in_levels(Family(spark, at)) == {"a", "b"}


def test_a_manifest_that_was_broken_off_is_passed_over(spark, tmp_path):
    at = f"file://{tmp_path}/family"
    Family(spark, at, buckets=2).add(members(spark, ["a"]))
    (tmp_path / "family" / "levels-00000002.json").write_bytes(b"")
    family = Family(spark, at)
    assert in_levels(family) == {"a"} and hit(family.add(members(spark, ["a", "b"]))) == {"a"}
    assert in_levels(Family(spark, at)) == {"a", "b"}
