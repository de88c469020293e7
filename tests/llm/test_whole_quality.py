"""Quality scores where trusted text is scarce, and the threshold."""

from __future__ import annotations

import math
import random

from tallyforge.llm import quality
from tests.llm.cases import frame


def test_clean_prose_is_kept_where_trusted_text_is_scarce(spark):
    rng = random.Random(5)
    known = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(400)]
    clean = [(i, " ".join(rng.choice(known) for _ in range(150)), None) for i in range(80)]
    junk = [(100 + i, " ".join(f"zz{rng.randint(0, 60)}$$" for _ in range(150)), None) for i in range(12)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(8)] + [(100 + i, 0, 0) for i in range(4)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in quality.assessed(frame(spark, clean + junk), labels).collect()}
    assert not any(r.base_failed for r in got.values())
    assert {i for i, r in got.items() if r.kept} == {i for i, _, _ in clean}
    # Trusted documents have no better scores than others of their kind: they don't score themselves.
    mean = lambda ids: sum(got[i].llr for i in ids) / len(ids)
    assert abs(mean(range(8)) - mean(range(8, 80))) < 0.05


def test_plans_hold_no_table(spark):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = quality.assessed(frame(spark, [(i, f"some words of text {i} " * 20, None) for i in range(4)]), labels, threshold=0.0)
    assert len(got._jdf.queryExecution().toString()) < 100_000
    assert {r.doc_id for r in got.collect() if r.llr != 0} == {0, 2, 3}  # the one trusted document has no other to be scored by


def test_parting():
    assert quality.parting([1.0, 2.0, 3.0], [-1.0, 0.0]) == 0.5
    assert quality.parting([1.0, 2.0, 3.0, 4.0], [0.0, 1.5]) == 1.75
    assert quality.parting([1.0, 2.0], []) == 1.0 and quality.parting([], [1.0]) == -math.inf == quality.parting([], [])
