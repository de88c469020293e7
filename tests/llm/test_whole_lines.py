"""Fuzzy lines: what is compared, against plain Python."""

from __future__ import annotations

import random
from collections import defaultdict

from tallyforge.llm import lines
from tests.llm.test_corpus_operators import own
from tests.llm.cases import BLANK, LOWER, awkward, frame, union_find


def kept(spark, texts, **options):
    got = lines.deduplicated(frame(spark, [(i, t, None) for i, t in enumerate(texts)]), least_words=0, **options)
    return [r.text for r in got.orderBy("doc_id").collect()]


def test_lines_are_compared_without_case(spark):
    texts = ["Subscribe to our newsletter", "SUBSCRIBE TO OUR NEWSLETTER", "short\nSHORT \nÉTÉ", "\tSubscribe To Our Newsletter\nété\nother"]
    assert kept(spark, texts) == ["Subscribe to our newsletter", "", "short\nÉTÉ", "été\nother"]  # A-Z only


def test_shingles_are_code_points(spark):
    rng = random.Random(8)
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(60)).replace(" ", "k")
    cases = [long, "".join(rng.choice("абвгдежзиклмнопрст") for _ in range(60)), "".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(60))]
    for text in cases:
        changed = text[:30] + "#" + text[31:]  # 51 of 61 five-point shingles are common; of 8 bytes, fewer than 0.8
        assert len(lines.shingles(text)) == 56
        assert kept(spark, [text, changed]) == [text, ""]
    assert kept(spark, [long, long[:25] + "##" + long[27:40] + "##" + long[42:]]) == [long, long[:25] + "##" + long[27:40] + "##" + long[42:]]


def brute(rows):
    """Places of the lines that go, by doc_id and text: five code points a shingle, A-Z as a-z."""
    all_ = [(i, t, k, x.strip(BLANK).translate(LOWER)) for i, t, _ in rows for k, x in enumerate((t or "").split("\n")) if x.strip(BLANK)]
    distinct = sorted({x for *_, x in all_})
    sets = [frozenset(x[i : i + 5] for i in range(max(1, len(x) - 4))) for x in distinct]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    root = union_find(pairs, range(len(sets)))
    of = {x: root[i] for i, x in enumerate(distinct)}
    place = lambda i, t, k: (i is not None, i or 0, own(t), k)
    first, gone = {}, defaultdict(set)
    for i, t, k, x in all_:
        first[of[x]] = min(first.get(of[x], place(i, t, k)), place(i, t, k))
    for i, t, k, x in all_:
        if place(i, t, k) != first[of[x]]:
            gone[i, t].add(k)
    return gone


def test_lines_of_awkward_rows_by_code_points(spark):
    rows = awkward()
    got = lines.deduplicated(frame(spark, rows), least_words=0).collect()
    gone = brute(rows)
    left = lambda i, t: t if t is None or not gone[i, t] else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i, t])
    assert sorted(repr((r.doc_id, r.text)) for r in got) == sorted(repr((i, left(i, t))) for i, t, _ in rows)
