"""What each stage of the pipeline gives, texts and digests included, against plain Python over the stage's own input."""

from __future__ import annotations

import random
from collections import Counter

import duckdb
import numpy as np
import tiktoken

import corpus_pipeline
from tallyforge.llm import bpe, mixing, quality
from tests.llm.cases import BLANK, prose, saved, sha, words
from tests.llm.test_corpus_operators import brute_components, brute_lines


def made():
    rng = random.Random(21)
    line = lambda n: prose(rng, n).replace("\n", " ")
    footers = [line(12) for _ in range(3)]
    rows = [(2 * i, "\n".join([*(line(30) for _ in range(5)), footers[i % 3]]), f"s{i % 5 % 3}") for i in range(30)]
    for k in range(4):  # the words of other documents on lines of other lengths: no line is alike, the document is
        w = words(rows[k][1])
        rows.append((500 + 2 * k, "\n".join(" ".join(w[i : i + 47]) for i in range(0, len(w), 47)), "s1"))
    rows.append((600, rows[7][1], "s2"))  # a copy
    rows.append((602, rows[8][1].replace(" ", "  ", 4) + "\n" + line(60), "s2"))  # most of another, and more
    junk = [(2 * i + 1, " ".join(f"zz{rng.randint(0, 300)}$$" for _ in range(200)), "s1") for i in range(8)]
    return rows, [*junk, (701, None, None), (703, "", "s1"), (705, line(20), None)]


def told(rows):
    return sorted(repr(r) for r in rows)


def test_every_stage_against_plain_python(spark, tmp_path):
    good, bad = made()
    at = saved(spark, [*good, *bad], tmp_path)
    docs = spark.read.parquet(f"{at}/documents.parquet")
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, at).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        got[name] = docs.collect()
    rows = {name: [(r.doc_id, r.text, r.source) for r in found] for name, found in got.items() if name != "encode"}

    assert told(rows["quality_rules"]) == told(good)

    gone = brute_lines(rows["quality_rules"])
    want = []
    for i, t, s in rows["quality_rules"]:
        left = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i, t])
        if not gone[i, t] or (left.strip(BLANK) and len(words(left)) >= quality.LEAST_WORDS):
            want.append((i, left, s))
    assert told(rows["line_dedup"]) == told(want) and len(want) < len(good)
    assert all(r.n_chars == len(r.text) for r in got["line_dedup"])

    firsts = {c for _, _, c in brute_components(rows["line_dedup"], 5)}
    assert told(rows["near_dedup"]) == told(r for r in rows["line_dedup"] if r[0] in firsts)
    assert len(rows["line_dedup"]) - len(rows["near_dedup"]) == 4  # those on other lines

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/near_dedup/*.parquet'")
    times = Counter(i for i, *_ in con.execute(mixing.ORACLE).fetchall())
    assert told(rows["mix_sources"]) == told(r for r in rows["near_dedup"] for _ in range(times[r[0]])) and max(times.values()) == 2

    ranks, pattern = bpe.vocabulary()
    coder = tiktoken.Encoding("test", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    coded = [(i, coder.encode_ordinary(t), t) for i, t, _ in rows["mix_sources"]]
    want = told((i, len(x), sha(np.array(x, "<u4").tobytes()), sha(t.encode())) for i, x, t in coded)
    assert told(tuple(r) for r in got["encode"]) == want
    assert told(tuple(r) for r in corpus_pipeline.run(spark, at).collect()) == want
