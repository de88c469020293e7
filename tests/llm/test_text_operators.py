"""Winnowing, BPE, separator scan, personal data and quality rules against plain Python."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import random

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import bpe, pii, quality, token_counts, winnowing
from tests.llm.cases import DOCS, awkward, frame, saved, sha, words


@pytest.fixture(scope="module")
def rows():
    return awkward()


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))


# Winnowing


def brute_winnow(text, k, w):
    """All minima of windows by their definition, on the operator's own gram hashes."""
    n = len(text) - k + 1
    if n < 1:
        return None
    grams = {}
    h = [grams.setdefault(text[i : i + k], int(winnowing.winnow(text[i : i + k], k, 1)["hash"][0])) for i in range(n)]
    w = min(w, n)
    return sorted({max((s + j for j in range(w)), key=lambda i: (-h[i], i)) for s in range(n - w + 1)}), h


@pytest.mark.parametrize("text", ["abcdefgh" * 9, "a" * 50, "the quick brown fox jumps over the lazy dog", "éßü" * 20, "abcd"])
def test_winnow_picks_rightmost_minima(text):
    fp = winnowing.winnow(text, 4, 5)
    places, h = brute_winnow(text, 4, 5)
    assert fp["pos"].tolist() == places and fp["hash"].tolist() == [h[i] for i in places]


def test_winnow_short_long_and_guarantee():
    assert len(winnowing.winnow("")) == 0 and len(winnowing.winnow("ab")) == 1
    assert winnowing.winnow("ab")["hash"][0] != winnowing.winnow("ba")["hash"][0]
    rng = np.random.default_rng(3)
    random = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    shared = random(winnowing.K + winnowing.W - 1)
    long = random((1 << 20) + 500) + shared + random(900)  # more than one segment
    a, b = winnowing.winnow(long), winnowing.winnow(random(70) + shared + random(80))
    assert len(np.intersect1d(a["hash"], b["hash"])) and (np.diff(a["pos"].astype(np.int64)) > 0).all() and np.diff(a["pos"].astype(np.int64)).max() <= winnowing.W
    assert (winnowing.unpacked(winnowing.packed(a)) == a).all()


def test_edit_report(spark, rows):
    got = winnowing.edit_report(frame(spark, rows), blocks=5).collect()
    want = []
    order = ordered(rows)
    for (i, t, _), (_, u, _) in zip(order, order[1:] + order[:1], strict=True):
        t, u = t or "", u or ""
        q = len(t) // 4
        e = t[: len(t) - q] + u[:q]
        sets = [set(winnowing.winnow(x)["hash"].tolist()) for x in (t, e, u)]
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        want.append((i, len(t), sha(e.encode()), winnowing.packed(winnowing.winnow(t)), winnowing.packed(winnowing.winnow(e)), like(sets[0], sets[1]), like(sets[0], sets[2])))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_edit_report_of_few_rows(spark):
    assert winnowing.edit_report(frame(spark, [])).isEmpty()
    one = winnowing.edit_report(frame(spark, [(1, "abcdefgh", None)])).first()
    assert one.edited_sha256 == sha(b"abcdefab") and one.near_next == 1.0


def test_fingerprints_keep_columns(spark, rows):
    got = winnowing.fingerprints(frame(spark, rows))
    assert got.columns == [c for c in frame(spark, rows).columns if c != "fingerprint"] + ["fingerprint"]
    for r in got.select("text", "fingerprint").collect():
        assert [(x.hash, x.pos) for x in r.fingerprint] == [tuple(map(int, x)) for x in winnowing.winnow(r.text or "")]


# Byte-level BPE and the separator scan


@pytest.fixture(scope="module")
def coder():
    import tiktoken

    ranks, pattern = bpe.vocabulary()
    return tiktoken.Encoding("test", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


ODD = [(900 + i, t, None) for i, t in enumerate(["\x1c a\x85b\xa0 c   \n\n  d", "it's I'LL we'll 's", "<|endoftext|> x", "١٢٣ ½ Ⅷ 漢字かな", "a​b 　  z ", "\U0001d54f\U0001f468‍\U0001f469 é", "  \t\r\n \r\n"])]


def test_bpe_matches_the_library(spark, rows, coder):
    rows = rows + ODD
    docs = frame(spark, rows)
    got = sorted((r.doc_id or 0, list(r.ids)) for r in bpe.encode(docs).collect())
    assert got == sorted((i or 0, coder.encode_ordinary(t or "")) for i, t, _ in rows)
    digests = sorted(map(repr, map(tuple, bpe.encode(docs, digests=True).collect())))
    ids = [(i, t or "", coder.encode_ordinary(t or "")) for i, t, _ in rows]
    assert digests == sorted(repr((i, len(x), sha(np.array(x, "<u4").tobytes()), sha(t.encode()))) for i, t, x in ids)
    assert bpe.encode(frame(spark, [])).isEmpty()


def test_bpe_over_several_blocks_and_chunks(spark, rows, coder, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 2_000)
    monkeypatch.setattr(bpe, "CHUNK_WORDS", 50)
    run = bpe._blocks(spark.sparkContext.broadcast(bpe.vocabulary()), 4)
    import pyarrow as pa
    import pyspark

    monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda cls: type("T", (), {"partitionId": lambda self: 3})()))
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows])], ["doc_id", "text"])
    out = pa.Table.from_batches(run(iter([batch]))).to_pylist()
    assert len({r["block"] for r in out}) > 3
    assert sum(len(r["doc_ids"]) for r in out if r["kind"] == "text") == len(rows)
    for block in {r["block"] for r in out}:  # a block's words are distinct, and its sequences stay within them
        words_ = [w for r in out if r["block"] == block and r["kind"] == "word" for w in [bpe._unpacked(r["data"])[0]]]
        n = sum(map(len, words_))
        assert all(len(s) == 0 or s.max() < n for r in out if r["block"] == block and r["kind"] == "text" for s in [bpe._unpacked(r["data"])[1]])


def test_decode(spark):
    coded = spark.createDataFrame([(1, [464, 3290]), (2, []), (3, None)], "k int, ids array<int>")
    assert {r.k: None if r.decoded is None else bytes(r.decoded) for r in bpe.decode(coded).collect()} == {1: b"The dog", 2: b"", 3: None}
    with pytest.raises(Exception, match="outside"):
        bpe.decode(spark.createDataFrame([([60_000],)], "ids array<int>")).collect()


def test_token_counts(spark, rows, coder):
    rows = rows + ODD
    got = sorted((r.doc_id or 0, r.n_tokens) for r in token_counts.counted(frame(spark, rows)).collect())
    assert got == sorted((i or 0, len(coder.encode_ordinary(t or ""))) for i, t, _ in rows)
    assert token_counts.counted(frame(spark, [])).isEmpty()


def test_token_folders_by_the_names_of_either_file_system():
    named = {"s3a://b/k/s3a://x": "s3://b/k/s3a://x", "S3N://b": "s3://b", "s3://b/k": "s3://b/k", "hdfs://host:9000/a": "hdfs://host:9000/a", "gs://b/k": "gs://b/k", "file:///tmp/s3a": "file:///tmp/s3a", "/tmp/a": "/tmp/a"}
    assert {k: token_counts.arrow_uri(k) for k in named} == named


@pytest.mark.parametrize("block", [1, 2, 3, 5, 64])
def test_separator_scan_at_every_block_size(spark, tmp_path, block):
    cases = {"a": [1, 2, 9, 9, 3, 9], "b": [9], "c": [4, 4, 4, 4, 4, 4, 4], "d": [9, 5, 5, 5, 5, 5, 9, 6], "e": []}
    for name, ids in cases.items():
        np.array(ids, "<u2").tofile(tmp_path / name)
    files = spark.createDataFrame([(n, len(x)) for n, x in cases.items()], "file string, tokens bigint")
    got = sorted(map(tuple, token_counts.count_tokens(files, f"file://{tmp_path}", 9, block=block).collect()))
    want = []
    for name, ids in cases.items():
        parts = " ".join(map(str, ids)).split("9") if ids else []
        sizes = [len(p.split()) for p in parts]
        want += [(name, i, n, True) for i, n in enumerate(sizes[:-1])] + ([(name, len(sizes) - 1, sizes[-1], False)] if sizes and sizes[-1] else [])
    assert got == sorted(want)


# Personal data


def luhn(d):
    return sum(v if i % 2 == 0 else 2 * v - 9 * (v > 4) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for rank, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def pii_rows():
    import random

    rng = random.Random(5)
    bits = [*"abZ019.@-+ ()%_\n", "1.2.3.4", "a@b.c", "4111 1111 1111 1111", "+1 (017) 555-7713", "\U0001f600", "", "call ", "256.1.1.1", "0001.2.3.4"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(600)]
    texts += [None, "", "1" * 5000, "1 " * 20_000, "a" * 100_000 + "@", "a.b@" * 3000, "1." * 20_000, "+1 " + "2 " * 3000, "a@b.c" * 500]
    return [(i, t, None) for i, t in enumerate(texts)]


def test_base_spans(spark, tmp_path):
    rows = pii_rows()
    for r in pii.query(spark, saved(spark, rows, tmp_path)).collect():
        want = base_spans(rows[r.doc_id][1])
        assert r.base_sha256 == sha(",".join(want).encode())
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k + ":") for x in want) for k in PATTERNS]
        assert set(want) <= set(r.spans.split(",")) | {""}


def test_further_kinds_need_a_checksum_or_context(spark):
    texts = {"My IBAN is DE89 3704 0044 0532 0130 00 ok": ["iban"], "DE89 3704 0044 0532 0130 01": [], "ssn 123-45-6789": ["ssn"], "item 123-45-6789 left": [], "ssn 000-45-6789": [], "call (212) 555-0100 now": ["local_phone"], "code 212-555-0100": [], 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"': ["secret"], "commit 04dbebab91ab85687d33eeaaf9ac699e1188f962": [], "call +1 (212) 555-0100": ["phone"]}
    rows = [(i, t, None) for i, t in enumerate(texts)]
    got = {r.doc_id: [x.kind for x in r.pii] for r in pii.found(frame(spark, rows)).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())
    scores = {r.doc_id: r.pii[0].score for r in pii.found(frame(spark, [(1, "card 4111111111111111", None), (2, "4111111111111111", None)])).collect()}
    assert scores[1] > scores[2]
    assert pii.masked(frame(spark, [(1, "to a@b.co and 1.2.3.4!", None)])).first().text == "to <email> and <ip>!"
    assert pii.found(frame(spark, [])).isEmpty()


# Quality rules


def brute_quality(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    triples = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = Counter(triples)
    covered = {j for i, t in enumerate(triples) if many[t] > 1 for j in range(i, i + 3)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed


def test_quality_statistics_and_scores(spark, rows, tmp_path):
    import math

    import xxhash

    at = saved(spark, rows, tmp_path)
    got = quality.query(spark, at).collect()
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    chained = lambda h, x: xxhash.xxh64_intdigest(x.to_bytes(8, "little"), h)

    def bins(w):
        one = [xxhash.xxh64_intdigest(x.encode(), 42) for x in w]
        return [signed(h) % quality.BINS for h in one + [chained(chained(42, a), b) for a, b in zip(one, one[1:], strict=False)]]

    def fold(i):
        return signed(xxhash.xxh64_intdigest(quality.FOLDS.to_bytes(4, "little"), chained(42, i))) % quality.FOLDS + 1

    good, every = [Counter() for _ in range(quality.FOLDS + 1)], Counter()
    for i, t, _ in rows:
        own = Counter(bins(words(t)))
        every += own
        for k in range(quality.FOLDS + 1):
            if i is not None and i % 2 == 0 and fold(i) != k:
                good[k] += own
    n, totals = sum(every.values()), [sum(g.values()) for g in good]

    def score(i, w):
        k = fold(i) if i is not None and i % 2 == 0 else 0
        return sum(math.log((good[k][b] + 1) / (totals[k] * every[b] / n + 1)) for b in bins(w)) / (2 * len(w) - 1) if w else 0.0

    # Rows of one doc_id are told apart by their statistics.
    key = lambda r: (str(r[0]), r[1], r[2], r[3])
    want = sorted(((i, *brute_quality(t), score(i, words(t))) for i, t, _ in rows), key=key)
    least = min(x[7] for x in want if x[0] is not None and x[0] % 2 == 0 and x[1] >= quality.LEAST_WORDS)
    for r, x in zip(sorted((tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")) for r in got), key=key), want, strict=True):
        assert r[:7] == x[:7] and r[7] == pytest.approx(x[7], abs=1e-9)
        assert r[8] == (not x[6] and r[7] >= least - 1e-9)


def test_repeated_windows_are_told_by_their_words(spark):
    rng = random.Random(14)
    texts = [" ".join(rng.choice("abc") for _ in range(k)) for k in (1, 2, 3, 4, 5, 9, 40, 200)]
    long = [f"w{i}" for i in range(300_000)]
    long[200_000:200_003] = long[7:10]
    docs = spark.createDataFrame([(t, brute_quality(t)[4]) for t in texts] + [(" ".join(long), 6)], "text string, want bigint")
    split, hashes = quality.words_of(F.col("text")), lambda w: F.transform(w, lambda x: F.xxhash64(x))
    for most in (1, 3, 1 << 62):  # windows of few hashes, so that unlike ones meet
        some = docs if most > 3 else docs.filter("length(text) < 1000")
        windows = F.transform(quality._runs(hashes(split), 3), lambda x: F.pmod(x, F.lit(most)))  # noqa: B023
        assert some.select(quality.repeat_words(split, windows).alias("n"), "want").filter("n <> want").collect() == []


def test_quality_without_labels_and_rows(spark, rows):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = quality.assessed(frame(spark, rows), none)
    assert [c for c in DOCS.replace(",", "").split()[::2] if c not in ("n_words", "kept")] == got.columns[: -len(quality._NAMES)]
    assert {r.llr for r in got.collect()} == {0.0}
    assert quality.assessed(frame(spark, []), none).isEmpty()


def test_junk_scores_below_prose(spark):
    import random

    from tests.llm.cases import prose

    rng = random.Random(2)
    good = [(2 * i, prose(rng, 200), None) for i in range(60)]
    junk = [(2 * i + 1, " ".join(f"zz{rng.randint(0, 400)}$$" for _ in range(200)), None) for i in range(15)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in good[:40]], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r.llr for r in quality.assessed(frame(spark, good + junk), labels).collect()}
    assert min(got[i] for i, _, _ in good) > max(got[i] for i, _, _ in junk)
