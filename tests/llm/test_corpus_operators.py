"""Suffix levels, near duplicates, line dedup, sharding, mixing and the pipeline against plain Python."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from tallyforge.llm import lines, minhash, mixing, near, sharding, suffixes
from tests.llm.cases import BLANK, LOWER, awkward, frame, prose, saved, sha, union_find, words


@pytest.fixture(scope="module")
def rows():
    return awkward()


# Suffix-array levels


def brute_removed(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raws for i in range(len(b) - length + 1))
    out = []
    for b in raws:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        gone = gone[:-1]
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, sha(np.frombuffer(b, np.uint8)[~gone].tobytes())))
    return out


def repeats():
    rng = random.Random(3)
    base = "".join(rng.choice("abcd efgé") for _ in range(3000))
    texts = [None, "", "a" * 1000, "ab" * 700, base, base, base[:500] + "X" + base[501:900], "x" * 199, "é" * 150, base[100:350] + "q" * 300 + base[2000:2250], "z" * 200]
    return [(i, t, None) for i, t in enumerate(texts + [base[k : k + 230] + str(k) * 100 for k in range(0, 600, 29)])]


@pytest.mark.parametrize("options", [{"batches": 5}, {"batches": 1}, {"batches": 2, "gram": 48}])
def test_removed_bytes(spark, options):
    made = repeats()
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.removed(frame(spark, made), **options).collect()}
    assert got == dict(enumerate(brute_removed([t for _, t, _ in made], 200)))


def test_removed_of_awkward_rows(spark, rows):
    got = sorted(map(repr, (tuple(r) for r in suffixes.removed(frame(spark, rows), length=60, gram=24).collect())))
    assert got == sorted(repr((r[0], *x)) for r, x in zip(rows, brute_removed([r[1] for r in rows], 60), strict=True))
    assert suffixes.removed(frame(spark, [])).isEmpty()
    kept = suffixes.removed(frame(spark, [(1, "q" * 400, None)]), texts=True).first()
    assert bytes(kept.kept) == b"" and kept.n_removed == 400


def test_anchors_own_every_window():
    raw = np.frombuffer((prose(random.Random(1), 900) + "a" * 700).encode(), np.uint8)
    at, start, n = suffixes.anchors(raw, suffixes._sums(raw)[0])
    assert start[0] == 0 and (start[1:] == start[:-1] + n[:-1]).all() and start[-1] + n[-1] == len(raw) - 199
    assert (at >= start + n - 1).all() and (at + suffixes.GRAM <= start + 200).all()


# Near duplicates


def shingle_set(text, n):
    w = [x.translate(LOWER) for x in words(text)]
    return frozenset() if not w else frozenset([tuple(w)]) if len(w) < n else frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def brute_components(rows, n, percent=80):
    sets = [shingle_set(t, n) for _, t, _ in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    root = union_find(pairs, range(len(rows)))
    least = defaultdict(list)
    for i, r in root.items():
        if rows[i][0] is not None:
            least[r].append(rows[i][0])
    return [(rows[i][0], len(sets[i]), min(least[root[i]], default=None)) for i in range(len(rows))]


def family(seed=4):
    """Copies of one text with ever more words changed: links form chains that no single member spans."""
    rng = random.Random(seed)
    base = prose(rng, 300).split()
    out = []
    for i in range(60):
        w = list(base)
        for k in range(rng.randint(0, 22)):
            w[rng.randrange(len(w))] = f"new{i}x{k}"
        out.append((i, " ".join(w), None))
    return out


@pytest.mark.parametrize("n", [2, 5])
def test_components(spark, rows, n, monkeypatch):
    if n == 2:  # as with large tables
        monkeypatch.setattr(near, "AT_ONCE", 50)
        monkeypatch.setattr(near, "BLOCK", 8)
        monkeypatch.setattr(near, "EDGES", 5)
        monkeypatch.setattr(near, "ENTRIES", 100)
    for case in (rows, family()):
        got = minhash.clustered(frame(spark, case), words=n).collect()
        want = brute_components(case, n)
        assert sorted(repr(tuple(r)[:3]) for r in got) == sorted(map(repr, want))
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert minhash.clustered(frame(spark, [])).isEmpty()


def test_large_group_of_near_copies(spark):
    """More members than the medoid round's limit, with the base last: stars of the first member alone don't join it."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(400)]
    made = []
    for i in range(150):
        w = list(base)
        for k in rng.sample(range(400), 17):
            w[k] = f"n{i}x{k}"
        made.append((i, " ".join(w), None))
    made.append((150, " ".join(base), None))
    got = minhash.clustered(frame(spark, made), words=2).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted((i, c) for i, _, c in brute_components(made, 2))


def test_word_hashes_and_signatures():
    assert (minhash.word_hashes("The  CAT\tsat") == minhash.word_hashes("the cat\nsat ")).all()
    assert len(minhash.word_hashes("É x")) == 2 and minhash.word_hashes("É")[0] != minhash.word_hashes("é")[0]
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[400:2400])
    sig = near.signatures([a, b], 2000)
    assert abs((sig[0] == sig[1]).mean() - 1600 / 2400) < 0.05


def test_sequential_test_keeps_similar_pairs():
    assert near.least_matches(240, 0.8, 1e-7) < 0.8 * 240 - 30 and near.least_matches(20, 0.8, 1e-7) > 0
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 16, (4000, 240), np.uint16)
    for share, keeps in ((0.8, 1.0), (0.3, 0.0)):
        b = np.where(rng.random(a.shape) < share, a, a ^ 1)
        assert len(near.survivors(a, b, threshold=0.8, miss=1e-7)) / 4000 == keeps


def test_union_find(spark, monkeypatch):
    rng = random.Random(6)
    pairs = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 200)] + [(rng.randint(400, 500), rng.randint(400, 500)) for _ in range(80)]
    edges = spark.createDataFrame(pairs, "x bigint, y bigint").repartition(5)
    want = union_find(pairs, {n for p in pairs for n in p})
    want = {n: r for n, r in want.items() if sum(v == r for v in want.values()) > 1}
    for most in (3, 1000):  # nodes that a task holds
        monkeypatch.setattr(near, "EDGES", most)
        assert {r.id: r.root for r in near.components(edges).collect()} == want
    assert near.components(edges.limit(0)).isEmpty()


# Lines


def own(text):
    """A text's hash as Spark has it, which orders texts of one id."""
    x = xxhash.xxh64_intdigest((text or "").encode(), seed=42)
    return x - (1 << 64) if x >> 63 else x


def brute_lines(rows):
    """Places of the lines that go, by doc_id and text. Five code points, A-Z as a-z."""
    all_ = [(i, t, k, x.strip(BLANK)) for i, t, _ in rows for k, x in enumerate((t or "").split("\n")) if x.strip(BLANK)]

    def grams(x):
        x = x.translate(LOWER)
        return frozenset([x]) if len(x) < 5 else frozenset(x[i : i + 5] for i in range(len(x) - 4))

    distinct = sorted({x for *_, x in all_})
    sets = [grams(x) for x in distinct]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if min(len(sets[i]), len(sets[j])) * 10 >= 8 * max(len(sets[i]), len(sets[j])) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    root = union_find(pairs, range(len(sets)))
    of = {x: root[i] for i, x in enumerate(distinct)}
    place = lambda i, t, k: (i is not None, i or 0, own(t), k)
    first = {}
    for i, t, k, x in all_:
        first[of[x]] = min(first.get(of[x], place(i, t, k)), place(i, t, k))
    gone = defaultdict(set)
    for i, t, k, x in all_:
        if place(i, t, k) != first[of[x]]:
            gone[i, t].add(k)
    return gone


def line_rows():
    rng = random.Random(9)
    some = [prose(rng, 25).replace("\n", " ") for _ in range(12)]
    near_ = [x[:30] + "zz" + x[32:] for x in some]
    rows = [(i, "\n".join(rng.choice([*some, *near_, "", " ", "}", prose(rng, 12).replace("\n", " ")]) for _ in range(rng.randint(1, 8))), None) for i in range(40)]
    return [*rows, (50, None, None), (51, "", None), (52, rows[0][1], None), (None, rows[1][1], None), (53, "short\nshort\nSHORT ", None)]


def test_lines(spark, tmp_path):
    made = line_rows()
    gone = brute_lines(made)
    kept = lambda i, t: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i, t])
    want = [(i, t if t is None or not gone[i, t] else kept(i, t)) for i, t, _ in made]
    want = [(i, t) for (i, t), (_, was, _) in zip(want, made, strict=True) if t == was or t.strip(BLANK)]
    docs = frame(spark, made)
    got = lines.deduplicated(docs)
    assert got.columns == docs.columns
    assert sorted(repr((r.doc_id, r.text)) for r in got.collect()) == sorted(map(repr, want))
    told = sorted(repr(tuple(r)) for r in lines.query(spark, saved(spark, made, tmp_path)).collect())
    full = {(i, t): t if t is None or not gone[i, t] else kept(i, t) for i, t, _ in made}
    left = lambda t: sum(bool(x.strip(BLANK)) for x in (t or "").split("\n"))
    assert told == sorted(repr((i, left(full[i, t]), len(gone[i, t]), ",".join(map(str, sorted(gone[i, t]))), sha((full[i, t] or "").encode()))) for i, t, _ in made)
    assert lines.deduplicated(frame(spark, [])).isEmpty()


def test_lines_are_hashed_alike_together_and_alone():
    texts = [prose(random.Random(k), 1 + k % 40).replace("\n", " ") for k in range(60)] + ["12345678", "é" * 4, "x" * 70_000]
    raw = [t.encode() for t in texts if len(t) >= 5]
    got = [x for flat, starts in lines._sets(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])) for x in np.split(flat, starts[1:])]
    assert len(got) == len(raw) and all((a == lines._windows(b)).all() for a, b in zip(got, raw, strict=True))


def test_lines_of_awkward_rows(spark, rows):
    got = lines.deduplicated(frame(spark, rows), least_words=0).collect()
    gone = brute_lines(rows)
    kept = lambda i, t: t if t is None or not gone[i, t] else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i, t])
    assert sorted(repr((r.doc_id, r.text)) for r in got) == sorted(repr((i, kept(i, t))) for i, t, _ in rows)


def test_rows_of_one_id_lose_only_their_own_lines(spark):
    footer, a, b = "the same footer under all of them", "a line that only one text has", "another line of one text alone"
    for i in (None, 5):
        rows = [(i, f"first text of all\n{footer}", None), (i, f"{a}\n{footer}", None), (i, f"{footer}\n{b}", None)]
        got = lines.deduplicated(frame(spark, rows)).collect()
        left = sorted(x for r in got for x in r.text.split("\n"))
        assert left == sorted(["first text of all", a, b, footer])


def test_shingles_of_many_lines_at_once():
    rng = random.Random(5)
    texts = ["x", "abcd", "abcde", "aaaaaaaaaa", "ÄÖÜßé" * 3, "😀 AbC" * 4] + ["".join(rng.choice("abc dÉ") for _ in range(rng.randrange(1, 900))) for _ in range(300)]
    got = lines.many_shingles(pa.array(texts))
    for text, own in zip(texts, got, strict=True):
        low = "".join(c.lower() if c.isascii() else c for c in text)
        assert (own == lines.shingles(text)).all() and len(own) == len({low[i : i + 5] for i in range(max(1, len(low) - 4))})
    assert [near.common(a, b) for a, b in itertools.pairwise(got)] == [len(set(a.tolist()) & set(b.tolist())) for a, b in itertools.pairwise(got)]
    assert lines.many_shingles(pa.array([], pa.string())) == []


def test_small_groups_are_pairs_and_large_ones_cells(spark, monkeypatch):
    """Same classes however small a group has to be for its pairs to be tried one by one; with small ones as pairs, no cell is made."""
    rng = random.Random(11)
    stems = ["".join(rng.choice("abcdefgh ") for _ in range(70)) for _ in range(6)]
    near_copies = [stem[:at] + "#" + stem[at + 1 :] for stem in stems for at in rng.sample(range(70), 7)]
    docs = frame(spark, [(i, t, None) for i, t in enumerate(near_copies)])
    cells, seen = near.Linker._cells, []
    monkeypatch.setattr(near.Linker, "_cells", lambda self, rows: (seen.append(rows.count()), cells(self, rows))[1])
    found = {}
    for few in (2, 16):
        monkeypatch.setattr(near, "FEW", few)
        found[few] = sorted((r.doc_id, tuple(r.removed)) for r in lines.removed(lines.places(docs)).collect())
    assert found[2] == found[16] and len(found[2]) > 6 and seen[1] == 0
    rows = spark.createDataFrame([(1, 4, 4), (1, 2, 9), (1, 3, 9), (2, 3, 9), (2, 4, 4), (3, 7, 7), (3, 5, 6)], "g bigint, no bigint, label bigint")
    assert sorted(map(tuple, near.Linker._pairs(None, rows).collect())) == [(2, 4), (3, 4), (5, 7)]


def test_remainders_of_few_words_go(spark):
    same = "these five words are common"
    rows = [(1, f"{same}\none two three", None), (2, f"{same}\nfour five six", None), (3, "seven", None), (4, f"{same}\nw1 w2 w3 w4 w5", None)]
    assert sorted(r.doc_id for r in lines.deduplicated(frame(spark, rows), least_words=4).collect()) == [1, 3, 4]


# Sharding


@pytest.mark.parametrize("limit", [500, 3000, 1 << 20])
def test_shards(spark, rows, limit):
    got = sharding.assigned(frame(spark, rows), limit=limit).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    for name, own in by.items():
        total = sum(r.n_bytes for r in own)
        assert {(r.shard_bytes, r.depth, r.fits) for r in own} == {(total, len(name), total <= limit)}
        # Splitting was needed: the parent is over the limit. What doesn't fit can't be split.
        assert not name or sum(r.n_bytes for r in got if r.shard.startswith(name[:-1])) > limit
        assert total <= limit or len({r.doc_id for r in own}) == 1
    assert sorted(r.n_bytes for r in got) == sorted(len((t or "").encode()) for _, t, _ in rows)
    assert sharding.assigned(frame(spark, []), limit=limit).isEmpty()


@pytest.mark.parametrize("limit", [700, 1 << 20])
def test_shards_match_sql(spark, rows, limit):
    con = duckdb.connect()
    documents = frame(spark, rows).select("doc_id", "text").toPandas()  # noqa: F841
    con.execute("CREATE TABLE documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text FROM documents")
    want = con.execute(sharding.ORACLE.replace(str(sharding.LIMIT), str(limit))).fetchall()
    got = sharding.assigned(frame(spark, rows), limit=limit).select("doc_id", "n_bytes", "shard", "depth", "shard_bytes", "fits").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


@pytest.mark.parametrize("top", [-1, 3])
def test_prefixes_of_runs_of_cells(spark, monkeypatch, top):
    """Sums over three levels of runs; all cells of one half are sparse, so that shards of every depth occur."""
    rng, depth, limit, kept = random.Random(top), 20, 400, {}
    cells = {rng.randrange(1 << 19): rng.randrange(1, 200) for _ in range(300)} | {1 << 19 | c: rng.choice([1, 50, 500]) for c in range(700)}
    sums = defaultdict(int)
    for c, n in cells.items():
        for d in range(depth + 1):
            sums[d, c >> depth - d] += n
    monkeypatch.setattr(sharding, "STEP", 6)
    got = sharding._settled(spark.createDataFrame(list(cells.items()), "cell bigint, n bigint"), depth, top, limit).collect()
    want = {c: next(((d, c >> depth - d, sums[d, c >> depth - d]) for d in range(top + 1, depth + 1) if sums[d, c >> depth - d] <= limit), None) for c in cells}
    assert len(got) == len(cells) and {r.cell: r.own and tuple(r.own) for r in got} == want and len({w and w[0] for w in want.values()}) > 6
    # A cell stays one row: it was copied to each of its prefixes before.
    written = sharding.written
    monkeypatch.setattr(sharding, "written", lambda df, name: (kept.setdefault(name, df), written(df, name))[1])
    sharding.directory(spark.createDataFrame([(c << 40, n) for c, n in cells.items()], "hash bigint, n_bytes bigint"), limit=limit)
    assert "explode" not in kept["shard-map"]._jdf.queryExecution().analyzed().toString()


# Mixing


def weights(shares, a):
    z = sum(x**a for x in shares.values() if x)
    return {s: x**a / z if x else 0.0 for s, x in shares.items()}


def entropy_of(w):
    return -sum(x * math.log(x) for x in w.values() if x)


def test_exponent(spark):
    n = {"a": 900_000, "b": 40_000, "c": 10_000}
    sources = spark.createDataFrame(list(n.items()), "source string, n bigint")
    a = mixing.exponent(sources, repetitions=2.0)
    w = weights(n, a)
    budget = max(n[s] / w[s] for s in n)
    assert max(w[s] * budget / n[s] for s in n) == pytest.approx(2.0, rel=1e-6) and 0 < a < 1
    a = mixing.exponent(sources, entropy=0.7, repetitions=None)
    assert entropy_of(weights(n, a)) == pytest.approx(0.7, rel=1e-6)
    a = mixing.exponent(sources, evenness=0.25, repetitions=None)
    assert entropy_of(weights(n, a)) == pytest.approx(0.75 * entropy_of(weights(n, 1)) + 0.25 * math.log(3), rel=1e-6)
    assert mixing.exponent(sources, evenness=0.25, repetitions=1.2) > a
    assert mixing.exponent(sources, entropy=9.0, repetitions=None) == 0.0 and mixing.exponent(sources, repetitions=0.5, budget=1e6) == 1.0
    assert mixing.exponent(spark.createDataFrame([], "source string, n bigint")) == 1.0


def brute_mixture(rows, a, blocks, budget):
    """(doc_id, text, block, order) by placing every document of every permutation."""
    md5 = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:15], 16)
    name = lambda i: "" if i is None else str(i)
    own = defaultdict(list)
    for i, t, s in rows:
        own[s or ""].append((md5(name(i)), len(words(t)), i, t))
    n = {s: sum(x[1] for x in v) for s, v in own.items()}
    w = weights(n, a)
    whole = budget or max((n[s] / w[s] for s in n if n[s]), default=0)
    out = []
    for s, docs in own.items():
        due, at = round(w[s] * whole), 0
        for p in range(max(1, -(-due // n[s])) if n[s] else 1):
            place = lambda x: ((x[0] >> 50) * (1 + 2 * p * 211) + p * 389) % 1024  # noqa: E731, B023
            for _, of_bin in itertools.groupby(sorted(docs, key=lambda x: (place(x), x[0])), place):  # noqa: B023
                of_bin = list(of_bin)
                begun, full = at, at + sum(x[1] for x in of_bin) <= due
                for _, same in itertools.groupby(of_bin, lambda x: x[0]):
                    same = list(same)
                    at += sum(x[1] for x in same)
                    if full or begun < due and at <= due:
                        block = min(begun * blocks // due, blocks - 1) if due else 0
                        out += [(i, t, block, md5(f"{i}:{p}" if i is not None else str(p))) for _, _, i, t in same]
    return out


@pytest.mark.parametrize("aims", [{}, {"evenness": 0.5}, {"evenness": 0.9, "repetitions": None, "budget": 90_000}, {"repetitions": 1.0, "budget": 7_000}])
def test_mixture(spark, rows, aims):
    made = [(1000 + i, "w " * (1 + i % 5), "a" if i % 4 else "b") for i in range(400)]
    docs = frame(spark, [*rows, *made])
    got = mixing.mixed(docs, **aims)
    assert [c for c in docs.columns if c != "mix_block"] + ["mix_block", "mix_order"] == got.columns
    n = Counter()
    for _, t, s in [*rows, *made]:
        n[s or ""] += len(words(t))
    a = mixing.exponent(spark.createDataFrame(list(n.items()), "source string, n bigint"), **aims)
    want = brute_mixture([*rows, *made], a, mixing.BLOCKS, aims.get("budget"))
    assert sorted(repr((r.doc_id, r.text, r.mix_block, r.mix_order)) for r in got.collect()) == sorted(map(repr, want))
    if "budget" not in aims:
        assert {(i, t) for i, t, _, _ in want} == {(i, t) for i, t, _ in [*rows, *made]}
    assert mixing.mixed(frame(spark, []), **aims).isEmpty()


def test_each_block_has_the_weights(spark):
    rng = random.Random(7)
    made = [(i, "w " * rng.randint(20, 60), rng.choice(["a"] * 6 + ["b"] * 3 + ["c"])) for i in range(6000)]
    got = mixing.mixed(frame(spark, made), evenness=0.5).collect()
    n = Counter()
    for _, t, s in made:
        n[s] += len(words(t))
    a = mixing.exponent(spark.createDataFrame(list(n.items()), "source string, n bigint"), evenness=0.5)
    assert 0 < a < 1
    w = weights(n, a)
    by = defaultdict(Counter)
    for r in got:
        by[r.mix_block][r.source] += len(words(r.text))
    assert sorted(by) == list(range(mixing.BLOCKS))
    for of in by.values():
        assert all(abs(of[s] / sum(of.values()) - w[s]) < 0.02 for s in w)


def test_mixture_matches_sql(spark, tmp_path):
    rng = random.Random(3)
    made = [(i, None if i % 50 == 0 else "w " * rng.randint(1, 60), rng.choice(["a"] * 6 + ["b"] * 3 + ["c", None])) for i in range(900)]
    con = duckdb.connect()
    documents = frame(spark, made).select("doc_id", "text", "source").toPandas()  # noqa: F841
    con.execute("CREATE TABLE documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text, source FROM documents")
    want = con.execute(mixing.ORACLE).fetchall()
    got = mixing.query(spark, saved(spark, made, tmp_path)).collect()
    assert len(got) > 900 and sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


# The pipeline


def test_pipeline(spark, tmp_path):
    rng = random.Random(12)
    good = [(2 * i, "\n".join(prose(rng, 40).replace("\n", " ") for _ in range(4)), f"s{i % 3 % 2}") for i in range(60)]
    junk = [(2 * i + 1, " ".join(f"zz{rng.randint(0, 300)}$$" for _ in range(200)), "s1") for i in range(12)]
    copy = (1000, good[3][1], "s0")
    at = saved(spark, [*good, *junk, copy, (1001, None, None)], tmp_path)
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns = docs.columns
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, at).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(sorted(r.doc_id for r in docs.select("doc_id").collect()))
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    ids = sorted(i for i, _, _ in good)
    assert kept[0] == sorted([*ids, 1000]) and kept[1] == ids and kept[2] == ids and set(kept[3]) == set(ids) and kept[4] == kept[3]
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, at).collect()) == kept[4]


def test_near_dedup_stage_keeps_one_of_a_group(spark, tmp_path):
    made = [*family()[:20], (500, prose(random.Random(1), 200), None)]
    at = saved(spark, made, tmp_path)
    docs = spark.read.parquet(f"{at}/documents.parquet")
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, at).collect()}
    assert got == {c for _, _, c in brute_components(made, 5)}
