"""Prefix trie, backoff scores and collocations against plain Python, and against their SQL on the test tables."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from tallyforge.llm import backoff, collocations, prefix_trie, registry
from tests.llm.cases import LOWER, awkward, frame, sha, words

TABLES = "/root/testdata/sf0.001"

# Conversation prefix trie

TURNS = "conv_id bigint, turn bigint, role string, text string, place int, depth string, level int, words int, member int, last string, k1 int, node int, path int"


def talk(seed: int = 5):
    """(conv_id, turn, role, text): shared beginnings, copies, turns without a number or text, equal rows, ties, a deep one."""
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 90), *range(200, 240, 3), -3, -21, 10**15 + 7]:
        if c in (20, 40):
            continue  # their groups have no first conversation
        for t in range(rng.randint(1, 6)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice([None, "", "a b", "one two three", f"x{rng.randint(0, 4)} y\nz"])))
    rows += [(61, t, "user", "w " * (t % 4)) for t in range(300)] + [(62, t, "user", "w " * (t % 4)) for t in range(280)]
    rows += [(7, 1, "user", "tie"), (7, 1, "assistant", "tie"), (7, 1, "user", "again"), (9, None, None, None), (9, None, None, None), (None, 0, "user", "nobody's")]
    rows += [(c, t, "user", "same start of many") for c in range(300, 340) for t in range(2)]
    return rows


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(v, key=lambda x: (x[0], x[1].encode(), x[2].encode()))] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p in members:
        cost = (len(members[p]) - 1) * len(words(p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += cost
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], sha(",".join(map(str, sorted(ends[p]))).encode())) for p, m in members.items())


@pytest.mark.parametrize("bits", [12, 2])
def test_trie(spark, monkeypatch, bits):
    monkeypatch.setattr(prefix_trie, "RUN_BITS", bits)
    monkeypatch.setattr(prefix_trie, "ID_BITS", bits)
    made = spark.createDataFrame([(*r, *[None] * 9) for r in talk()], TURNS).repartition(5)
    got = prefix_trie.trie(made)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect())) == brute_trie(talk())


def test_trie_without_turns(spark):
    empty = spark.createDataFrame([], TURNS)
    assert prefix_trie.trie(empty).isEmpty()
    assert prefix_trie.trie(spark.createDataFrame([(None, 1, "user", "x", *[None] * 9)], TURNS)).isEmpty()
    # One turn that is cut away, and a first conversation that is absent: only the root is left.
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4)
    rows = [(c, 0, "user", "gone")]
    assert sorted(map(tuple, prefix_trie.trie(spark.createDataFrame([(*r, *[None] * 9) for r in rows], TURNS)).collect())) == brute_trie(rows)


# Backoff scores


def plain_words(text):
    return [*words((text or "").translate(LOWER)), "\n"]


def brute_scores(rows, masses):
    """A dictionary of n-grams and a walk with failure arcs, token by token."""
    held = [zlib.crc32(str("" if i is None else i).encode()) % 5 == 1 for i, _, _ in rows]
    count, texts = Counter(), 0
    for h, (_, text, _) in zip(held, rows, strict=True):
        if not h:
            texts += 1
            seq = ["<s>", *plain_words(text)]
            for k in range(1, len(seq)):
                count.update(tuple(seq[max(k - n + 1, 0) : k + 1]) for n in range(1, min(k + 1, 3) + 1))
    total = sum(c for g, c in count.items() if len(g) == 1)
    known = sum(len(g) == 1 for g in count)
    count[("<s>",)] = texts

    def p(gram):
        *context, w = gram
        if not context:
            return (count[(w,)] + 0.5) / (total + 0.5 * (known + 1))
        c = count[tuple(context)]
        m = masses[len(context) - 1]
        return (count[gram] + m * p(gram[1:])) / (c + m) if c else p(gram[1:])

    out = []
    for h, (i, text, _) in zip(held, rows, strict=True):
        seq, state, score, base = plain_words(text), ("<s>",), 0.0, 0.0
        if not count[state]:
            state = ()
        for w in seq:
            base += math.log10(p((w,)))
            at = state
            while at and not count[(*at, w)]:
                m = masses[len(at) - 1]
                score += math.log10(m / (count[at] + m))
                at = at[1:]
                while at and not count[at]:
                    at = at[1:]
            score += math.log10(p((*at, w)))
            state = (*state, w)[-2:]
            while state and not count[state]:
                state = state[1:]
        out.append((i, h, len(seq), sum(count[(w,)] > 0 for w in seq), total, base, score))
    return out


def close(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 4), round(r[6], 4))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [x for r in got for x in r[5:]] == pytest.approx([x for r in want for x in r[5:]], rel=1e-9)


@pytest.mark.parametrize("masses", [backoff.MASSES, (2.0, 0.5)])
def test_scores(spark, monkeypatch, masses):
    monkeypatch.setattr(backoff, "BLOCK_BYTES", 20_000)
    rows = awkward()
    close(backoff.scored(frame(spark, rows), masses=masses).collect(), brute_scores(rows, masses))


def test_scores_of_little(spark):
    assert backoff.scored(frame(spark, [])).isEmpty()
    held = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1)
    for rows in ([(held, "nothing to learn from", None)], [(held, "a b", None), (None, "A b a", None)]):
        close(backoff.scored(frame(spark, rows)).collect(), brute_scores(rows, backoff.MASSES))


def test_unseen_contexts(spark):
    """All known words, the end and an unknown word, after seen and unseen contexts."""
    rows = [(0, "a b a c a b", None), (2, "b b c", None)]
    assert not any(zlib.crc32(str(i).encode()) % 5 == 1 for i, _, _ in rows)
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1][:12]
    for context in ("a b", "c c", "zz a", "zz zz"):
        probes = [(i, f"{context} {w}".strip(), None) for i, w in zip(held, ["a", "b", "c", "zz", ""], strict=False)]
        got = {r.doc_id: r for r in backoff.scored(frame(spark, rows + probes), masses=(2.0, 0.5)).collect()}
        # What the end adds after the word is taken off by the brute force's own parts.
        want = {r[0]: r for r in brute_scores(rows + probes, (2.0, 0.5))}
        assert all(got[i].score == pytest.approx(want[i][6]) for i, _, _ in probes)


# Collocations


def brute_phrases(rows, least, percent, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        over = Counter()
        for g, a in found.items():
            for part in {g[i : i + k] for k in range(2, len(g)) for i in range(len(g) - k + 1)}:
                over[part] = max(over[part], a)
        made = []
        for g, a in found.items():
            if not 100 * over[g] >= percent * a or not over[g]:
                score, _, x, y = min((2_000_000 * a // (counts[g[:k]] + counts[g[k:]]), k, counts[g[:k]], counts[g[k:]]) for k in range(1, len(g)))
                made.append((-score, -a, " ".join(g).encode(), x, y))
        out += [(lang, r, p.decode(), -a, x, y, n[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(made)[:top], 1)]
    return sorted(out)


def phrase_rows():
    rng = random.Random(9)
    bag = ["New", "york", "city", "of", "the", "état", "x\x00y", "a", "ß", "city.", "hall!", "in,"]
    rows = [(rng.choice(["en", "fr", None, "und"]), "".join(rng.choice(bag) + rng.choice([" ", " ", "\t", "  ", "\n"]) for _ in range(rng.randint(0, 80)))) for _ in range(150)]
    return rows + [("en", None), (None, ""), ("fr", "... !!\r"), ("en", "a a a a a a a a"), ("en", "new york city hall " * 400)]


def phrase_frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 7, "x", 1, 2, 3.0) for i, (lang, t) in enumerate(rows)], "doc_id bigint, text string, lang string, id string, f int, word string, left int, n int, score double").repartition(3)


@pytest.mark.parametrize("options", [{"least": 30, "percent": 80, "top": 2000}, {"least": 4, "percent": 60, "top": 25}])
def test_phrases(spark, monkeypatch, options):
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 4000)
    rows = phrase_rows()
    got = collocations.collocations(phrase_frame(spark, rows), **options)
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, **options)


def test_phrases_of_little(spark):
    assert collocations.collocations(phrase_frame(spark, []).limit(0)).isEmpty()
    assert collocations.collocations(phrase_frame(spark, [("en", "one two"), (None, None)])).isEmpty()


# Against SQL


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op13_collocations", "backoff_base"])
def test_sql(spark, name):
    got = registry.QUERIES[name](spark, TABLES)
    with duckdb.connect() as db:
        for table in ("documents", "conversations"):
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{TABLES}/{table}.parquet'")
        want = db.execute(registry.ORACLES[name])
        columns = [c[0] for c in want.description]
        want = sorted(map(repr, want.fetchall()))
    assert sorted(repr(tuple(r)) for r in got.select(columns).collect()) == want
