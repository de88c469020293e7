"""Awkward rows for every operator, and plain re-statements of the contracts."""

from __future__ import annotations

import hashlib
import random
import re

BLANK = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Columns that operators might use themselves.
EXTRA = "id bigint, kind string, words int, n_words string, root string, n_bytes string, shard int, depth string, prefix string, removed string, size int, bucket int, n string, pii string, kept string, spans int, fingerprint int, ids string, mix_block string, blocks int, start int, text_x string, u int, v int"
DOCS = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {EXTRA}"


def prose(rng: random.Random, words: int) -> str:
    made = ["".join(rng.choice(["an", "er", "to", "ri", "sol", "é", "Qu", "ß"]) for _ in range(rng.randint(1, 4))) for _ in range(words)]
    return "".join(w + rng.choice([" ", " ", " ", "  ", ". ", "\n", "\t"]) for w in made)


def awkward(seed: int = 11) -> list[tuple[int | None, str | None, str | None]]:
    """(doc_id, text, source): nulls, empty and long texts, copies, near copies, ties, and repeated rows."""
    rng = random.Random(seed)
    base = prose(rng, 400)
    near = base.replace(" ", "  ", 3).split(" ")
    near[50], near[200] = "changed", "words"
    texts = [None, "", " \n\t ", "a", "word", "two words", "x" * 3000, "é" * 500, base, base, " ".join(near), base[:700] + prose(rng, 100), prose(rng, 20_000), "same line\nsame line\n" + prose(rng, 60), "a b c " * 200, " 1 2 3", "\U0001f600 \U0001f600" * 40, "#$ " * 100]
    texts += [prose(rng, rng.randint(1, 150)) for _ in range(20)]
    rows = [(10 + 3 * i, t, rng.choice(["s1", "s1", "s1", "s2", None])) for i, t in enumerate(texts)]
    return [*rows, rows[8], rows[20], (rows[21][0], "other text of the same id, which is short", "s2"), (None, "a row without an id " * 30, "s2")]


def frame(spark, rows, *, parts: int = 3):
    n = len(DOCS.split(",")) - 5
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), *[None] * n) for i, t, s in rows], DOCS).repartition(parts)


def saved(spark, rows, folder):
    """A table in the driver's form; gives its folder."""
    spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _, _ in rows if i is not None and i % 2 == 0], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def words(text):
    return WORD.findall(text or "")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def union_find(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
