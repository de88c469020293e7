"""Language-model scores by a weighted backoff automaton.

The model has n-grams of one to three words. A state is a context that the training texts have (two words, one word, or
none); its arcs are the n-grams seen after it, and its failure arc leads to the state of its shorter context and weighs the
mass that smoothing leaves to it. Smoothing is that of a Dirichlet prior: after a context h of count C,
P(w | h) = (c(hw) + m P(w | shorter h)) / (C + m), so that a failure arc weighs m / (C + m); with no context,
P(w) = (c + 0.5) / (N + 0.5 (V + 1)), the one more word being any unknown one. Each level sums to one. Texts begin in the
state of a start mark, which is never a token, and end with a token of its own.

The automaton of a large corpus fits no machine. A block of documents asks for the counts of its own distinct n-grams
(`trips`), builds the part of the automaton that its texts can reach, and walks along them once: all positions of the block
advance together, as the state before a token is the longest context there that the model has; a walk takes the arc of the
token, or adds the failure arc's weight and tries again from the shorter context.

Words are told apart by 128 bits. An n-gram's key has 2 log2(tokens) + 1 bits, 64 at most: some two chance meetings in all
of the corpus are expected up to four thousand million tokens.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import trips
from tallyforge.llm._common import bucketed, documents, partitions, written
from tallyforge.llm.hashing import BASE, mixed

#: Prior mass m after one word, and after two.
MASSES = (3000.0, 30.0)
#: Bytes of a block's texts: about 60 times as much memory scores them.
BLOCK_BYTES = 8_000_000
_U = np.uint64
END, START = 0, 1
_BLOCK = "block bigint, doc_ids array<bigint>, held array<boolean>, data binary, tokens bigint, train_tokens bigint, train_docs bigint"


def _blocks(block: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Texts as codes of the block's words: 0 the end, words from 2 on."""
    places: dict[bytes, int] = {}
    put, seqs = places.setdefault, []
    for _, _, raw in rows:
        seqs.append(np.array([*[put(w, len(places) + 2) for w in raw.lower().split()], END], np.uint32))
    sizes = np.array(list(map(len, seqs)), np.int64)
    held = np.array([h for _, h, _ in rows], bool)
    words = list(places)
    data = trips.packed(sizes.astype(np.uint32), np.concatenate(seqs), np.array(list(map(len, words)), np.uint32), b"".join(words))
    cols = [[block], [[i for i, _, _ in rows]], [held.tolist()], [data], [int(sizes.sum())], [int(sizes[~held].sum())], [int((~held).sum())]]
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split(" ")[0] for x in _BLOCK.split(", ")])


class Grams:
    """A block's tokens and its distinct n-grams, in an order that both trips share."""

    def __init__(self, data: bytes, held: list[bool]):
        import xxhash

        self.sizes, self.token, lengths, flat = trips.unpacked(data)
        self.sizes = self.sizes.astype(np.int64)
        ends = np.cumsum(lengths.astype(np.int64)).tolist()
        # No word has a line feed.
        names = [xxhash.xxh3_128_digest(w) for w in (b"\n", b"\n\n", *(flat[a:b] for a, b in zip([0, *ends], ends, strict=False)))]
        self.hash = np.frombuffer(b"".join(names), "<u8").reshape(-1, 2)
        self.train = np.repeat(~np.array(held, bool), self.sizes)

    def words(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes in the order in which they are asked (all but the start mark), and their buckets."""
        bucket = ((self.hash[:, 0] >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
        bucket[START] = buckets
        order = np.lexsort((self.hash[:, 1], self.hash[:, 0], bucket))[:-1]
        return order, bucket[order]

    def longer(self, bits: int) -> None:
        """Finds the n-grams of two and three words: for each position `two` and (but for a text's first) `three` are
        places among them, and each has a key."""
        w, token = _U(len(self.hash)), self.token
        firsts = np.cumsum(self.sizes) - self.sizes
        self.before = np.concatenate(([END], token[:-1])).astype(np.uint32)
        self.before[firsts] = START
        pair, self.two = _numbered(self.before * w + token)
        h = self.hash[:, 0]
        self.key2 = mixed(mixed(h[pair // w] + _U(BASE)) * _U(BASE) + h[pair % w])
        self.inner = np.ones(len(token), bool)
        self.inner[firsts] = False
        at = np.flatnonzero(self.inner)
        triple, self.three = _numbered(self.two[at - 1] * w + token[at])
        first = np.empty(len(triple), np.int64)
        first[self.three] = at  # any place of each
        at = first
        self.context3, self.suffix3 = self.two[at - 1], self.two[at]  # of each: its first two words, its last two
        self.key3 = mixed(self.key2[self.context3] * _U(BASE) + h[token[at]])
        self.keys, place = _numbered(np.concatenate((self.key2, self.key3)) >> _U(64 - bits))
        self.at2, self.at3 = place[: len(self.key2)], place[len(self.key2) :]
        self.n2, self.n3 = len(self.key2), len(self.key3)
        del self.key2, self.key3  # the largest of what is no longer needed

    def counts(self) -> np.ndarray:
        """Of each key: how often the block's training texts have it."""
        two = np.bincount(self.two, self.train, self.n2)
        three = np.bincount(self.three, self.train[self.inner], self.n3)
        return trips.summed(self.at2, len(self.keys), two) + trips.summed(self.at3, len(self.keys), three)


def _numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and each one's place among them; a block has fewer than 2 ** 32."""
    found, place = np.unique(x, return_inverse=True)
    return found, place.astype(np.uint32)


def _ask_words(buckets: int):
    def one(block: int, held: list[bool], data: bytes) -> Iterator[pa.RecordBatch]:
        g = Grams(data, held)
        order, bucket = g.words(buckets)
        counts, names = np.bincount(g.token, g.train, len(g.hash)).astype(np.uint64)[order], g.hash[order]
        del g
        yield from trips.asked(block, bucket, buckets, lambda a, b: trips.packed(names[a:b, 0], names[a:b, 1], counts[a:b]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for block, held, data in zip(*batch.columns, strict=True):
                yield from one(block.as_py(), held.as_py(), data.as_py())

    return run


def _count_words(bucket: int, asks: list[list]) -> tuple[list[bytes], bytes]:
    first, second, counts = (np.concatenate(x) for x in zip(*asks, strict=True))
    order = np.lexsort((second, first))
    first, second = first[order], second[order]
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(np.concatenate(([False], (first[1:] != first[:-1]) | (second[1:] != second[:-1]))))
    sums = trips.summed(place, place.max() + 1, counts)
    cuts = np.cumsum([0, *(len(x[0]) for x in asks)])
    return [trips.packed(sums[place[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], trips.packed(np.array([(sums > 0).sum()], np.uint64))


def _ask_grams(buckets: int, bits: int):
    def one(block: int, held: list[bool], data: bytes) -> Iterator[pa.RecordBatch]:
        g = Grams(data, held)
        g.longer(bits)
        keys, counts = g.keys, g.counts()
        del g
        bucket = ((keys >> _U(bits - 32)) * _U(buckets) >> _U(32)).astype(np.int64)

        def pack(a: int, b: int) -> bytes:
            steps = np.diff(keys[a:b], prepend=_U(0))
            return trips.packed(steps[:1], _cut(steps[1:]), counts[a:b])

        yield from trips.asked(block, bucket, buckets, pack)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for block, held, data in zip(*batch.columns, strict=True):
                yield from one(block.as_py(), held.as_py(), data.as_py())  # nothing of a block outlives it

    return run


def _cut(steps: np.ndarray) -> bytes:
    """Whole numbers in as many bytes each as the largest one needs."""
    size = max(1, -(-int(steps.max(initial=0)).bit_length() // 8))
    return bytes([size]) + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def _whole(data: bytes) -> np.ndarray:
    size = data[0]
    out = np.zeros(((len(data) - 1) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, size)
    return out.view("<u8").ravel()


def _count_grams(bucket: int, asks: list[list]) -> tuple[list[bytes], bytes]:
    keys = [np.cumsum(np.concatenate((first, _whole(steps))), dtype=np.uint64) for first, steps, _ in asks]
    cuts = np.cumsum([0, *map(len, keys)])
    _, place = np.unique(np.concatenate(keys), return_inverse=True)
    sums = trips.summed(place, place.max() + 1, np.concatenate([x[2] for x in asks]))
    return [trips.packed(sums[place[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], b""


class Automaton:
    """The part of the model that one block can reach. c1, c2, c3: counts of its words and longer n-grams."""

    def __init__(self, g: Grams, c1: np.ndarray, c2: np.ndarray, c3: np.ndarray, tokens: int, known: int, texts: int, masses: tuple[float, float]):
        m2, m3 = masses
        self.g, self.c1 = g, c1
        p1 = (c1 + 0.5) / (tokens + 0.5 * (known + 1))
        self.root = np.log10(p1)  # arcs of the state without context: one for every word
        after1 = c1.astype(float)
        after1[START] = texts
        self.state1, self.fail1 = after1 > 0, np.log10(m2 / (after1 + m2))
        token, before = np.empty(len(c2), np.int64), np.empty(len(c2), np.int64)
        token[g.two], before[g.two] = g.token, g.before
        p2 = np.where(self.state1[before], (c2 + m2 * p1[token]) / (after1[before] + m2), p1[token])
        self.arc2, self.weight2 = c2 > 0, np.log10(p2)
        self.state2, self.fail2 = c2 > 0, np.log10(m3 / (c2 + m3))
        p3 = (c3 + m3 * p2[g.suffix3]) / (c2[g.context3] + m3)
        self.arc3, self.weight3 = c3 > 0, np.log10(p3)

    def walk(self) -> np.ndarray:
        """The log10 probability of each token, along all texts from left to right."""
        g = self.g
        out, level = np.zeros(len(g.token)), np.where(self.state1[g.before], 1, 0)
        at = np.flatnonzero(g.inner)
        level[at[self.state2[g.two[at - 1]]]] = 2
        three = np.full(len(g.token), -1)
        three[at] = g.three
        # The state of two words: its arc, or its failure arc to the state of one word (which then exists).
        x = np.flatnonzero(level == 2)
        arc = self.arc3[three[x]]
        out[x[arc]] = self.weight3[three[x[arc]]]
        out[x[~arc]] = self.fail2[g.two[x[~arc] - 1]]
        level[x] = np.where(arc, -1, 1)
        x = np.flatnonzero(level == 1)
        arc = self.arc2[g.two[x]]
        out[x[arc]] += self.weight2[g.two[x[arc]]]
        out[x[~arc]] += self.fail1[g.before[x[~arc]]]
        level[x] = np.where(arc, -1, 0)
        x = np.flatnonzero(level == 0)
        out[x] += self.root[g.token[x]]
        return out


def _scores(buckets: int, bits: int, tokens: int, known: int, texts: int, masses: tuple[float, float]):
    def one(ids: list, held: list[bool], data: bytes, words: list[bytes], grams: list[bytes]) -> pa.RecordBatch:
        g = Grams(data, held)
        order, _ = g.words(buckets)
        g.longer(bits)
        c1 = np.zeros(len(g.hash), np.uint64)
        c1[order] = trips.joined(words)
        counts = trips.joined(grams)
        automaton = Automaton(g, c1, counts[g.at2], counts[g.at3], tokens, known, texts, masses)
        cuts = np.cumsum(g.sizes) - g.sizes
        base, score = np.add.reduceat(automaton.root[g.token], cuts), np.add.reduceat(automaton.walk(), cuts)
        n_known = np.add.reduceat((c1[g.token] > 0).astype(np.int64), cuts)
        cols = [pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(g.sizes), pa.array(n_known), pa.array(np.full(len(ids), tokens, np.int64)), pa.array(base), pa.array(score)]
        return pa.RecordBatch.from_arrays(cols, [x.split(" ")[0] for x in _SCORED.split(", ")])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for row in zip(*batch.columns, strict=True):
                yield one(*(x.as_py() for x in row))

    return run


_SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def scored(docs: DataFrame, *, masses: tuple[float, float] = MASSES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; scores are log10 probabilities.

    The model learns from rows whose crc32(doc_id as text; null: empty) mod 5 is not 1. A null or empty text is its end
    alone. Repeated rows and equal or null doc_ids stay rows of their own and count each; other columns don't matter. With
    nothing to learn from, every token has the probability of an unknown one.
    """
    spark = docs.sparkSession
    held = F.crc32(F.coalesce(F.col("doc_id").cast("bigint").cast("string"), F.lit("")).cast("binary")) % 5 == 1
    rows = docs.select(F.col("doc_id").cast("bigint"), held.alias("held"), F.col("text").cast("string").cast("binary").alias("text"))
    blocks, _ = bucketed(rows.mapInArrow(trips.in_blocks(_blocks, BLOCK_BYTES), _BLOCK), "lm_blocks", "block", partitions(spark))
    total, tokens, texts = (x or 0 for x in blocks.agg(F.sum("tokens"), F.sum("train_tokens"), F.sum("train_docs")).first())
    buckets = max(partitions(spark), -(-2 * total // trips.ENTRIES))
    bits = min(64, max(33, 2 * math.ceil(math.log2(total + 1)) + 1))
    asking = blocks.select("block", "held", "data")
    words, _ = written(trips.answered(asking.mapInArrow(_ask_words(buckets), trips.ASKED), _count_words), "lm-words")
    known = trips.once(words, "known bigint", lambda _, x: {"known": [int(x[0][0])]}).agg(F.sum("known")).first()[0] or 0
    grams = trips.answered(asking.mapInArrow(_ask_grams(buckets, bits), trips.ASKED), _count_grams)
    whole = blocks.select("block", "doc_ids", "held", "data").join(trips.by_block(words, "words"), "block", "left").join(trips.by_block(grams, "grams"), "block", "left")
    return whole.select("doc_ids", "held", "data", "words", "grams").mapInArrow(_scores(buckets, bits, tokens, known, texts, masses), _SCORED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir))


def base_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of the scores: all but the model's own, to six decimals."""
    return query(spark, sf_dir).drop("score").withColumn("base_score", F.round("base_score", 6))


#: crc32 by its table of 256 values, which a rule makes.
_STEP = "CASE WHEN {x} & 1 = 1 THEN xor({x} >> 1, 3988292384) ELSE {x} >> 1 END"
CRC_TABLE = f"""
bits AS (SELECT i, CAST(i AS BIGINT) AS x, 0 AS k FROM range(256) r(i) UNION ALL SELECT i, {_STEP.format(x="x")}, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(x ORDER BY i) AS t FROM bits WHERE k = 8)"""


def crc_sql(text: str) -> str:
    """crc32 of ASCII text, given `crc` in the FROM clause."""
    return f"xor(list_reduce([CAST(ord(c) AS BIGINT) FOR c IN string_split({text}, '')], lambda x, b: xor(t[(xor(x, b) & 255) + 1], x >> 8), CAST(4294967295 AS BIGINT)), 4294967295)"


BASE_ORACLE = f"""
WITH RECURSIVE {CRC_TABLE},
docs AS (
  SELECT row_number() OVER () AS r, doc_id, {crc_sql("CAST(doc_id AS VARCHAR)")} % 5 = 1 AS held_out,
         list_append(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''), chr(10)) AS tokens
  FROM documents, crc),
words AS (SELECT r, doc_id, held_out, unnest(tokens) AS w FROM docs),
counted AS (SELECT w, count(*) AS c FROM words WHERE NOT held_out GROUP BY w),
total AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM counted)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n) AS train_tokens,
       round(sum(log10((coalesce(c, 0) + 0.5) / (n + 0.5 * (v + 1)))), 6) AS base_score
FROM words LEFT JOIN counted USING (w) CROSS JOIN total GROUP BY r, doc_id, held_out
"""
