"""Phrase collocations by hierarchical pair naming.

Words that a language has often enough get names. Level k (2 to 4) looks at neighbouring named phrases of k - 1 words: two
that start one word apart are a phrase of k words, named by the pair of their names if it is frequent. Every part of a
frequent phrase is as frequent, so no frequent phrase is missed, and the pair of names is also the phrase's link to the
phrases without its last and without its first word: cuts and the phrases that lie within others are found along these
links, and no text of a phrase is compared.

Counting and naming are round trips (`trips`): a block asks for each of its distinct pairs once, with its count; the pair's
bucket adds up and answers with names. Positions stay in their block, as codes of the names that it has.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm import trips
from tallyforge.llm._common import bucketed, documents, partitions, written
from tallyforge.llm.hashing import BASE, mixed

#: Words of a phrase at most, its least count, its share (in percent) of a phrase within it that this one replaces, and the
#: phrases that are reported of each language.
WORDS, LEAST, PERCENT, TOP = 4, 30, 80, 2000
#: Of a cut, the score is this many times a / (l + r), floored.
SCALE = 2_000_000
UNKNOWN = "und"
#: Bytes of a block's texts.
BLOCK_BYTES = 16_000_000
_U = np.uint64
_ENDS = re.compile(rb"[.,;:!?\n\x0b\x0c\r]+")
_WORDS = "block bigint, langs array<string>, counts array<bigint>, data binary"


def _blocks(block: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Texts as codes: 0 between pieces and texts, else a word of a language. A word with its language is its bytes, a line
    feed (which no word has) and the language's."""
    next_code = count(1).__next__
    codes: dict[str, dict[bytes, int]] = {}
    counts: dict[str, int] = defaultdict(int)
    seqs = []
    for lang, raw in rows:
        own = codes.get(lang)
        if own is None:
            own = codes[lang] = defaultdict(next_code, {b".": 0})
        seqs.append(np.array([*[own[w] for w in _ENDS.sub(b" . ", raw.lower()).split()], 0], np.uint32))
        counts[lang] += int(np.count_nonzero(seqs[-1]))
    words = [b""] * (next_code() - 1)
    for lang, own in codes.items():
        end = b"\n" + lang.encode("utf-8", "surrogatepass")
        for w, c in own.items():
            if c:
                words[c - 1] = w + end
    data = trips.packed(np.concatenate(seqs), np.array(list(map(len, words)), np.uint32), b"".join(words))
    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([list(counts)], pa.list_(pa.string())), pa.array([list(counts.values())], pa.list_(pa.int64())), pa.array([data], pa.binary())], ["block", "langs", "counts", "data"])


def _words(data: bytes, buckets: int) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """Codes, words, the order in which words are asked, and their buckets in this order."""
    code, lengths, flat = trips.unpacked(data)
    ends = np.cumsum(lengths.astype(np.int64)).tolist()
    words = [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    bucket = np.array([zlib.crc32(w) % buckets for w in words], np.int64)
    order = np.argsort(bucket, kind="stable")
    return code, words, order, bucket[order]


def _ask_words(buckets: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                code, words, order, bucket = _words(data.as_py(), buckets)
                counts = np.bincount(code, minlength=len(words) + 1)[1:][order].astype(np.uint64)

                def pack(a: int, b: int) -> bytes:
                    own = [words[i] for i in order[a:b].tolist()]  # noqa: B023
                    return trips.packed(np.array(list(map(len, own)), np.uint32), b"".join(own), counts[a:b])  # noqa: B023

                yield from trips.asked(block, bucket, buckets, pack)

    return run


def _name_words(least: int):
    """Answers: the names of frequent words (0: none). Once: names, counts and words."""

    def answer(bucket: int, asks: list[list]) -> tuple[list[bytes], bytes]:
        sums: dict[bytes, int] = defaultdict(int)
        places = []
        for lengths, flat, counts in asks:
            ends = np.cumsum(lengths.astype(np.int64)).tolist()
            places.append([flat[a:b] for a, b in zip([0, *ends], ends, strict=False)])
            for w, c in zip(places[-1], counts.tolist(), strict=True):
                sums[w] += c
        found = sorted(w for w, c in sums.items() if c >= least)
        names = {w: (bucket << 32) + i + 1 for i, w in enumerate(found)}
        said = [trips.packed(np.array([names.get(w, 0) for w in own], np.uint64)) for own in places]
        return said, trips.packed(np.array(list(names.values()), np.uint64), np.array([sums[w] for w in found], np.uint64), np.array(list(map(len, found)), np.uint32), b"".join(found))

    return answer


def _told_words(bucket: int, x: list) -> dict[str, list]:
    ends = np.cumsum(x[2].astype(np.int64)).tolist()
    parts = [x[3][a:b].partition(b"\n") for a, b in zip([0, *ends], ends, strict=False)]
    return {"id": x[0].astype(np.int64), "f": x[1].astype(np.int64), "word": [p[0].decode("utf-8", "surrogatepass") for p in parts], "lang": [p[2].decode("utf-8", "surrogatepass") for p in parts]}


def _compact(codes: np.ndarray, names: np.ndarray) -> bytes:
    """Codes (0: none) and the names of code 1, 2, ..., without those that have no name."""
    new = np.zeros(len(names) + 1, np.uint32)
    kept = np.flatnonzero(names)
    new[kept + 1] = np.arange(1, len(kept) + 1)
    return trips.packed(new[codes], names[kept])


class Pairs:
    """The distinct pairs of neighbouring names of a block, in the order in which they are asked."""

    def __init__(self, data: bytes, buckets: int):
        codes, names = trips.unpacked(data)
        a, b = codes[:-1].astype(np.uint64), codes[1:].astype(np.uint64)
        self.n, self.at = len(codes), np.flatnonzero((a > 0) & (b > 0))
        size = _U(len(names) + 1)
        both, place, counts = np.unique(a[self.at] * size + b[self.at], return_inverse=True, return_counts=True)
        left, right = names[(both // size).astype(np.int64) - 1], names[(both % size).astype(np.int64) - 1]
        bucket = (mixed(mixed(left + _U(BASE)) * _U(BASE) + right) % _U(buckets)).astype(np.int64)
        order = np.lexsort((right, left, bucket))
        self.left, self.right, self.bucket, self.counts = left[order], right[order], bucket[order], counts[order].astype(np.uint64)
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(1, len(order) + 1)
        self.place = rank[place]

    def codes(self) -> np.ndarray:
        """For each position the place of the pair that starts there, from 1 (0: none)."""
        out = np.zeros(self.n, np.uint32)
        out[self.at] = self.place
        return out


def _ask_pairs(buckets: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                p = Pairs(data.as_py(), buckets)
                yield from trips.asked(block, p.bucket, buckets, lambda a, b: trips.packed(p.left[a:b], p.right[a:b], p.counts[a:b]))  # noqa: B023

    return run


def _name_pairs(least: int):
    """Answers: the names of frequent pairs (0: none). Once: names, counts and both parts."""

    def answer(bucket: int, asks: list[list]) -> tuple[list[bytes], bytes]:
        left, right, counts = (np.concatenate(x) for x in zip(*asks, strict=True))
        order = np.lexsort((right, left))
        left, right = left[order], right[order]
        new = np.concatenate(([True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])))
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        sums = trips.summed(place, place.max() + 1, counts)
        often = sums >= least
        names = np.zeros(len(sums), np.uint64)
        names[often] = _U(bucket << 32) + np.arange(1, often.sum() + 1, dtype=np.uint64)
        cuts = np.cumsum([0, *(len(x[0]) for x in asks)])
        said = [trips.packed(names[place[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return said, trips.packed(names[often], sums[often], left[new][often], right[new][often])

    return answer


def _told_pairs(bucket: int, x: list) -> dict[str, list]:
    return {name: x[i].astype(np.int64) for i, name in enumerate(("id", "f", "left", "right"))}


def _named_words(buckets: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for block, data, said in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                code, words, order, _ = _words(data.as_py(), buckets)
                names = np.zeros(len(words), np.uint64)
                names[order] = trips.joined(said.as_py())
                yield _one(block, _compact(code, names))

    return run


def _named_pairs(buckets: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for block, data, said in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                yield _one(block, _compact(Pairs(data.as_py(), buckets).codes(), trips.joined(said.as_py())))

    return run


def _one(block: pa.Scalar, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block.as_py()], pa.int64()), pa.array([data], pa.binary())], ["block", "data"])


def named(docs: DataFrame, *, least: int = LEAST, words: int = WORDS) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n), the word occurrences of each language, and for each length the frequent phrases: (id, f, word, lang) of
    words, (id, f, left, right) of longer ones, which name those without their last and without their first word."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").cast("binary").alias("text"))
    blocks, _ = bucketed(rows.mapInArrow(trips.in_blocks(_blocks, BLOCK_BYTES), _WORDS), "phrase_words", "block", partitions(spark))
    sizes = blocks.select(F.explode(F.arrays_zip("langs", "counts")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.counts").alias("n"))
    total = blocks.agg(F.sum(F.aggregate("counts", F.lit(0).cast("bigint"), lambda s, x: s + x))).first()[0] or 0
    buckets = max(partitions(spark), -(-total // trips.ENTRIES))
    told, positions = [], blocks
    for k in range(1, words + 1):
        ask, answer, say = (_ask_words, _name_words, _named_words) if k == 1 else (_ask_pairs, _name_pairs, _named_pairs)
        said, _ = written(trips.answered(positions.select("block", "data").mapInArrow(ask(buckets), trips.ASKED), answer(least)), f"phrase-names-{k}")
        told.append(trips.once(said, "id bigint, f bigint, word string, lang string", _told_words) if k == 1 else trips.once(said, "id bigint, f bigint, left bigint, right bigint", _told_pairs))
        if k < words:
            held = positions.select("block", "data").join(trips.by_block(said, "said"), "block", "left")
            positions, _ = bucketed(held.select("block", "data", "said").mapInArrow(say(buckets), "block bigint, data binary"), f"phrases_{k}", "block", partitions(spark))
    return sizes, told


_NONE = "CAST(array() AS array<bigint>)"
_PARTS = "CAST(array() AS array<struct<words: int, id: bigint>>)"


def _linked(told: list[DataFrame]) -> list[DataFrame]:
    """Phrases of two words and more with text, lang, the counts of the first and last parts of each cut (`first`, `rest`,
    by the words of the first part), and `within`: the phrases of two words and more that lie in them (names are told
    apart by length: those of two lengths may be equal)."""
    held = told[0].select("id", "f", F.col("word").alias("text"), F.col("word").alias("last"), "lang", F.expr(_NONE).alias("first"), F.expr(_NONE).alias("rest"), F.expr(_PARTS).alias("within"))
    out = []
    for k in range(2, len(told) + 1):
        left = held.select(F.col("id").alias("left"), *(F.col(c).alias(f"l_{c}") for c in ("f", "text", "lang", "first", "within")))
        right = held.select(F.col("id").alias("right"), *(F.col(c).alias(f"r_{c}") for c in ("f", "last", "rest", "within")))
        both = told[k - 1].join(left, "left").join(right, "right")
        own = F.array(*(F.struct(F.lit(k - 1).alias("words"), F.col(side).alias("id")) for side in ("left", "right")))
        within = F.array_distinct(F.concat("l_within", "r_within", own)) if k > 2 else F.expr(_PARTS)
        made = both.select("id", "f", F.concat_ws(" ", "l_text", "r_last").alias("text"), F.col("r_last").alias("last"), F.col("l_lang").alias("lang"), F.concat("l_first", F.array("l_f")).alias("first"), F.concat(F.array("r_f"), "r_rest").alias("rest"), within.alias("within"))
        held, _ = written(made, f"phrases-of-{k}")
        out.append(held.withColumn("words", F.lit(k)))
    return out


def _score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(SCALE * a / (l + r)), exactly."""
    return F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * a.cast("decimal(20,0)"), l.cast("decimal(20,0)") + r.cast("decimal(20,0)"))


def collocations(docs: DataFrame, *, least: int = LEAST, percent: int = PERCENT, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): of each language its best phrases of two to four words.

    Only A-Z are lower-cased; pieces end at `[.,;:!?\\n\\v\\f\\r]`. A null or empty text has no words, a null lang is `und`.
    Repeated rows count each. Ties go to the higher count, then to the phrase that is lower by its UTF-8 bytes; they can't
    tie further. No frequent phrase, or no row: no rows. Other columns don't matter.
    """
    sizes, told = named(docs, least=least)
    every = functools.reduce(DataFrame.unionByName, _linked(told))
    over = every.select("f", F.explode("within").alias("part")).groupBy("part.words", "part.id").agg(F.max("f").alias("over"))
    left = every.join(over, ["words", "id"], "left").filter(F.coalesce(F.lit(100).cast("decimal(3,0)") * F.col("over").cast("decimal(20,0)") < F.lit(percent).cast("decimal(3,0)") * F.col("f").cast("decimal(20,0)"), F.lit(True)))
    cuts = F.transform(F.arrays_zip("first", "rest"), lambda x, k: F.struct(_score(F.col("f"), x["first"], x["rest"]).alias("score"), k.alias("k"), x["first"].alias("l"), x["rest"].alias("r")))
    scored = left.withColumn("cut", F.array_min(cuts)).select("lang", F.col("text").alias("phrase"), F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).join(sizes, "lang").select("lang", F.col("rank").cast("bigint"), "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


ORACLE = f"""
WITH docs AS (SELECT coalesce(lang, '{UNKNOWN}') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT row_number() OVER () AS p, lang, piece FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM docs)),
split AS (SELECT p, lang, string_split_regex(piece, '[\\x20\\x09]+') AS w FROM pieces),
spread AS (SELECT p, lang, unnest(w) AS w, unnest(range(len(w))) AS i FROM split),
words AS (SELECT * FROM spread WHERE w <> ''),
sizes AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
chains AS (SELECT lang, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4 FROM words WINDOW o AS (PARTITION BY p ORDER BY i)),
grams AS (
  SELECT lang, 1 AS k, w AS g FROM chains UNION ALL SELECT lang, 2, w || ' ' || w2 FROM chains WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w || ' ' || w2 || ' ' || w3 FROM chains WHERE w3 IS NOT NULL
  UNION ALL SELECT lang, 4, w || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM chains WHERE w4 IS NOT NULL),
counted AS (SELECT lang, k, g, count(*) AS f FROM grams GROUP BY lang, k, g HAVING count(*) >= {LEAST}),
candidates AS (SELECT *, string_split(g, ' ') AS w FROM counted WHERE k > 1),
spread_cuts AS (SELECT lang, g, f, w, unnest(range(1, k)) AS cut FROM candidates),
cuts AS (
  SELECT c.lang, c.g, c.f AS a, l.f AS l, r.f AS r, cut, (CAST({SCALE} AS HUGEINT) * c.f) // (l.f + r.f) AS score
  FROM (SELECT *, array_to_string(w[:cut], ' ') AS head, array_to_string(w[cut + 1:], ' ') AS tail FROM spread_cuts) c
  JOIN counted l ON l.lang = c.lang AND l.g = head JOIN counted r ON r.lang = c.lang AND r.g = tail),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
parts AS (
  SELECT lang, f, array_to_string(w[i:i + size - 1], ' ') AS g
  FROM (SELECT lang, f, k, w, size, unnest(range(1, k - size + 2)) AS i FROM (SELECT lang, f, k, w, unnest(range(2, k)) AS size FROM candidates))),
dropped AS (SELECT DISTINCT lang, p.g FROM parts p JOIN candidates c USING (lang, g) WHERE 100 * p.f >= {PERCENT} * c.f),
kept AS (SELECT lang, g AS phrase, a, l, r, CAST(score AS BIGINT) AS score FROM lowest ANTI JOIN dropped USING (lang, g)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= {TOP}
"""
