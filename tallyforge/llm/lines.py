"""Fuzzy line dedup by MinHash.

Lines, trimmed and with A-Z as a-z, are sets of shingles of five code points. 20 bands of 6 rows find a pair of similarity
0.8 with probability 0.998 and one of 0.85 with 0.9999; candidates are verified on full sets, a
distributed union-find makes components, and the first line of each (by doc_id, then place) stays. See
tallyforge.llm.near.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import near
from tallyforge.llm._common import documents, remove, words_of, written
from tallyforge.llm.hashing import BASE, distinct, mixed, rolled, rolled_short, table

#: Bands and rows of each; code points of a shingle.
BANDS, ROWS, POINTS = 20, 6, 5
_U = np.uint64
_BLANKS = " \t\n\x0b\x0c\r"
_TABLE = table(0x110000)
_TABLE[65:91] = _TABLE[97:123]  # A-Z count as a-z


def shingles(line: str, size: int = POINTS) -> np.ndarray:
    """Sorted distinct hashes of a line's shingles; a shorter line is one shingle, an empty one has none."""
    return distinct(_windows(line.encode("utf-8", "surrogatepass"), size))


def _points(raw: np.ndarray) -> np.ndarray:
    """Code points of UTF-8 bytes."""
    if not (raw & 0x80).any():
        return raw
    return np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)


def _windows(raw: bytes, size: int = POINTS, *, short: bool = False) -> np.ndarray:
    points = _points(np.frombuffer(raw, np.uint8))
    if short:  # the same hash as in a chunk of longer lines
        return _short(points, size) if len(points) >= size else (_windows(raw, size) >> _U(32)).astype(np.uint32)
    h = _TABLE[points]
    if len(h) < size:  # all of it as one
        one = np.zeros(min(len(h), 1), np.uint64)
        for i in range(len(h)):
            one = mixed(one * _U(BASE) + h[i])
        return one
    return rolled(h, size)


def _short(points: np.ndarray, size: int) -> np.ndarray:
    """32-bit hashes of shingles, A-Z as a-z."""
    letter = np.subtract(points, 65) < 26  # whole numbers without sign: what lies below 65 is far above
    return rolled_short(points + letter.astype(np.uint8) * np.uint8(32), size)


def _sets(data: np.ndarray, offsets: np.ndarray, size: int = POINTS, *, short: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, starts) of the shingles of lines that lie one after another, a chunk of lines at a time; shingles may
    repeat. Lines under `size` code points are left to `_windows`. short: 32-bit hashes, of which more fit a chunk."""
    at, lines = 0, len(offsets) - 1
    while at < lines:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (near.LONG if short else near.CHUNK), "right")) - 1)
        cuts = offsets[at : to + 1] - offsets[at]
        raw = data[offsets[at] : offsets[to]]
        points = _points(raw)
        # Where the lines begin, in code points.
        begun = cuts if len(points) == len(raw) else np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[cuts]
        if (np.diff(begun) >= size).all():  # hashed together; those of shingles that cross into the next line are taken out
            h = _short(points, size) if short else rolled(_TABLE[points], size)
            keep = np.ones(len(h), bool)
            for k in range(1, size):
                keep[begun[1:-1] - k] = False
            yield h[keep], begun[:-1] - np.arange(to - at) * (size - 1)
        else:
            parts = [_windows(raw[a:b].tobytes(), size, short=short) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            yield np.concatenate(parts), np.cumsum([0, *map(len, parts[:-1])])
        at = to


def _flat(texts: pa.Array, *, short: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, hashes, starts) of non-empty lines and their shingles, a chunk at a time; short lines apart, so that all others
    are hashed together."""
    order = np.argsort(pa.compute.utf8_length(texts).to_numpy(zero_copy_only=False) < POINTS, kind="stable")
    text = texts.take(pa.array(order)).cast(pa.large_string())
    at = 0
    for flat, starts in _sets(np.frombuffer(text.buffers()[2] or b"", np.uint8), np.frombuffer(text.buffers()[1], np.int64)[: len(text) + 1], short=short) if len(text) else ():
        yield order[at : at + len(starts)], flat, starts
        at += len(starts)


def _sorted(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sorts each line's hashes in place; which of them are the first of their kind in their line."""
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(flat)], strict=True):
        flat[a:b].sort()
    new = np.concatenate(([True], flat[1:] != flat[:-1]))
    new[starts] = True
    return new


def described(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Set sizes and signatures of non-empty lines."""
    sizes, sig = np.empty(len(texts), np.int64), np.empty((len(texts), n), np.uint32)
    for own, flat, starts in _flat(texts):
        sig[own] = near.flat_signatures(flat, starts, n)
        sizes[own] = np.add.reduceat(_sorted(flat, starts).astype(np.int64), starts)
    return sizes, sig


def banded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (lines x BANDS) of non-empty lines, and which of them count."""
    keys, some = np.empty((len(texts), BANDS), np.uint64), np.empty((len(texts), BANDS), bool)
    for own, flat, starts in _flat(texts, short=True):
        sig, held = near.by_class(flat, starts, BANDS * ROWS)
        keys[own], some[own] = near.band_keys(sig, BANDS), np.repeat(held, BANDS // near.CLASSES, axis=1)
    return keys, some


def many_shingles(texts: pa.Array) -> list[np.ndarray]:
    """`shingles` of each of many non-empty lines."""
    out: list[np.ndarray] = [np.empty(0, np.uint64)] * len(texts)
    for own, flat, starts in _flat(texts):
        new = _sorted(flat, starts)
        for k, one in zip(own.tolist(), np.split(flat[new], np.cumsum(new)[starts[1:] - 1]), strict=True):
            out[k] = one
    return out


def _entries(buckets: int):
    """(id, line) to blobs of band keys, one entry for the copies of a line in a batch."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids, first = np.unique(batch.column(0).to_numpy(), return_index=True)
            if not len(ids):
                continue
            keys, some = banded(batch.column(1).take(pa.array(first)))
            out = near.blobs(ids, keys, buckets, some)
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([d for _, d in out], pa.binary())], ["bucket", "data"])

    return run


def plain(line: Column) -> Column:
    """A line as it is named: without ASCII blanks around it. Names keep the case; shingles count A-Z as a-z."""
    # Trimming walks through all of a line; most have no blank at either end, which is soon seen.
    ends = functools.reduce(Column.__or__, [F.startswith(line, F.lit(b)) | F.endswith(line, F.lit(b)) for b in _BLANKS])
    return F.when(ends, F.trim(line, F.lit(_BLANKS))).otherwise(line)


def _of_text() -> Column:
    """With doc_id, what tells a row's text from those of other rows."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def split(docs: DataFrame) -> DataFrame:
    """(doc_id, own, line, id, chk, text) of every line with words: its document's id and text, its place, counted from 0,
    and its name."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _of_text().alias("own"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "raw"))
    return rows.withColumn("text", plain(F.col("raw"))).filter("text <> ''").select("doc_id", "own", "line", *near.names(F.col("text")), "text")


def places(docs: DataFrame, *, percent: int = 80, miss: float = 1e-7) -> DataFrame:
    """(doc_id, own, line, rid, rchk) of every line with words: its place and the name of its component; written."""
    spark = docs.sparkSession
    lines = split(docs)
    # Where each line is and its name: small beside the texts, counted at once and joined later.
    named, named_path = written(lines.select("doc_id", "own", "line", "id", "chk"), "line-names")
    buckets = near.bucket_count(spark, named.count(), BANDS)
    found, path = written(near.groups(lines.select("id", "text").mapInArrow(_entries(buckets), "bucket int, data binary")), "line-groups")
    linker = near.Linker(found, lines.select("id", "text"), shingles, n=BANDS * ROWS, linked=lambda c, a, b: 100 * c >= percent * (a + b - c), threshold=percent / 100, described=described, many=many_shingles, miss=miss)
    placed = named.join(linker.named(), ["id", "chk"], "left").select("doc_id", "own", "line", F.coalesce("rid", "id").alias("rid"), F.coalesce("rchk", "chk").alias("rchk"))
    out, _ = written(placed, "line-places")
    remove(spark, path, named_path)
    return out


def removed(placed: DataFrame) -> DataFrame:
    """(doc_id, own, removed): places of the lines that go, in order, for each text that has some. The first line of a
    component stays."""
    several = placed.groupBy("rid", "rchk").agg(F.min(F.struct("doc_id", "own", "line")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Written, so that the join on it has two plain shuffles, which adaptive execution can split at a common line.
    several, _ = written(several.select("rid", "rchk", "first"), "line-firsts")
    gone = placed.join(several, ["rid", "rchk"]).filter(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("own") == F.col("first.own")) & (F.col("line") == F.col("first.line"))))
    return gone.groupBy("doc_id", "own").agg(F.array_sort(F.collect_set("line")).alias("removed"))


def deduplicated(docs: DataFrame, *, least_words: int = 1, told: bool = False, **options) -> DataFrame:
    """docs with the texts that are left, all columns as they were; with `told` also `removed_lines`, the places of the
    lines that went (null: none).

    Of each component of near-equal lines one line stays, the first by doc_id (null first) and place; of texts with one
    doc_id (or none) the order is that of their hashes. A document that loses lines and keeps fewer than `least_words` words
    goes (0: none goes); one that loses none stays as it is. Rows that repeat both doc_id and text are one document: what is
    first in one of them stays in each. A null text stays null.
    """
    # Of the two sides, the places that go are the small one; so the texts are not sorted.
    gone = removed(places(docs, **options)).toDF("_tf_id", "_tf_own", "_tf_gone").hint("shuffle_hash")
    rows = docs.withColumn("_tf_of", _of_text())
    rows = rows.join(gone, F.col("doc_id").cast("bigint").eqNullSafe(F.col("_tf_id")) & (F.col("_tf_of") == F.col("_tf_own")), "left")
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("_tf_gone", i))
    none = F.col("_tf_gone").isNull()
    rows = rows.withColumn("text", F.when(none, F.col("text")).otherwise(F.array_join(kept, "\n")))
    if least_words:
        rows = rows.filter(none | (F.size(words_of(F.col("text"))) >= least_words))
    return rows.withColumn("removed_lines", F.col("_tf_gone")).drop("_tf_id", "_tf_own", "_tf_of", "_tf_gone") if told else rows.drop("_tf_id", "_tf_own", "_tf_of", "_tf_gone")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document: its lines with words that are left, how many went and their places, and the text's SHA-256."""
    rows = deduplicated(documents(spark, sf_dir).select("doc_id", "text"), least_words=0, told=True)
    left = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.ltrim(x, F.lit(_BLANKS)) != ""))
    shown = F.coalesce(F.array_join(F.transform("removed_lines", lambda i: i.cast("string")), ","), F.lit(""))
    return rows.select("doc_id", left.cast("bigint").alias("n_left"), F.coalesce(F.size("removed_lines"), F.lit(0)).cast("bigint").alias("n_removed"), shown.alias("removed_lines"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Exact sets; pairs share one of the rarest shingles that any pair at the threshold must share. For small tables.
ORACLE = f"""
WITH RECURSIVE docs AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
raw AS (SELECT doc_id, unnest(parts) AS part, unnest(range(0, len(parts))) AS line FROM docs),
lines AS (SELECT doc_id, line, trim(part, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM raw),
named AS (SELECT doc_id, line, dense_rank() OVER (ORDER BY t) AS k, t FROM lines WHERE t <> ''),
plain AS (SELECT k, translate(any_value(t), '{_LETTERS}', '{_LETTERS.lower()}') AS t FROM named GROUP BY k),
shingled AS (SELECT DISTINCT k, CASE WHEN length(t) < 5 THEN t ELSE substr(t, i, 5) END AS s FROM (SELECT k, t, unnest(range(1, greatest(length(t) - 4, 1) + 1)) AS i FROM plain)),
numbered AS (SELECT k, dense_rank() OVER (ORDER BY s) AS s, count(*) OVER (PARTITION BY s) AS often FROM shingled),
sets AS (SELECT k, list(s) AS set, count(*) AS n FROM numbered GROUP BY k),
ranked AS (SELECT k, s, row_number() OVER (PARTITION BY k ORDER BY often, s) AS r FROM numbered),
prefix AS (SELECT k, s, n FROM ranked JOIN sets USING (k) WHERE r <= n - (80 * n + 99) // 100 + 1),
pairs AS (SELECT DISTINCT a.k AS x, b.k AS y FROM prefix a JOIN prefix b ON a.s = b.s AND a.k < b.k AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
links AS (
  SELECT x, y FROM (SELECT x, y, a.n + b.n AS n, len(list_intersect(a.set, b.set)) AS c FROM pairs JOIN sets a ON a.k = x JOIN sets b ON b.k = y)
  WHERE 100 * c >= 80 * (n - c)),
ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reached AS (SELECT k, k AS other FROM plain UNION SELECT r.k, b.y FROM reached r JOIN ways b ON b.x = r.other),
rooted AS (SELECT k, min(other) AS root FROM reached GROUP BY k),
firsts AS (SELECT doc_id, line, row_number() OVER (PARTITION BY root ORDER BY doc_id, line) AS turn FROM named JOIN rooted USING (k)),
gone AS (SELECT doc_id, list(DISTINCT line ORDER BY line) AS removed FROM firsts WHERE turn > 1 GROUP BY doc_id),
kept AS (
  SELECT d.doc_id, coalesce(removed, []) AS removed,
         CASE WHEN removed IS NULL THEN coalesce(text, '') ELSE array_to_string([p FOR p, i IN parts IF NOT list_contains(removed, i - 1)], chr(10)) END AS text
  FROM docs d LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) AS BIGINT) AS n_left,
       CAST(len(removed) AS BIGINT) AS n_removed, array_to_string(removed, ',') AS removed_lines, sha256(text) AS kept_sha256
FROM kept
"""
