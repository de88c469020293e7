"""Document fingerprints by winnowing.

Every k-gram of code points is hashed with a polynomial that is built by doubling, each window of w consecutive hashes
keeps its smallest hash, the rightmost one among equal ones, and the position is kept beside it. Two texts that share a
passage of w + k - 1 code points therefore share a fingerprint at that passage; passages under k code points are never
matched by chance of a shorter gram.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm._common import documents, partitions

#: Code points of a gram, a power of two; hashes of a window. Passages of K + W - 1 = 95 code points are sure to meet.
K, W = 32, 64
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Low bits of a window key that hold a place within a segment of a long text.
_BITS = 20
_SPAN = 1 << _BITS
_FORM = np.dtype([("hash", "<u8"), ("pos", "<u4")])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def winnow(text: str, k: int = K, w: int = W) -> np.ndarray:
    """Hashes (44 bits) and code-point positions of a text's fingerprint, by position.

    An empty text has none; one under k code points has the hash of the whole at position 0; one with under w grams is
    one window. k is a power of two.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if not len(codes):
        return np.empty(0, _FORM)
    h, m, b = (codes + np.uint64(1)) * _BASE, 1, _BASE
    with np.errstate(over="ignore"):
        if len(codes) < k:
            for _ in range(2):
                h = np.cumsum(_mixed(h))
            return np.array([(int(_mixed(h[-1:])[0]) >> _BITS, 0)], _FORM)
        while m < k:
            h, m, b = h[:-m] * b + h[m:], 2 * m, b * b
        h = _mixed(h)
    out = []
    for at in range(0, max(1, len(h) - w + 1), _SPAN - w + 1):
        part = h[at : at + _SPAN]
        key = (part >> np.uint64(_BITS) << np.uint64(_BITS)) | np.arange(_SPAN - 1, _SPAN - 1 - len(part), -1).astype(np.uint64)
        span, want = 1, min(w, len(key))
        while 2 * span <= want:
            key, span = np.minimum(key[:-span], key[span:]), 2 * span
        if span < want:
            key = np.minimum(key[: len(key) - (want - span)], key[want - span :])
        key = key[np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))]
        got = np.empty(len(key), _FORM)
        got["hash"] = key >> np.uint64(_BITS)
        got["pos"] = at + _SPAN - 1 - (key & np.uint64(_SPAN - 1)).astype(np.int64)
        out.append(got if not out else got[got["pos"] > out[-1]["pos"][-1]])
    return np.concatenate(out)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of the sorted distinct hashes of two fingerprints; 1 if both are empty."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def packed(fp: np.ndarray) -> str:
    """A fingerprint as base64 of 12 bytes a gram: hash (8) and position (4), little-endian."""
    return base64.b64encode(fp.tobytes()).decode()


def unpacked(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), _FORM)


def fingerprints(docs: DataFrame, *, text: str = "text", k: int = K, w: int = W) -> DataFrame:
    """docs with a column `fingerprint`: array of (hash, pos). A null text counts as empty; any rows and columns pass,
    and a column of that name is replaced."""
    kept = docs.drop("fingerprint")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            got = [winnow(x or "", k, w) for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            flat = np.concatenate(got) if got else np.empty(0, _FORM)
            pairs = pa.StructArray.from_arrays([pa.array(flat["hash"].astype(np.int64)), pa.array(flat["pos"].astype(np.int64))], ["hash", "pos"])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, got)]), pa.int32()), pairs)], [*batch.schema.names, "fingerprint"])

    pair = T.StructType([T.StructField("hash", T.LongType()), T.StructField("pos", T.LongType())])
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("fingerprint", T.ArrayType(pair))]))


def _blocks(ids: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    return np.maximum(np.searchsorted(firsts, ids, "right") - 1, 0)


def beside_next(docs: DataFrame, blocks: int) -> DataFrame:
    """(block, tail, ord, doc_id, text): rows dealt into ranges of doc_id, one a partition, in order within each; the
    first row of the range that follows (after the last: the first of all) stands at the end with tail set.

    Only the smallest id of each range comes to the driver. A null doc_id is before all others.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("ord"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ranks = [i / blocks for i in range(1, blocks)]
    cuts = rows.agg(F.percentile_approx("ord", ranks or [0.5], 10_000).alias("c"), F.min("ord").alias("m")).first()
    cuts = np.unique(np.array([cuts["m"], *(cuts["c"] if ranks else [])] if cuts["m"] is not None else [0], np.int64))

    @F.pandas_udf("int")
    def rough(x):
        import pandas as pd

        return pd.Series(_blocks(x.to_numpy(np.int64), cuts).astype(np.int32))

    firsts = np.array(sorted(r["m"] for r in rows.groupBy(rough("ord").alias("b")).agg(F.min("ord").alias("m")).collect()), np.int64)
    n = max(1, len(firsts))

    @F.pandas_udf("array<int>")
    def where(x):
        import pandas as pd

        ids = x.to_numpy(np.int64)
        own = _blocks(ids, firsts) if len(firsts) else np.zeros(len(ids), int)
        first = np.isin(ids, firsts)
        return pd.Series([[b, (b - 1) % n + n] if f else [b] for b, f in zip(own.tolist(), first.tolist(), strict=True)])

    dealt = rows.withColumn("to", F.explode(where("ord"))).withColumn("block", F.col("to") % n).withColumn("tail", F.col("to") >= n)
    return dealt.drop("to").repartitionById(n, F.col("block")).sortWithinPartitions("block", "tail", "ord", "text")


_RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edit_report(docs: DataFrame, *, k: int = K, w: int = W, blocks: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text (its last quarter replaced from the next document), and how
    alike they are. A null text is empty; equal ids are ordered by text; a lone document is its own next."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        names = [x.strip().split()[0] for x in _RESULT.split(",")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

        def report(one: tuple, other: tuple) -> tuple:
            text, nxt = one[1], other[1]
            q = len(text) // 4
            edited = text[: len(text) - q] + nxt[:q]
            fp = winnow(edited, k, w) if q else one[2]
            return (one[0], len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), packed(one[2]), packed(fp), likeness(one[3], np.unique(fp["hash"])), likeness(one[3], other[3]))

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)], names)
            made.clear()
            return out

        last, held = None, 0
        for batch in it:
            get = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731, B023
            for doc_id, tail, text in zip(get("doc_id").to_pylist(), get("tail").to_pylist(), get("text"), strict=True):
                if tail and last is None:
                    continue
                text = text.as_py()
                fp = winnow(text, k, w)
                here = (doc_id, text, fp, np.unique(fp["hash"]))
                if last is not None:
                    made.append(report(last, here))
                    held += len(last[1])
                    if held > 4_000_000:
                        yield flush()
                        held = 0
                last = None if tail else here
        if made:
            yield flush()

    return beside_next(docs, blocks or partitions(docs.sparkSession)).mapInArrow(run, _RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_report(documents(spark, sf_dir))
