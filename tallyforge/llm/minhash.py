"""Near-duplicate documents: MinHash banding with sequential Bayesian verification.

40 bands of 6 rows find a pair of similarity 0.8 with probability 1 - 5e-6; see tallyforge.llm.near for the
verification and the union-find.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import near
from tallyforge.llm._common import BLANKS, documents, remove, written
from tallyforge.llm.hashing import BASE, Powers, Sums, mixed, table

#: Bands and rows of each; words of a shingle where no contract says otherwise.
BANDS, ROWS, WORDS = 40, 6, 5
_U = np.uint64
_BYTES = table(256)
_BYTES[65:91] = _BYTES[97:123]  # A-Z count as a-z
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_POWERS = Powers()


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of a text's words in their order, A-Z as a-z."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    solid = np.concatenate(([False], ~_BLANK[raw], [False]))
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edges[::2], edges[1::2]
    return mixed(Sums(_BYTES[raw], _POWERS).of(starts, ends) + (ends - starts).astype(np.uint64))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of runs of `words` words; with fewer words the whole as one; without words none."""
    h = word_hashes(text or "")
    if not len(h):
        return h
    n = max(1, len(h) - words + 1)
    out = np.zeros(n, np.uint64)
    for j in range(min(words, len(h))):
        out = mixed(out * _U(BASE) + h[j : j + n])
    return np.unique(out)


def _pass(words: int, buckets: int):
    """(id, chk, doc_id, text) to a row of each document and blobs of band keys."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(kind, doc_id, ids, checks, size, bucket, data):
            n = len(doc_id)
            kinds = [pa.string(), *[pa.int64()] * 4, pa.int32(), pa.binary()]
            cols = [[kind] * n, doc_id, ids, checks, size, bucket, data]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["kind", "doc_id", "id", "chk", "size", "bucket", "data"])

        for batch in it:
            ids = batch.column(0).to_numpy()
            sets = [shingles(x.as_py(), words) for x in batch.column(3)]
            sizes = np.array([len(s) for s in sets], np.int64)
            none = [None] * len(ids)
            if len(ids):
                yield row("doc", batch.column(2).to_pylist(), ids, batch.column(1).to_numpy(), sizes, none, none)
            some = np.flatnonzero(sizes)
            if len(some):
                keys = near.band_keys(near.signatures([sets[i] for i in some.tolist()], BANDS * ROWS), BANDS)
                out = near.blobs(ids[some], keys, buckets)
                none = [None] * len(out)
                yield row("blob", none, none, none, none, *zip(*out, strict=True))

    return run


def _named(docs: DataFrame, *, words: int, percent: int, miss: float) -> DataFrame:
    """(doc_id, id, chk, n_shingles, rid, rchk) of each row, written: its text's name and size, and the name of its
    component (null for an empty set)."""
    buckets = near.bucket_count(docs.sparkSession, docs.count(), BANDS)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(*near.names(text), F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    made, one = written(rows.mapInArrow(_pass(words, buckets), "kind string, doc_id bigint, id bigint, chk bigint, size bigint, bucket int, data binary"), "minhash", by="kind")
    found, two = written(near.groups(made.filter("kind = 'blob'")), "groups")
    linker = near.Linker(found, rows.select("id", "text"), lambda t: shingles(t, words), n=BANDS * ROWS, linked=lambda c, a, b: 100 * c >= percent * (a + b - c), threshold=percent / 100, miss=miss)
    own = made.filter("kind = 'doc'").select("doc_id", "id", "chk", F.col("size").alias("n_shingles")).join(linker.named(), ["id", "chk"], "left")
    some = F.col("n_shingles") > 0  # texts without words share a name, but no component
    out, _ = written(own.withColumns({"rid": F.when(some, F.coalesce("rid", "id")), "rchk": F.when(some, F.coalesce("rchk", "chk"))}), "named-documents")
    remove(docs.sparkSession, one, two)
    return out


def clustered(docs: DataFrame, *, words: int = WORDS, percent: int = 80, miss: float = 1e-7) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row: linked where 100 * common >= percent * union of the sets.

    component_id is the smallest doc_id that links reach; exact copies meet there without being paired. A text that is
    null or without words has an empty set and stands alone. Repeated rows share a component. A null doc_id takes part
    in links but never names a component; alone it has a null component and is kept.
    """
    own = _named(docs, words=words, percent=percent, miss=miss)
    # Written, so that the join on it has two plain shuffles, which adaptive execution can split at a large component.
    least, _ = written(own.filter("rid is not null").groupBy("rid", "rchk").agg(F.min("doc_id").alias("component_id")), "components")
    out = own.join(least, ["rid", "rchk"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, *, words: int = WORDS, percent: int = 80, miss: float = 1e-7) -> DataFrame:
    """docs with one row of each component, the one with the smallest doc_id (of equal ids the smallest text name).

    A row whose doc_id is null stays only where its component has no other; of rows that repeat id and text one stays.
    Rows without words all stay.
    """
    own = _named(docs, words=words, percent=percent, miss=miss).filter("rid is not null")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("doc"), "id", "chk")).alias("first")
    stay, _ = written(own.groupBy("rid", "rchk").agg(first).select(*(F.col(f"first.{c}").alias(f"_tf_{c}") for c in ("none", "doc", "id", "chk"))), "first-documents")
    key = ["_tf_none", "_tf_doc", "_tf_id", "_tf_chk"]
    number, text = F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit(""))
    rows = docs.withColumns(dict(zip(key, [number.isNull(), F.coalesce(number, F.lit(0)), *near.names(text)], strict=True)))
    worded = text.rlike(f"[^{BLANKS}]")
    kept = rows.filter(worded).join(stay, key).dropDuplicates(key).select(docs.columns)
    return kept.unionByName(docs.filter(~worded))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(documents(spark, sf_dir), words=2)


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Exact sets, all pairs that share a shingle, and reachability; for tables of a few thousand documents.
ORACLE = f"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingled AS (
  SELECT DISTINCT rid, CASE WHEN len(w) < 2 THEN w ELSE w[i:i + 1] END AS s
  FROM (SELECT rid, w, unnest(range(1, greatest(len(w), 2))) AS i FROM docs WHERE len(w) > 0)),
numbered AS (SELECT rid, dense_rank() OVER (ORDER BY s) AS s FROM shingled),
sizes AS (SELECT rid, count(*) AS n FROM numbered GROUP BY rid),
common AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM numbered a JOIN numbered b ON a.s = b.s AND a.rid < b.rid GROUP BY ALL),
links AS (
  SELECT x, y FROM common JOIN sizes a ON a.rid = x JOIN sizes b ON b.rid = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reached AS (SELECT rid, rid AS other FROM docs UNION SELECT r.rid, b.y FROM reached r JOIN ways b ON b.x = r.other),
least AS (SELECT r.rid, min(d.doc_id) AS component_id FROM reached r JOIN docs d ON d.rid = r.other GROUP BY r.rid)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM docs JOIN least USING (rid) LEFT JOIN sizes USING (rid)
"""
