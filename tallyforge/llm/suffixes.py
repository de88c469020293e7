"""Repeated byte strings by a logarithmic family of sparse suffix arrays.

Texts are byte strings; every byte goes that lies in a string of `length` bytes that also starts anywhere else.

Suffixes are indexed at anchors only. A window of `length` bytes is owned by the anchor with the smallest hash of GRAM
bytes in it (the rightmost of equal ones), so equal windows have equal anchors at equal offsets, and each anchor owns a
run of window starts. That keeps about two suffixes for each `length - GRAM` bytes; an array of all suffixes would be
eight times the corpus.

1. A batch's suffix array (`Family.add`) has its anchors' suffixes in the order of their bytes (GRAM of them, which is
   where matching starts), each with its count and first position. Arrays are tables in sorted buckets.
2. The new array is merge-scanned (a sort-merge join of buckets that are neither shuffled nor sorted again) against each
   level for suffixes that both have; then it joins the family, and levels of equal rank merge, so that a suffix is
   rewritten log2(batches) times. A family lives in a folder and can be opened again to add batches to it.
3. Matches of GRAM bytes are extended to `length` (`_extended`), in rounds that halve what is unknown twice: a run of
   windows that one anchor owns is told by the bytes that all its windows share. Runs whose whole context occurs again are
   settled at once; runs whose shared bytes occur nowhere else are done; the others are cut into four, whose windows share
   more bytes, until single windows are left. No run meets others in one task: rounds are aggregations and equi-joins.
4. Spans are put together by document and cut out of the text.

Strings are compared by two 64-bit hashes of different bases, together with the places of their windows.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm._common import bucketed, documents, file_system, partitions, reopened, remove, work_path, written
from tallyforge.llm.hashing import Powers, Sums, mixed, table

#: Bytes of a repeated string; of the gram at which a suffix is indexed; batches of the corpus.
LENGTH, GRAM, BATCHES = 200, 32, 4
_U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_TABLES = [table(256, b) for b in _BASES]
_POWERS = [Powers(b) for b in _BASES]
_BITS = 20
_SPAN = 1 << _BITS


def _sums(raw: np.ndarray) -> list[Sums]:
    return [Sums(t[raw], p) for t, p in zip(_TABLES, _POWERS, strict=True)]


def _digests(sums: list[Sums], start: np.ndarray, end: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of each part, together with what tells its place."""
    place = mixed(place.astype(np.uint64) + _U(1))
    return [mixed(s.of(start, end) + place).view(np.int64) for s in sums]


def anchors(raw: np.ndarray, sums: Sums, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window start, windows) of a text of at least `length` bytes, by window start."""
    starts = np.arange(len(raw) - gram + 1)
    h = mixed(sums.of(starts, starts + gram))
    w = length - gram + 1
    out: list[list[np.ndarray]] = [[], [], []]
    for at in range(0, len(h) - w + 1, _SPAN - w + 1):
        part = h[at : at + _SPAN]
        key = (part >> _U(_BITS) << _U(_BITS)) | np.arange(_SPAN - 1, _SPAN - 1 - len(part), -1).astype(np.uint64)
        span = 1
        while 2 * span <= w:
            key, span = np.minimum(key[:-span], key[span:]), 2 * span
        if span < w:
            key = np.minimum(key[: len(key) - (w - span)], key[w - span :])
        cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        out[0].append(at + _SPAN - 1 - (key[cuts] & _U(_SPAN - 1)).astype(np.int64))
        out[1].append(at + cuts)
        out[2].append(np.diff(np.append(cuts, len(key))))
    return tuple(np.concatenate(x) for x in out)


_SUFFIX = "suffix binary, n bigint, doc bigint, at int"
_MEMBER = "suffix binary, doc bigint, mark bigint, at int, low int, high int, c1 bigint, c2 bigint"


def _columns(shape: str) -> tuple[list[str], list[pa.DataType]]:
    kinds = {"binary": pa.binary(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    parts = [x.split() for x in shape.split(", ")]
    return [n for n, _ in parts], [kinds[k] for _, k in parts]


def _batch(shape: str, cols: list) -> pa.RecordBatch:
    names, kinds = _columns(shape)
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def _anchored(length: int, gram: int):
    """(doc, mark, text) to its anchors: place, suffix, and the run of windows by how far before the anchor they begin
    (low to high), with the digest of their bytes."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            parts, size = [], 0
            for doc, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = np.frombuffer(text.as_py().encode("utf-8", "surrogatepass"), np.uint8)
                if len(raw) < length:
                    continue
                sums = _sums(raw)
                at, start, n = anchors(raw, sums[0], length, gram)
                high = at - start
                low = high - (n - 1)
                suffix = np.lib.stride_tricks.sliding_window_view(raw, gram)[at]
                context = _digests(sums, start, start + n - 1 + length, high << 16 | low)
                parts.append((suffix, np.full(len(at), doc), np.full(len(at), mark), at, low, high, *context))
                size += len(at)
                if size > 100_000:
                    yield packed(parts)
                    parts, size = [], 0
            if parts:
                yield packed(parts)

    def packed(parts) -> pa.RecordBatch:
        suffix, *rest = (np.concatenate(c) for c in zip(*parts, strict=True))
        ends = np.arange(len(suffix) + 1, dtype=np.int32) * gram
        return _batch(_MEMBER, [pa.Array.from_buffers(pa.binary(), len(suffix), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(suffix))]), *rest])

    return run


@contextlib.contextmanager
def _sorted_scans(spark: SparkSession):
    """Lets scans of buckets of one file each tell that they are sorted."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Family:
    """Suffix arrays in levels, in a folder that driver and executors share (by default a new one for this application).

    The folder's last manifest names the levels, so that a family can be opened again, and a call that failed leaves the
    family as it was. All batches of a family have one number of buckets and one gram.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, *, buckets: int | None = None):
        self.spark, self.folder = spark, folder or work_path(spark, "suffix-family")
        files, at = file_system(spark, f"{self.folder}/levels-*.json")
        held = sorted(x.getPath().toString() for x in files.globStatus(at) or [])
        state = {"buckets": buckets or partitions(spark), "levels": []}
        for path in reversed(held):  # a writer that was lost may have left its manifest empty
            text = spark.read.text(path, wholetext=True).first()
            if text and text[0].endswith("}"):
                state = json.loads(text[0])
                break
        self.turn, self.buckets = int(held[-1][-13:-5]) if held else 0, state["buckets"]
        self.levels: list[tuple[int, str]] = [tuple(x) for x in state["levels"]]  # (rank, path), largest first

    def array(self, path: str) -> DataFrame:
        return reopened(self.spark, path, _SUFFIX, "suffix", self.buckets)

    def _kept(self, array: DataFrame) -> str:
        """An array as a level's table: one sorted file a bucket, so one task must hold all rows of a bucket."""
        return bucketed(array, "suffixes", "suffix", self.buckets, "suffix", folder=self.folder)[1]

    def _built(self, members: DataFrame) -> str:
        one = members.groupBy("suffix").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "at")).alias("p")).select("suffix", "n", "p.doc", "p.at")
        return self._kept(one if self.buckets == partitions(self.spark) else one.repartition(self.buckets, "suffix"))

    def _merged(self, *paths: str) -> str:
        """Two arrays as one, by a scan along both. (A union of two bucketed scans would claim their partitioning without
        having it, and an aggregation over it would leave equal suffixes apart.)"""
        old, new = (self.array(p).select(F.col("suffix").alias(f"s{k}"), F.col("n").alias(f"n{k}"), F.struct("doc", "at").alias(f"p{k}")) for k, p in enumerate(paths))
        with _sorted_scans(self.spark):
            both = old.join(new.hint("merge"), F.col("s0") == F.col("s1"), "full_outer")
            both = both.select(F.coalesce("s0", "s1").alias("suffix"), (F.coalesce("n0", F.lit(0)) + F.coalesce("n1", F.lit(0))).alias("n"), F.least("p0", "p1").alias("p"))
            return self._kept(both.select("suffix", "n", "p.doc", "p.at"))

    def add(self, members: DataFrame, *, last: bool = False) -> DataFrame:
        """Adds a batch's suffixes (suffix, doc, at); gives those (suffix) that the batch holds twice or a level holds
        too, written. A suffix may come once for each scan that met it. `last`: nothing will be added, so that levels
        need not merge."""
        spark, new = self.spark, self._built(members)
        array = self.array(new)
        with _sorted_scans(spark):
            found = array.filter("n > 1").select("suffix")
            for _, path in self.levels:
                found = found.unionByName(array.select("suffix").join(self.array(path).select("suffix").hint("merge"), "suffix", "left_semi"))
            hits, _ = written(found, "suffix-hits")
        old, self.levels = [], [*self.levels, (0, new)]
        while not last and len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (rank, one), (_, two) = self.levels.pop(), self.levels.pop()
            self.levels.append((rank + 1, self._merged(two, one)))
            old += [one, two]
        self._commit()
        remove(spark, *old)
        return hits

    def _commit(self) -> None:
        self.turn += 1
        state = json.dumps({"buckets": self.buckets, "levels": self.levels})
        files, at = file_system(self.spark, f"{self.folder}/levels-{self.turn:08d}.json")
        if files.exists(at):
            raise RuntimeError(f"another writer has added to {self.folder}")
        out = files.create(at, False)  # fails where the other writer came between
        out.write(state.encode())
        out.close()


_PIECE = "piece bigint, doc bigint, mark bigint, at int, low int, high int, single boolean, bytes binary"
_RUN = "k1 bigint, k2 bigint, c1 bigint, c2 bigint, piece bigint, low int, high int, single boolean"


def _pieces(length: int):
    """(doc, mark, text, runs) to the bytes that each run's windows cover."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out: list[tuple] = []
            for doc, mark, text, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                out += [(0, doc, mark, r["at"], r["low"], r["high"], r["single"], raw[r["at"] - r["high"] : r["at"] - r["low"] + length]) for r in runs]
            if out:
                yield _batch(_PIECE, list(zip(*out, strict=True)))

    return run


def _cut_runs(width: int, length: int, gram: int):
    """(piece, low, high, single, top, bytes) to its runs within `width` offsets, with the digests of the bytes that all
    windows of those offsets share (k1, k2) and of all bytes that the run's own windows have (c1, c2)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not batch.num_rows:
                continue
            piece, low, high, single, top = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            data = batch.column(5)
            ends = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
            sums = _sums(np.frombuffer(data.buffers()[2], np.uint8)[ends[0] : ends[-1]])
            anchor = ends[:-1] - ends[0] + top  # where the anchor would be, from the start of all pieces
            first = low // width
            many = high // width - first + 1
            of = np.repeat(np.arange(len(piece)), many)
            node = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
            a, b = node * width, np.minimum(node * width + width - 1, length - gram)
            lo, hi = np.maximum(low[of], a), np.minimum(high[of], b)
            key = _digests(sums, anchor[of] - a, anchor[of] - b + length, node)
            context = _digests(sums, anchor[of] - hi, anchor[of] - lo + length, hi << 16 | lo)
            yield _batch(_RUN, [*key, *context, piece[of], lo.astype(np.int32), hi.astype(np.int32), single[of]])

    return run


def _settled(rows: DataFrame, key: list[str], own: list[str], name: str) -> tuple[DataFrame, DataFrame, str]:
    """Of runs (key, c1, c2, own, low, high, single): those whose context occurs again, and one run of each context of the
    keys that have several, single if it is not settled yet. Also gives a path that both read."""
    context = [*key, "c1", "c2"]
    counted, path = written(rows.groupBy(*context).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*own, "low", "high", "single")).alias("rep")), name)
    again = rows.filter("single").join(counted.filter("n > 1").select(*context), context, "left_semi").select(*own, "low", "high")
    several = counted.groupBy(*key).agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select(*key)
    rest = counted.join(several, key).select(*(F.col(f"rep.{c}").alias(c) for c in (*own, "low", "high")), ((F.col("n") == 1) & F.col("rep.single")).alias("single"))
    return again, rest, path


def _extended(rows: DataFrame, shared: DataFrame, *, length: int, gram: int) -> tuple[DataFrame, list[str]]:
    """(doc, mark, start, end) of the windows of `shared` anchors that occur again, and the paths that it reads."""
    spans = lambda df: df.select("doc", "mark", (F.col("at") - F.col("high")).alias("start"), (F.col("at") - F.col("low") + length).alias("end"))
    again, rest, path = _settled(shared.withColumn("single", F.lit(True)), ["key"], ["doc", "mark", "at"], "suffix-contexts")
    out, paths = spans(again), [path]
    by_doc = rest.groupBy("doc", "mark").agg(F.collect_list(F.struct("at", "low", "high", "single")).alias("runs"))
    cut = rows.join(by_doc, ["doc", "mark"]).select("doc", "mark", "text", "runs").mapInArrow(_pieces(length), _PIECE)
    pieces, path = written(cut.withColumn("piece", F.monotonically_increasing_id()), "suffix-pieces")
    paths.append(path)
    held, at = pieces.select("piece", F.col("high").alias("top"), "bytes"), pieces.select("piece", "doc", "mark", "at")
    now, width = pieces.select("piece", "low", "high", "single"), 1
    while width * 4 <= length - gram:
        width *= 4
    while width:
        made = now.join(held, "piece").select("piece", "low", "high", "single", "top", "bytes").mapInArrow(_cut_runs(width, length, gram), _RUN)
        made, path = written(made, "suffix-runs")
        again, now, other = _settled(made, ["k1", "k2"], ["piece"], "suffix-contexts")
        paths += [path, other]
        out = out.unionByName(spans(again.join(at, "piece")))
        width //= 4
    return out, paths


def _cut(texts: bool):
    """(doc, text, spans) to the result of each row."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out: list[tuple] = []
            for doc, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                raw = np.frombuffer(text.as_py().encode("utf-8", "surrogatepass"), np.uint8)
                kept, n = raw, 0
                if spans.is_valid:
                    turn = np.zeros(len(raw) + 1, np.int32)
                    flat = spans.values
                    np.add.at(turn, flat.field("start").to_numpy(), 1)
                    np.add.at(turn, flat.field("end").to_numpy(), -1)
                    gone = np.cumsum(turn[:-1]) > 0
                    n = int(np.count_nonzero(np.diff(np.concatenate(([False], gone)).astype(np.int8)) == 1))
                    kept = raw[~gone]
                data = kept.tobytes()
                out.append((doc, len(raw), len(raw) - len(kept), n, data if texts else hashlib.sha256(data).hexdigest()))
            if out:
                kinds = [*[pa.int64()] * 4, pa.binary() if texts else pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def _rows(docs: DataFrame) -> DataFrame:
    """(doc, mark, text): rows of one id are told apart by a hash of their text."""
    text: Column = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_VOID)).alias("doc"), F.xxhash64(text).alias("mark"), text.alias("text"))


_VOID = -(2**63)


def removed(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES, texts: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of each row; kept is the SHA-256 of the bytes left, or the bytes.

    Matches lie within one document each, occurrences may overlap and may be in the same document, and strings are
    judged on the input. A null text is empty; a text under `length` bytes loses nothing; of repeated rows each loses
    what it shares with the others, which is all of it from `length` bytes on. Rows without an id are told apart by 64
    bits of their text.
    """
    spark, rows = docs.sparkSession, _rows(docs)
    members, path = written(rows.mapInArrow(_anchored(length, gram), _MEMBER).withColumn("key", F.xxhash64("suffix")), "suffix-anchors")
    family, hits = Family(spark), None
    for batch in range(batches):
        own = members.filter(F.pmod(F.xxhash64("doc", "mark"), F.lit(batches)) == batch)
        found = family.add(own, last=batch == batches - 1)
        hits = found if hits is None else hits.unionByName(found)
    remove(spark, family.folder)
    # By a digest of the suffix, of which members have 8 bytes instead of GRAM; what shares it is told apart by context.
    # Plain rows on both sides, so that adaptive execution can split a hot suffix.
    hit = hits.select(F.xxhash64("suffix").alias("key"))
    shared, _ = written(members.drop("suffix").join(hit, "key", "left_semi"), "suffix-shared")
    remove(spark, path)
    spans, _ = _extended(rows, shared, length=length, gram=gram)
    spans = spans.groupBy("doc", "mark").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    out = rows.join(spans, ["doc", "mark"], "left").select("doc", "text", "spans").mapInArrow(_cut(texts), f"doc bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept {'binary' if texts else 'string'}")
    return out.select(F.when(F.col("doc") != _VOID, F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(documents(spark, sf_dir)).withColumnRenamed("kept", "kept_sha256")


#: Every window of every text; bytes as two digits each. For small tables.
ORACLE = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
windows AS (SELECT rid, i, md5_number(substr(x, 2 * i + 1, {2 * LENGTH})) AS h FROM (SELECT rid, x, unnest(range(0, CAST(length(x) // 2 - {LENGTH - 1} AS BIGINT))) AS i FROM docs)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY h) AS n FROM windows) WHERE n > 1),
cut AS (SELECT rid, i, coalesce(i > lag(i) OVER w + {LENGTH}, true) AS new FROM again WINDOW w AS (PARTITION BY rid ORDER BY i)),
islands AS (SELECT rid, i, count(*) FILTER (new) OVER (PARTITION BY rid ORDER BY i) AS k FROM cut),
spans AS (SELECT rid, k, min(i) AS a, max(i) + {LENGTH} AS b FROM islands GROUP BY rid, k),
gaps AS (SELECT rid, k, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY k), 0) AS a, a AS b FROM spans),
removed AS (SELECT rid, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last FROM spans GROUP BY rid),
pieces AS (SELECT rid, string_agg(substr(x, 2 * a + 1, 2 * (b - a)), '' ORDER BY k) AS kept FROM gaps JOIN docs USING (rid) GROUP BY rid)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM docs LEFT JOIN removed USING (rid) LEFT JOIN pieces USING (rid)
"""
