"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

1. Each block of documents is split into pre-tokens. A block keeps its distinct words once, and every text becomes the
   sequence of its words' places in that block's list (positions): the pre-aggregation before the shuffle.
2. The blocks' words meet in one shuffle by word (packed by bucket of the word's hash); each distinct word is encoded
   once in the whole corpus.
3. Ids are joined back to (block, place), and the sequences of a block put them together by position.
4. Decoding joins each id to the token-byte table; that table is bounded by the vocabulary.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm._common import bucketed, documents, partitions

#: Code points after which a block of documents is closed; a longer text is a block of its own.
BLOCK_CHARS = 32_000_000
#: Words of a chunk of texts.
CHUNK_WORDS = 1_000_000


def vocabulary(path: str | None = None, pattern: str | None = None) -> tuple[dict[bytes, int], str]:
    """Ranks of a tiktoken file and the pattern that splits text; by default those of public_tokenizers."""
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern


@lru_cache(maxsize=2)
def _splitter(pattern: str):
    import regex

    return regex.compile(pattern, regex.V0)


_CODERS: dict[int, Any] = {}


def _coder(shared) -> tuple[Any, np.ndarray, np.ndarray]:
    """Of a broadcast (ranks, pattern): the encoder, which takes a pre-token as a whole, and the token-byte table (offsets, bytes); built once a worker."""
    key = shared.id if hasattr(shared, "id") else id(shared)
    if key not in _CODERS:
        import tiktoken

        ranks, _ = shared.value
        table = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            table[i] = token
        _CODERS.clear()
        _CODERS[key] = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}), np.cumsum([0, *map(len, table)]), np.frombuffer(b"".join(table), np.uint8)
    return _CODERS[key]


def _gather(flat: np.ndarray, offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The pieces flat[offsets[i]:offsets[i + 1]] for each i of at, one after another."""
    sizes = offsets[at + 1] - offsets[at]
    ends = np.cumsum(sizes)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    return flat[np.repeat(offsets[at] - (ends - sizes), sizes) + np.arange(ends[-1])]


_ROWS = "kind string, block bigint, part bigint, doc_ids array<bigint>, data binary"
_NAMES = ["kind", "block", "part", "doc_ids", "data"]


def _packed(*arrays: np.ndarray | bytes) -> bytes:
    """Whole numbers (or bytes) as one zstd frame; numbers go byte by byte, all low ones first, which compresses best."""
    import zstandard

    out = [struct.pack("<i", len(arrays))]
    for x in arrays:
        if isinstance(x, bytes):
            out.append(struct.pack("<bq", 0, len(x)) + x)
        else:
            x = np.ascontiguousarray(x.astype("<u4"))
            out.append(struct.pack("<bq", 1, x.nbytes) + x.view(np.uint8).reshape(-1, 4).T.tobytes())
    return zstandard.ZstdCompressor(level=3).compress(b"".join(out))


def _unpacked(data: bytes) -> list:
    import zstandard

    raw, out, at = zstandard.ZstdDecompressor().decompress(data), [], 4
    for _ in range(struct.unpack_from("<i", raw)[0]):
        kind, n = struct.unpack_from("<bq", raw, at)
        at += 9
        x = raw[at : at + n]
        out.append(np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view("<u4").ravel() if kind else x)
        at += n
    return out


def _rows(kind: str, block: int, rows: list[tuple]) -> pa.RecordBatch:
    part, ids, data = zip(*rows, strict=True)
    n = len(rows)
    return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.string()), pa.array([block] * n, pa.int64()), pa.array(part, pa.int64()), pa.array(ids, pa.list_(pa.int64())), pa.array(data, pa.binary())], _NAMES)


def _blocks(shared, buckets: int):
    """Texts to rows of two kinds: a block's distinct words by bucket of their hash, and chunks of texts as sequences of
    places, a place being a word's rank in its block by (bucket, first use)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        find = _splitter(shared.value[1]).findall
        # Each block's rows leave one task, and a repeated task gives them the same number: blocks never mix.
        block = TaskContext.get().partitionId() << 32
        places: dict[str, int] = {}
        ids: list = []
        seqs: list[np.ndarray] = []
        chars = 0

        def close() -> Iterator[pa.RecordBatch]:
            words = [w.encode("utf-8", "surrogatepass") for w in places]
            bucket = np.array([zlib.crc32(w) % buckets for w in words], np.int64)
            order = np.argsort(bucket, kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order))
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = []
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                own = [words[i] for i in order[cuts[k] : cuts[k + 1]].tolist()]
                rows.append((k, None, _packed(np.array(list(map(len, own)), np.uint32), b"".join(own))))
            if rows:
                yield _rows("word", block, rows)
            at, size, part = 0, 0, 0
            for i, x in enumerate(seqs):
                size += len(x)
                if size > CHUNK_WORDS or i == len(seqs) - 1:
                    here = seqs[at : i + 1]
                    yield _rows("text", block, [(part, ids[at : i + 1], _packed(np.array(list(map(len, here)), np.uint32), rank[np.concatenate(here)]))])
                    at, size, part = i + 1, 0, part + 1
            places.clear(), ids.clear(), seqs.clear()

        for batch in it:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                if ids and chars + len(text) > BLOCK_CHARS:
                    yield from close()
                    block, chars = block + 1, 0
                put = places.setdefault
                seqs.append(np.array([put(w, len(places)) for w in find(text)], np.uint32))
                ids.append(doc_id)
                chars += len(text)
        if ids:
            yield from close()

    return run


def _encode_words(shared):
    """Rows (block, part, data) of words, in order of part (the bucket): each distinct word of a bucket is encoded once."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared)[0]
        now: int | None = None
        known: dict[bytes, bytes] = {}
        for batch in it:
            for block, part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if part != now:
                    now, known = part, {}
                sizes, flat = _unpacked(data.as_py())
                ends = np.cumsum(sizes.astype(np.int64)).tolist()
                got, at = [], 0
                for end in ends:
                    word = flat[at:end]
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = np.array(coder.encode_ordinary(word.decode()), "<u4").tobytes()
                    got.append(ids)
                    at = end
                out = _packed(np.array(list(map(len, got)), np.uint32) // 4, np.frombuffer(b"".join(got), "<u4"))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([part], pa.int64()), pa.array([out], pa.binary())], ["block", "part", "data"])

    return run


_DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def _put_together(shared, digests: bool):
    """Rows (block, doc_ids, sequences, ids of the block's words by bucket) to ids."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, starts, table = _coder(shared)
        now, words = None, None
        for batch in it:
            for block, ids, data, coded in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3), strict=True):
                if block != now:
                    pairs = [_unpacked(x) for x in coded.as_py() or []]
                    none = [np.empty(0, np.uint32)]
                    now = block
                    words = np.concatenate([[0], np.cumsum(np.concatenate([p[0] for p in pairs] or none).astype(np.int64))]), np.concatenate([p[1] for p in pairs] or none)
                first, second = _unpacked(data.as_py())
                out, at = [], 0
                for doc_id, end in zip(ids.as_py(), np.cumsum(first.astype(np.int64)).tolist(), strict=True):
                    got = _gather(words[1], words[0], second[at:end].astype(np.int64))
                    at = end
                    if digests:
                        back = _gather(table, starts, got.astype(np.int64))
                        out.append((doc_id, len(got), hashlib.sha256(got.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(back.tobytes()).hexdigest()))
                    else:
                        out.append((doc_id, got.astype(np.int32)))
                cols = list(zip(*out, strict=True))
                if digests:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def encode(docs: DataFrame, *, path: str | None = None, pattern: str | None = None, digests: bool = False) -> DataFrame:
    """(doc_id, ids) of every row, or its digests (doc_id, n_tokens, ids_sha256, decoded_sha256).

    A null text is empty and has no ids; repeated rows and equal or null doc_ids stay rows of their own; other columns
    don't matter. No special tokens.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary(path, pattern))
    buckets = partitions(spark)
    # One table, bucketed by block: its sequences meet the ids of their words without being shuffled.
    made = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(_blocks(shared, buckets), _ROWS)
    rows, _ = bucketed(made, "bpe_blocks", "block", buckets)
    words = rows.filter("kind = 'word'").select("block", "part", "data").repartition(buckets, "part").sortWithinPartitions("part", "block")
    coded = words.mapInArrow(_encode_words(shared), "block bigint, part bigint, data binary")
    coded = coded.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("part", "data")))["data"].alias("ids"))
    whole = rows.filter("kind = 'text'").select("block", "doc_ids", "data").join(coded, "block", "left")
    return whole.select("block", "doc_ids", "data", "ids").mapInArrow(_put_together(shared, digests), _DIGESTS if digests else "doc_id bigint, ids array<int>")


def decode(coded: DataFrame, *, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """coded with `decoded`, the bytes of its column `ids` by the token-byte table (bounded by the vocabulary).

    Null ids give null; an id outside the table raises ValueError.
    """
    shared = coded.sparkSession.sparkContext.broadcast(vocabulary(path, pattern))
    kept = coded.drop("decoded")
    at = kept.columns.index("ids")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, starts, table = _coder(shared)
        for batch in it:
            out = []
            for ids in batch.column(at):
                ids = None if not ids.is_valid else np.asarray(ids.values, np.int64)
                if ids is not None and len(ids) and (ids.min() < 0 or ids.max() >= len(starts) - 1):
                    raise ValueError("an id is outside the token-byte table")
                out.append(None if ids is None else _gather(table, starts, ids).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("decoded", T.BinaryType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir), digests=True)
