"""Round trips between blocks of a corpus and global tables.

A block is a run of documents of one task. What it needs of a table over the whole corpus (a count, a name) it asks once
for each of its distinct keys, in one row a bucket; a bucket gathers the rows of all blocks, adds up, and answers each row
with an array in the order in which it was asked. So a key that holds a third of all tokens is one entry a block, a bucket
is as large as its distinct keys, and nothing passes through the driver.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm._common import partitions

#: Entries of a bucket.
ENTRIES = 3_000_000


def packed(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays (or bytes) as one zstd frame; numbers byte by byte, all low ones first, which compresses best."""
    import zstandard

    out = [struct.pack("<i", len(arrays))]
    for x in arrays:
        if isinstance(x, bytes):
            out.append(struct.pack("<bq", 0, len(x)) + x)
        else:
            x = np.ascontiguousarray(x)
            out.append(struct.pack("<bq", x.itemsize, x.nbytes) + x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpacked(data: bytes) -> list:
    """What `packed` packed; numbers as unsigned ones of their size."""
    import zstandard

    raw, out, at = zstandard.ZstdDecompressor().decompress(data), [], 4
    for _ in range(struct.unpack_from("<i", raw)[0]):
        size, n = struct.unpack_from("<bq", raw, at)
        at += 9
        x = raw[at : at + n]
        out.append(np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(size, -1).T).view(f"<u{size}").ravel() if size else x)
        at += n
    return out


def summed(at: np.ndarray, n: int, by: np.ndarray) -> np.ndarray:
    """Sums of whole numbers by index, exact beyond 2 ** 53."""
    out = np.zeros(n, np.uint64)
    np.add.at(out, at, by.astype(np.uint64))
    return out


def in_blocks(make: Callable[[int, list[tuple]], Iterator[pa.RecordBatch]], limit: int):
    """Batches whose last column is a text's bytes, in blocks of `limit` bytes (a longer text is a block of its own):
    make(number, rows). A task that runs again makes the same blocks with the same numbers."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        held = 0
        for batch in it:
            for *more, text in zip(*(c.to_pylist() for c in batch.columns[:-1]), batch.column(batch.num_columns - 1), strict=True):
                text = text.as_py() or b""
                if rows and held + len(text) > limit:
                    yield from make(block, rows)
                    block, held, rows = block + 1, 0, []
                rows.append((*more, text))
                held += len(text)
        if rows:
            yield from make(block, rows)

    return run


def asked(block: int, bucket: np.ndarray, buckets: int, pack: Callable[[int, int], bytes]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, block, data) of entries that are in order of their bucket; pack(start, end) packs some of them."""
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([block], pa.int64()), pa.array([pack(cuts[k], cuts[k + 1])], pa.binary())], ["bucket", "block", "data"])


ASKED = "bucket int, block bigint, data binary"
#: Answers have the block that asked; what a bucket says once has none.
ANSWERED = "bucket int, block bigint, data binary"


def answered(asks: DataFrame, answer: Callable[[int, list[list]], tuple[list[bytes], bytes]]) -> DataFrame:
    """(bucket, block, data): answer(bucket, the unpacked asks) gives the answers in their order, and what the bucket says
    once (with null for a block)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: int | None = None
        blocks: list[int] = []
        held: list[list] = []

        def close() -> Iterator[pa.RecordBatch]:
            said, once = answer(now, held)
            for block, data in [*zip(blocks, said, strict=True), (None, once)]:
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([block], pa.int64()), pa.array([data], pa.binary())], ["bucket", "block", "data"])

        for batch in it:
            for bucket, block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if bucket != now:
                    if held:
                        yield from close()
                    now, blocks, held = bucket, [], []
                blocks.append(block)
                held.append(unpacked(data.as_py()))
        if held:
            yield from close()

    dealt = asks.repartition(partitions(asks.sparkSession), "bucket").sortWithinPartitions("bucket", "block")
    return dealt.mapInArrow(run, ANSWERED)


def by_block(answers: DataFrame, name: str) -> DataFrame:
    """(block, name): a block's answers in order of their buckets; bounded by the block's distinct keys."""
    own = answers.filter("block IS NOT NULL").groupBy("block")
    return own.agg(F.array_sort(F.collect_list(F.struct("bucket", "data")))["data"].alias(name))


def joined(parts: list[bytes] | None, n: int = 0) -> np.ndarray:
    """Answers of one array each, put together."""
    found = [unpacked(x)[n] for x in parts or []]
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def once(answers: DataFrame, names: str, make: Callable[[int, list], dict[str, list]]) -> DataFrame:
    """Rows (of the columns in names) of what buckets said once."""
    fields = [x.split(" ") for x in names.split(", ")]
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                made = make(bucket, unpacked(data.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(made[n], kinds[t]) for n, t in fields], [n for n, _ in fields])

    return answers.filter("block IS NULL").select("bucket", "data").mapInArrow(run, names)
