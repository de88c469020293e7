"""Token counts by a separator scan.

Flat token files have no index: only ids, with an end-of-document id after each text. Files are cut into blocks of equal
size without regard to documents; each block is searched for separators with one vectorised comparison, and documents
that cross blocks are stitched by a prefix scan over the blocks' summaries: the running count of separators numbers the
documents, the running maximum of separator places tells where the open document began.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm._common import documents, partitions, work_path, written
from tallyforge.llm.bpe import _coder, _splitter, vocabulary

#: Tokens of a block; words that a writer remembers.
BLOCK, KNOWN = 1 << 21, 400_000


#: Hadoop's names of stores that Arrow knows by another name.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def arrow_uri(path: str) -> str:
    """A folder as Arrow names it. Token files are flat, which no sink or source of Spark's is, so tasks open them by Arrow:
    in file, hdfs, viewfs, s3 (s3a), gs and abfs (abfss) folders, with the credentials that Arrow finds there."""
    scheme, found, rest = path.partition("://")
    return _SCHEMES.get(scheme.lower(), scheme) + found + rest


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(arrow_uri(path))


_MANIFEST = "file string, ordinal bigint, doc_id bigint, tokens bigint"


def write_tokens(docs: DataFrame, folder: str, *, path: str | None = None, pattern: str | None = None) -> tuple[DataFrame, int, str]:
    """Texts as flat token files in a folder that all executors share; a null text is empty. Gives the manifest (file,
    ordinal, doc_id; and for each file one row of ordinal -1 with its tokens), the separator and the ids' type.

    Each attempt of a task writes a file of its own name, and only files of attempts that succeeded are in the manifest.
    """
    spark = docs.sparkSession
    held = vocabulary(path, pattern)
    end = max(held[0].values(), default=-1) + 1
    kind = "<u2" if end < 1 << 16 else "<u4"
    shared = spark.sparkContext.broadcast(held)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, find = _coder(shared)[0], _splitter(shared.value[1]).findall
        files, root = _file_system(folder)
        files.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}.bin"
        known: dict[str, bytes] = {}
        stop = np.array([end], kind).tobytes()
        n = size = 0

        def code(word: str) -> bytes:
            if len(known) >= KNOWN:
                known.clear()
            got = known[word] = np.array(coder.encode_ordinary(word), kind).tobytes()
            return got

        with files.open_output_stream(f"{root}/{name}") as out:
            for batch in it:
                ids = batch.column(0).to_pylist()
                for text in batch.column(1):
                    get = known.get
                    data = b"".join([get(w) or code(w) for w in find(text.as_py() or "")])
                    out.write(data)
                    out.write(stop)
                    size += len(data) + len(stop)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids)), pa.array(range(n, n + len(ids)), pa.int64()), pa.array(ids, pa.int64()), pa.nulls(len(ids), pa.int64())], ["file", "ordinal", "doc_id", "tokens"])
                n += len(ids)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([-1], pa.int64()), pa.nulls(1, pa.int64()), pa.array([size // len(stop)], pa.int64())], ["file", "ordinal", "doc_id", "tokens"])

    rows, _ = written(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, _MANIFEST), "token-manifest")
    return rows, end, kind


def count_tokens(files: DataFrame, folder: str, separator: int, kind: str = "<u2", *, block: int = BLOCK) -> DataFrame:
    """(file, ordinal, n_tokens, ended) of each document in flat token files, given as rows (file, tokens).

    Separators don't count. Tokens after a file's last separator are one more document with ended false; empty files
    and null sizes have none; files given twice are counted twice.
    """
    width = np.dtype(kind).itemsize

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            at, root = _file_system(folder)
            col = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("copy", "file", "start", "stop", "tokens")]
            for copy, name, start, stop, tokens in zip(*col, strict=True):
                with at.open_input_file(f"{root}/{name}") as f:
                    found = np.flatnonzero(np.frombuffer(f.read_at((stop - start) * width, start * width), kind) == separator) + start
                first, last = (int(found[0]), int(found[-1])) if len(found) else (None, None)
                arrays = [[copy], [name], [start], [tokens], [len(found)], [first], [last], [np.diff(found) - 1]]
                kinds = [pa.int64(), pa.string(), *[pa.int64()] * 5, pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(arrays, kinds, strict=True)], ["copy", "file", "start", "tokens", "n", "first", "last", "inner"])

    cuts = files.filter("tokens > 0").select(F.monotonically_increasing_id().alias("copy"), "file", "tokens").withColumn("start", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tokens") - 1, F.lit(block).cast("bigint"))))
    cuts = cuts.withColumn("stop", F.least(F.col("start") + block, F.col("tokens"))).repartition(partitions(files.sparkSession), "file", "start")
    # Written: summaries are scanned in order by file, and what lies within blocks is joined to them afterwards.
    blocks, _ = written(cuts.mapInArrow(scan, "copy bigint, file string, start bigint, tokens bigint, n bigint, first bigint, last bigint, inner array<bigint>"), "token-blocks")
    before = Window.partitionBy("copy", "file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    final = Window.partitionBy("copy", "file")
    scanned = blocks.drop("inner").withColumns({"base": F.coalesce(F.sum("n").over(before), F.lit(0)), "open": F.coalesce(F.max("last").over(before), F.lit(-1)), "end": F.coalesce(F.max("last").over(final), F.lit(-1)), "all": F.sum("n").over(final)})
    whole = blocks.filter("n > 0").select("copy", "start", "inner").join(scanned.filter("n > 0"), ["copy", "start"])
    whole = whole.select("file", "base", F.posexplode(F.concat(F.array(F.col("first") - F.col("open") - 1), "inner")).alias("i", "n_tokens"))
    whole = whole.select("file", (F.col("base") + F.col("i")).alias("ordinal"), "n_tokens", F.lit(True).alias("ended"))
    rest = scanned.filter((F.col("start") == 0) & (F.col("end") < F.col("tokens") - 1)).select("file", F.col("all").alias("ordinal"), (F.col("tokens") - 1 - F.col("end")).alias("n_tokens"), F.lit(False).alias("ended"))
    return whole.unionByName(rest)


def counted(docs: DataFrame, *, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of every row, counted in token files that are written for it."""
    folder = work_path(docs.sparkSession, "tokens")
    manifest, separator, kind = write_tokens(docs, folder, path=path, pattern=pattern)
    got = count_tokens(manifest.filter("ordinal = -1").select("file", "tokens"), folder, separator, kind)
    # The manifest compresses to next to nothing on disk, so its size there must not make it a broadcast.
    named = manifest.filter("ordinal >= 0").select("file", "ordinal", "doc_id").hint("merge")
    return named.join(got, ["file", "ordinal"]).select("doc_id", "n_tokens")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(documents(spark, sf_dir))
