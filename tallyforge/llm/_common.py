"""What the training-data operators share: the shared work folder, cutting of lineage, routing and digests."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the word contracts: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = "\\x20\\x09-\\x0D"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, by the default file system where it names none.
    Where it is unset, a folder of our own in local mode; on a cluster that is an error, as executors would not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tallyforge-"))
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it is named there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files, files.makeQualified(at)


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is deleted when the application ends."""
    files, at = file_system(spark, f"{shared_dir(spark).rstrip('/')}/tallyforge-{name}-{uuid.uuid4().hex[:12]}")
    files.deleteOnExit(at)
    return at.toString()


def remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        files, at = file_system(spark, path)
        files.delete(at, True)


def written(df: DataFrame, name: str, *, by: str | None = None) -> tuple[DataFrame, str]:
    """df as a table in the shared folder: cuts lineage, survives the loss of executors. Also gives its path."""
    spark = df.sparkSession
    path = work_path(spark, name)
    out = df.write.option("compression", "zstd")
    (out.partitionBy(by) if by else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def bucketed(df: DataFrame, name: str, key: str, n: int, *order: str, folder: str | None = None) -> tuple[DataFrame, str]:
    """df as a table in a folder (the shared one), in n buckets of a key (sorted within), so that joins on it need no
    shuffle. Also gives its path. The catalog forgets the table at once: what was read keeps its layout."""
    spark = df.sparkSession
    table = f"tallyforge_{name}_{uuid.uuid4().hex[:12]}"
    path = f"{folder}/{table}" if folder else work_path(spark, name)
    out = df.write.option("compression", "zstd").bucketBy(n, key)
    (out.sortBy(*order) if order else out).option("path", path).saveAsTable(table)
    return _forgotten(spark, table), path


def reopened(spark: SparkSession, path: str, shape: str, key: str, n: int) -> DataFrame:
    """A table that `bucketed` wrote, sorted by its key, in buckets again."""
    table = f"tallyforge_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE TABLE {table} ({shape}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {n} BUCKETS LOCATION '{path}'")
    return _forgotten(spark, table)


def _forgotten(spark: SparkSession, table: str) -> DataFrame:
    found = spark.table(table)
    found.schema  # resolved here
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    return found


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over value, which is computed once a row (a lambda's variable is never inlined)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text as an array; null: none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{BLANKS}]+"), lambda w: w != "")
