"""A snapshot store: a unit of work is validated, written as a new directory, and made current by one pointer file.

Readers follow the pointer, so they see all tables of a commit or none. Nothing offers to delete rows. Pointers are
numbered and never overwritten: of two writers that started from one snapshot, the second is refused.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import audits
from tallyforge.sources.schemas import TABLES


class Rejected(Exception):
    """A commit would break a constraint; nothing was written."""


class Conflict(Exception):
    """Another commit came first; nothing was published, and what was staged is staged still."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._staged: dict[str, list[DataFrame]] = {t: [] for t in TABLES}

    def _pointers(self) -> list[str]:
        at = self._path(f"{self.root}/_current")
        return sorted(x.getPath().getName() for x in self._fs.listStatus(at) if x.getPath().getName().isdigit()) if self._fs.exists(at) else []

    def current(self) -> str | None:
        """The name of the current snapshot."""
        last = self._pointers()
        return self.spark.read.text(f"{self.root}/_current/{last[-1]}").first()[0] if last else None

    def read(self, table: str) -> DataFrame:
        at = self.current()
        if at is None:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(f"{self.root}/{at}/{table}")

    def add(self, table: str, rows: DataFrame) -> None:
        """Stages new rows, or rows that replace those of their id, until the commit."""
        self._staged[table].append(rows.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[table].fields]))

    def _working(self, table: str) -> DataFrame:
        have = self.read(table).withColumn("_turn", F.lit(0))
        for turn, rows in enumerate(self._staged[table], 1):
            have = have.unionByName(rows.withColumn("_turn", F.lit(turn)))
        # Within a turn repeated ids stay, for the audit to find; later turns replace earlier ones.
        last = have.groupBy("id").agg(F.max("_turn").alias("_last"))
        return have.join(last, "id").filter("_turn = _last").select([f.name for f in TABLES[table].fields])

    def commit(self) -> int:
        """Validates and publishes what is staged, in both tables at once; gives the number of staged rows."""
        count = sum(rows.count() for staged in self._staged.values() for rows in staged)
        name, turn = f"snapshot-{uuid.uuid4().hex}", len(self._pointers()) + 1
        for table in TABLES:
            self._working(table).write.parquet(f"{self.root}/{name}/{table}")
        new = {t: self.spark.read.schema(s).parquet(f"{self.root}/{name}/{t}") for t, s in TABLES.items()}
        broken = [rule for rule, rows in audits.violations(new["exchanges"], new["instruments"]).items() if not rows.isEmpty()]
        if broken:
            self._fs.delete(self._path(f"{self.root}/{name}"), True)
            self._staged = {t: [] for t in TABLES}
            raise Rejected(", ".join(broken))
        # Written aside and renamed, which fails where the number is taken.
        aside, pointer = self._path(f"{self.root}/_current/.{name}"), self._path(f"{self.root}/_current/{turn:012d}")
        out = self._fs.create(aside, False)
        out.write(name.encode())
        out.close()
        if self._fs.exists(pointer) or not self._fs.rename(aside, pointer):
            self._fs.delete(self._path(f"{self.root}/{name}"), True)
            raise Conflict(f"commit {turn} has been made by another writer")
        self._staged = {t: [] for t in TABLES}
        return count
