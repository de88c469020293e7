"""Incremental ingest of bars: raw rows beside canonical ones, each batch exactly once.

A stream's micro-batch N is written under `batch=N` of four tables in one folder:

* `raw`: the rows as they came, with where they came from and by which rules they were judged;
* `accepted`: those that now stand for their key; of several batches' rows, the last batch's is the current one;
* `rejects`: those that don't, with `fault` (invalid, late, duplicate) and the batch they came in; an accepted row that a
  newer one replaces is rejected as a duplicate in the newer one's batch;
* `audit`: counts by fault and the latest event time. It is written last, and readers see audited batches only.

What a batch writes depends on its rows and on earlier batches alone, and replaces what an attempt that broke off left
under its number. So a batch that runs again changes nothing, and a stream resumes from its checkpoint without losing or
repeating a row. A key includes the event time: a batch looks up earlier rows of its own span of time only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tallyforge.functions.codes import utc_now
from tallyforge.operators.ingest import sane, with_lineage
from tallyforge.sources import files

_FAULTS = ("invalid", "late", "duplicate")
_AUDIT = [T.StructField(n, T.LongType()) for n in ("rows", "accepted", *_FAULTS)] + [T.StructField("latest", T.TimestampType())]
_LINEAGE = [T.StructField("source", T.StringType()), T.StructField("ingested_at", T.TimestampType()), T.StructField("validation_version", T.StringType()), T.StructField("transformation_version", T.StringType())]
_REJECT = [T.StructField("fault", T.StringType()), T.StructField("from_batch", T.LongType())]


@dataclass(frozen=True)
class Ingest:
    """key: columns that name a bar, `at` among them; newest: columns by which the higher row stays (ties: the earlier
    batch's). delay_days: rows that lie further behind the latest time of earlier batches are late (None: none is)."""

    folder: str
    shape: T.StructType
    key: tuple[str, ...]
    newest: tuple[str, ...]
    at: str = "start"
    delay_days: int | None = None
    source: str = "stream"
    validation: str = "v1"
    transformation: str = "t1"

    def __post_init__(self):
        if self.at not in self.key:
            raise ValueError("the key must include the event time")

    def _schema(self, table: str) -> T.StructType:
        own = {"raw": [], "accepted": [], "rejects": _REJECT}
        fields = _AUDIT if table == "audit" else [*self.shape.fields, *_LINEAGE, *own[table]]
        return T.StructType([*fields, T.StructField("batch", T.LongType())])

    def _read(self, spark: SparkSession, table: str, before: int | None = None) -> DataFrame:
        """Rows of audited batches; with `before`, of batches under that number."""
        shape, path = self._schema(table), f"{self.folder}/{table}"
        if not files.exists(spark, path):
            return spark.createDataFrame([], shape)
        rows = spark.read.schema(shape).parquet(path)
        if before is not None:
            return rows.filter(F.col("batch") < before)
        return rows if table == "audit" else rows.join(F.broadcast(self._read(spark, "audit").select("batch")), "batch", "left_semi").select(rows.columns)

    def _write(self, rows: DataFrame, table: str, number: int) -> DataFrame:
        path = f"{self.folder}/{table}/batch={number}"
        rows.write.mode("overwrite").parquet(path)
        return rows.sparkSession.read.schema(rows.schema).parquet(path)

    def raw(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "raw")

    def rejects(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "rejects")

    def audit(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "audit")

    def _current(self, accepted: DataFrame) -> DataFrame:
        """Of each key the row that was accepted last."""
        last = F.row_number().over(Window.partitionBy(*self.key).orderBy(F.desc("batch")))
        return accepted.withColumn("_turn", last).filter("_turn = 1").drop("_turn")

    def canonical(self, spark: SparkSession) -> DataFrame:
        return self._current(self._read(spark, "accepted"))

    def judged(self, spark: SparkSession) -> DataFrame:
        """All rows that came, once each, with `fault` (null: canonical)."""
        columns = [*self.shape.names, "fault"]
        return self.canonical(spark).withColumn("fault", F.lit(None).cast("string")).select(columns).unionByName(self.rejects(spark).select(columns))

    def batch(self, rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        told = with_lineage(rows.select(self.shape.names), self.source, utc_now(), validation=self.validation, transformation=self.transformation)
        raw = self._write(told, "raw", number)
        mark = self._read(spark, "audit", number).agg(F.max("latest")).first()[0]
        first, last = raw.agg(F.min(self.at), F.max(self.at)).first()
        whole = F.lit(True)
        for k in self.key:
            whole = whole & F.col(k).isNotNull()
        late = F.lit(False) if mark is None or self.delay_days is None else F.col(self.at).cast("timestamp") < F.lit(mark) - F.make_dt_interval(F.lit(self.delay_days))
        seen = raw.withColumn("from_batch", F.lit(number).cast("bigint")).withColumn("fault", F.when(~(F.coalesce(sane(), F.lit(False)) & whole), "invalid").when(late, "late"))
        good = seen.filter("fault IS NULL")
        earlier = self._read(spark, "accepted", number).filter(F.col(self.at).between(first, last)).join(good.select(*self.key), list(self.key), "left_semi")
        held = self._current(earlier).withColumnRenamed("batch", "from_batch").withColumn("fault", F.lit(None).cast("string"))
        turn = F.row_number().over(Window.partitionBy(*self.key).orderBy(*(F.desc_nulls_last(n) for n in self.newest), "from_batch"))
        ranked = good.unionByName(held).withColumn("_turn", turn)
        columns = self._schema("raw").names[:-1]
        own = F.col("from_batch") == number
        accepted = self._write(ranked.filter((F.col("_turn") == 1) & own).select(columns).sortWithinPartitions(self.at), "accepted", number)
        lost = ranked.filter("_turn > 1").withColumn("fault", F.lit("duplicate")).drop("_turn")
        rejects = self._write(seen.filter("fault IS NOT NULL").unionByName(lost).select(*columns, "fault", "from_batch"), "rejects", number)
        self._commit(raw, accepted, rejects, number)

    def _commit(self, raw: DataFrame, accepted: DataFrame, rejects: DataFrame, number: int) -> None:
        faults = {r.fault: r["count"] for r in rejects.groupBy("fault").count().collect()}
        taken, latest = accepted.agg(F.count(F.lit(1)), F.max(F.col(self.at).cast("timestamp"))).first()
        one = (raw.count(), taken, *(faults.get(f, 0) for f in _FAULTS), latest)
        self._write(raw.sparkSession.createDataFrame([one], T.StructType(_AUDIT)), "audit", number)

    def start(self, stream: DataFrame) -> StreamingQuery:
        """Ingests what there is by now; run again, it goes on where it stopped."""
        return stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()
