"""The lifecycle fold as a stream, by the rules of tallyforge.operators.lifecycle.

`replay` keeps one state an id in the state store and gives each event's outcome at once; an event whose seq is not above
its id's last one is told as `late` and changes nothing.

`Ledger` is right whatever the order in which events arrive: its tables come to what `outcomes` gives for all distinct
events. Micro-batch N is written under `batch=N` of these tables in one folder:

* `events`: the batch's distinct events, cleaned;
* `outcomes`: why each event was rejected, and the state after it;
* `states`: of each id that the batch touched, the state after its last event, that event's seq, and the batch `since`
  which its outcomes hold: an id with late events is replayed whole, and its outcomes of earlier batches no longer count;
* `snapshots`: every few batches, the states of all ids, so that a batch reads the states since the last one only;
* `audit`: counts. It is written last, and readers see audited batches only.

A batch depends on its rows and on earlier batches alone, and replaces what an attempt that broke off left under its
number. Ids without late events go on from their state; only those with late ones are read again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyforge.operators import lifecycle
from tallyforge.operators.lifecycle import EVENT, FIELDS, HELD
from tallyforge.sources import files

#: An event without seq comes before all others of its id.
_FIRST = -(1 << 63)
_OUTPUT = "id string, seq bigint, op string, kind string, status int, ticker string, exchange_id string"
_EVENT = {"seq": "bigint", "op": "string", "at_utc": "bigint", "exchange_id": "string", "ticker": "string", "name": "string", "asset_type": "int", "currency": "string", "on_date": "int"}
_SHAPES = {
    "events": _EVENT,
    "outcomes": {"seq": "bigint", "op": "string", "kind": "string", "last": "boolean"} | HELD,
    "states": HELD | {"last_seq": "bigint", "since": "bigint"},
    "snapshots": HELD | {"last_seq": "bigint", "since": "bigint"},
}
_AUDIT = "events bigint, ids bigint, replayed_ids bigint, has_snapshot boolean"


def replay(events: DataFrame) -> DataFrame:
    """(id, seq, op, kind, status, ticker, exchange_id) for each event of a stream: kind is null where it stands, and the
    rest is the state after it. Events of one batch are sorted by seq; those behind an earlier batch's are `late`."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, last = None, None
        if held.exists:
            *now, last = held.get
            state = dict(zip(FIELDS, now, strict=True)) if now[5] is not None else None
        rows = [r for part in parts for r in part.astype(object).where(part.notna(), None).to_dict("records")]
        rows.sort(key=lambda e: _FIRST if e["seq"] is None else e["seq"])
        before, out = last, []
        for e in rows:
            at = _FIRST if e["seq"] is None else int(e["seq"])
            fault = "late"
            if before is None or at > before:
                state, fault = lifecycle.step(state, *(int(e[n]) if e[n] is not None and _EVENT[n] != "string" else e[n] for n in EVENT))
                last = at
            now = state or {}
            out.append((key[0], e["seq"], e["op"], fault, now.get("status"), now.get("ticker"), now.get("exchange_id")))
        held.update((*(state or dict.fromkeys(FIELDS)).values(), last))
        frame = pd.DataFrame(out, columns=[x.split()[0] for x in _OUTPUT.split(", ")])
        yield frame.astype({"status": "Int32", "seq": "Int64"})

    kept = ", ".join(f"{n} {t}" for n, t in (HELD | {"last_seq": "bigint"}).items())
    return lifecycle.cleaned(events).groupBy("id").applyInPandasWithState(run, _OUTPUT, kept, "append", GroupStateTimeout.NoTimeout)


@dataclass(frozen=True)
class Ledger:
    """snapshot_every: batches between two snapshots of all states; id_type: the type of the ids."""

    folder: str
    snapshot_every: int = 16
    id_type: str = "string"

    def _read(self, spark: SparkSession, table: str, before: int | None = None) -> DataFrame:
        """Rows of audited batches, of those under a number if one is given."""
        shape = _AUDIT if table == "audit" else ", ".join(f"{n} {t}" for n, t in ({"id": self.id_type} | _SHAPES[table]).items())
        shape = T.StructType([*spark.createDataFrame([], shape).schema, T.StructField("batch", T.LongType())])
        path = f"{self.folder}/{table}"
        if not files.exists(spark, path):
            return spark.createDataFrame([], shape)
        rows = spark.read.schema(shape).parquet(path)
        if before is not None:
            rows = rows.filter(F.col("batch") < before)
        return rows if table == "audit" else rows.join(F.broadcast(self._read(spark, "audit").select("batch")), "batch", "left_semi").select(shape.names)

    def _write(self, rows: DataFrame, table: str, number: int) -> DataFrame:
        path = f"{self.folder}/{table}/batch={number}"
        rows.write.mode("overwrite").parquet(path)
        return rows.sparkSession.read.schema(rows.schema).parquet(path)

    def _states(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """The last state row of each id: the last snapshot's, or a later batch's."""
        at = self._read(spark, "audit", before).filter("has_snapshot").agg(F.max("batch")).first()[0]
        at = -1 if at is None else at
        rows = self._read(spark, "states", before).filter(F.col("batch") > at).unionByName(self._read(spark, "snapshots", before).filter(F.col("batch") == at))
        return rows.groupBy("id").agg(F.max_by(F.struct(*_SHAPES["states"]), "batch").alias("s")).select("id", "s.*")

    def batch(self, rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        new = self._write(lifecycle.cleaned(rows).distinct(), "events", number)
        key = F.coalesce("seq", F.lit(_FIRST))
        touched = new.groupBy("id").agg(F.min(key).alias("first"))
        held = self._states(spark, number).withColumnRenamed("id", "_id")
        known = touched.join(held, F.col("id").eqNullSafe(F.col("_id")), "left").withColumn("late", F.coalesce(F.col("first") <= F.col("last_seq"), F.lit(False)))
        known = self._write(known.select("id", "late", *HELD, "since"), "_touched", number)
        ids = known.filter("late").select(F.col("id").alias("_id"))
        again, same = ids.count(), F.col("id").eqNullSafe(F.col("_id"))
        if again:
            old = self._read(spark, "events", number).drop("batch").join(ids, same, "left_semi")
            log = new.join(ids, same, "left_anti").unionByName(new.join(ids, same, "left_semi").unionByName(old).distinct())
        else:
            log = new
        starts = known.filter("NOT late AND status IS NOT NULL").select("id", *HELD)
        done = self._write(lifecycle.stepped(log, starts), "outcomes", number)
        ends = done.filter("last").select("id", *HELD, F.coalesce("seq", F.lit(_FIRST)).alias("last_seq"))
        since = known.select(F.col("id").alias("_id"), F.when(~F.col("late"), F.col("since")).alias("since"))
        ends = ends.join(since, same).select("id", *HELD, "last_seq", F.coalesce("since", F.lit(number).cast("bigint")).alias("since"))
        ends = self._write(ends, "states", number)
        whole = number % self.snapshot_every == self.snapshot_every - 1
        if whole:
            earlier = self._states(spark, number).join(ends.select(F.col("id").alias("_id")), same, "left_anti")
            self._write(earlier.unionByName(ends), "snapshots", number)
        self._commit(spark, (new.count(), ends.count(), again, whole), number)

    def _commit(self, spark: SparkSession, counts: tuple, number: int) -> None:
        self._write(spark.createDataFrame([counts], _AUDIT).coalesce(1), "audit", number)

    def audit(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "audit")

    def outcomes(self, spark: SparkSession) -> DataFrame:
        """(id, seq, op, kind, then FIELDS) of each distinct event, as the whole history has it by now."""
        held = self._states(spark).select(F.col("id").alias("_id"), "since")
        rows = self._read(spark, "outcomes").join(held, F.col("id").eqNullSafe(F.col("_id")) & (F.col("batch") >= F.col("since")))
        return lifecycle.typed(rows).select("id", "seq", "op", "kind", *FIELDS)

    def states(self, spark: SparkSession) -> DataFrame:
        """Instruments as they are now; an id that was never registered has none."""
        return lifecycle.typed(self._states(spark)).filter("status IS NOT NULL").select("id", *FIELDS)

    def start(self, stream: DataFrame) -> StreamingQuery:
        """Takes what events there are by now; run again, it goes on where it stopped."""
        return stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()
