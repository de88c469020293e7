"""Aliases and search over instruments (an extension with definitions of our own)."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions.codes import trimmed
from tallyforge.operators.running import running


def alias_key(x: Column) -> Column:
    """A spelling as aliases are compared: trimmed and upper-cased; null for blank."""
    return F.nullif(F.upper(trimmed(x)), F.lit(""))


def holders(aliases: DataFrame) -> DataFrame:
    """(key, begun, instrument): from when on a spelling names an instrument (null: nobody), in stretches that don't overlap.

    A sweep over the starts and ends of a spelling's ranges, in order, which holds the open ranges alone. Ranges that end
    before they begin, and those without a start or a spelling, are left out.
    """
    kind = aliases.schema["valid_from"].dataType
    rows = aliases.select(alias_key(F.col("alias")).alias("key"), "instrument", "valid_from", F.col("valid_to").cast(kind).alias("valid_to")).filter("key IS NOT NULL AND valid_from IS NOT NULL AND (valid_to IS NULL OR valid_to > valid_from)")
    ends = rows.filter("valid_to IS NOT NULL").select("key", F.col("valid_to").alias("begun"), F.lit(None).cast(rows.schema["instrument"].dataType).alias("instrument"), "valid_to", F.lit(0).alias("starts"))
    events = ends.unionByName(rows.select("key", F.col("valid_from").alias("begun"), "instrument", "valid_to", F.lit(1).alias("starts")))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None  # spelling and instant whose events are being read
        said = None
        open_: list[tuple] = []  # the range that began last on top, then the lowest instrument

        def told() -> list[tuple]:
            nonlocal said
            while open_ and open_[0][2] <= now[1]:
                heapq.heappop(open_)
            top = open_[0][1] if open_ else None
            if top == said:
                return []
            said = top
            return [(*now, top)]

        def batch_of(found: list[tuple], shape: pa.Schema) -> pa.RecordBatch:
            key, at, who = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(key, shape.field(0).type), pa.array(at, pa.int64()).cast(shape.field(1).type), pa.array(who, shape.field(2).type)], ["key", "begun", "instrument"])

        shape = None
        for batch in it:
            shape, found = batch.schema, []
            at, to = (batch.column(k).cast(pa.int64()).to_pylist() for k in (1, 3))
            for key, begun, who, end, starts in zip(batch.column(0).to_pylist(), at, batch.column(2).to_pylist(), to, batch.column(4).to_pylist(), strict=True):
                if (key, begun) != now:
                    if now:
                        found += told()
                        if key != now[0]:
                            open_.clear()
                            said = None
                    now = key, begun
                if starts:
                    heapq.heappush(open_, (-begun, who, math.inf if end is None else end))
            if found:
                yield batch_of(found, shape)
        if now and (last := told()):
            yield batch_of(last, shape)

    dealt = events.repartition("key").sortWithinPartitions("key", "begun")
    return dealt.select("key", "begun", "instrument", "valid_to", "starts").mapInArrow(run, T.StructType([events.schema[c] for c in ("key", "begun", "instrument")]))


def resolved(mentions: DataFrame, aliases: DataFrame) -> DataFrame:
    """mentions (mention, alias, at) with the `instrument` that the alias named then; null if none did.

    aliases: (alias, instrument, valid_from, valid_to), valid_to exclusive and null while it is open. Of several ranges
    the one that began last wins, then the lowest instrument. Work is linear in both: a spelling's ranges become stretches
    that don't overlap (`holders`), and each mention takes the last stretch that began by then, month by month.
    """
    at = mentions.schema["at"].dataType
    own = mentions.select(F.struct(*mentions.columns).alias("_own"), alias_key(F.col("alias")).alias("_key"), F.col("at").alias("_at"))
    none = F.lit(None).cast(aliases.schema["instrument"].dataType)
    asked = own.filter("_key IS NOT NULL AND _at IS NOT NULL").select("_key", "_at", F.lit(1).alias("_side"), "_own", none.alias("_who"))
    named = holders(aliases).select(F.col("key").alias("_key"), F.col("begun").cast(at).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(own.schema["_own"].dataType).alias("_own"), F.col("instrument").alias("_who"))
    last = F.when(F.col("_side") == 0, F.struct("_at", "_who"))
    told = running(asked.unionByName(named), ["_key"], F.date_trunc("month", "_at"), ["_at", "_side"], {"_hit": ("max", last)}).filter("_side = 1")
    rest = own.filter("_key IS NULL OR _at IS NULL").select("_own.*", none.alias("instrument"))
    return told.select("_own.*", F.col("_hit._who").alias("instrument")).unionByName(rest)


def search(rows: DataFrame, text: str, *, code: str = "ticker", name: str = "name") -> DataFrame:
    """rows that a typed text may mean, with `place`: 0 its code, 1 begins a code, 2 begins a name, 3 is within a name.
    Case and blanks around the text don't matter; a blank text finds nothing."""
    wanted = alias_key(F.lit(text))
    own, called = alias_key(F.col(code)), alias_key(F.col(name))
    place = F.when(own == wanted, 0).when(F.startswith(own, wanted), 1).when(F.startswith(called, wanted), 2).when(F.contains(called, wanted), 3)
    return rows.withColumn("place", place).filter("place is not null")


def related(instruments: DataFrame, id_) -> DataFrame:
    """The other instruments with the ticker of an id, on any exchange and of any status."""
    one = instruments.filter(F.col("id") == id_).select("ticker").distinct()
    return instruments.join(one, "ticker", "left_semi").filter(F.col("id") != id_)
