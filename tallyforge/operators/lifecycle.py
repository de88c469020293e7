"""Replay of the listing lifecycle: events of an instrument folded in order into its state and the rejected events.

Events: (id, seq, op, at_utc, exchange_id, ticker, name, asset_type, currency, on_date). Operations: register, list,
suspend, resume, delist, rename, change_ticker, transfer, reclassify. An event that is not valid (kind `validation`) or
not allowed in the present status (kind `state`) is rejected whole and changes nothing.

Texts are judged and cleaned as column expressions. What a status allows is one small function, `step`, which runs over
events sorted by id and seq and holds one state at a time, however long an id's history is. The streams use it too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import codes
from tallyforge.functions.codes import DELISTED, LISTED, PENDING, SUSPENDED

OPS = ("register", "list", "suspend", "resume", "delist", "rename", "change_ticker", "transfer", "reclassify")
FIELDS = {"exchange_id": "string", "ticker": "string", "name": "string", "asset_type": "int", "currency": "string", "status": "int", "listed_on": "date", "delisted_on": "date", "created_at_utc": "timestamp", "updated_at_utc": "timestamp"}
#: The same as they are held between events: days and microseconds since 1970.
HELD = {n: {"date": "int", "timestamp": "bigint"}.get(t, t) for n, t in FIELDS.items()}
EVENT = ("op", "at_utc", "exchange_id", "ticker", "name", "asset_type", "currency", "on_date")
_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}


def cleaned(events: DataFrame) -> DataFrame:
    """(id, seq, then EVENT): texts as they would be stored, null where they break a rule; the day and the time as numbers."""
    c = F.col
    return events.select(
        "id", c("seq").cast("bigint").alias("seq"), "op", F.unix_micros(c("at_utc").cast("timestamp")).alias("at_utc"),
        F.when(~codes.is_nil(c("exchange_id")), F.lower(codes.trimmed(c("exchange_id")))).alias("exchange_id"),
        codes.ticker(c("ticker")).alias("ticker"), codes.name(c("name"), 300).alias("name"), F.coalesce(c("asset_type").cast("int"), F.lit(0)).alias("asset_type"),
        codes.currency(c("currency")).alias("currency"), F.unix_date(c("on_date")).alias("on_date"),
    )


def step(s: dict | None, op: str | None, at: int | None, venue: str | None, ticker: str | None, name: str | None, kind: int, currency: str | None, day: int | None) -> tuple[dict | None, str | None]:
    """State after one cleaned event, and why the event is rejected (then the state is as before). Checks are in the order
    of the rules."""
    if op == "register":
        if None in (venue, ticker, currency, name, at):
            return s, "validation"
        if s is not None:
            return s, "state"
        return dict(zip(FIELDS, (venue, ticker, name, kind, currency, PENDING, None, None, at, at), strict=True)), None
    if s is None:
        return s, "state"
    now, fault, new = s["status"], None, {}
    if op == "list":
        fault, new = "state" if now != PENDING else "validation" if day is None else None, {"status": LISTED, "listed_on": day}
    elif op == "suspend":
        fault, new = "state" if now != LISTED else None, {"status": SUSPENDED}
    elif op == "resume":
        fault, new = "state" if now != SUSPENDED else None, {"status": LISTED}
    elif op == "delist":
        early = day is None or (s["listed_on"] is not None and day < s["listed_on"])
        fault, new = "state" if now in (PENDING, DELISTED) else "validation" if early else None, {"status": DELISTED, "delisted_on": day}
    elif op == "rename":
        fault, new = "validation" if name is None else None, {"name": name}
    elif op == "change_ticker":
        fault, new = "validation" if ticker is None else "state" if now == DELISTED else None, {"ticker": ticker}
    elif op == "transfer":
        fault, new = "validation" if venue is None else "state" if now == DELISTED else None, {"exchange_id": venue}
    elif op == "reclassify":
        fault, new = "validation" if kind == 0 or kind not in codes.ASSET_TYPES else None, {"asset_type": kind}
    else:
        fault = "validation"
    fault = fault or ("validation" if at is None or at < s["created_at_utc"] else None)
    return (s, fault) if fault else (s | new | {"updated_at_utc": at}, None)


def _stepped(id_type: str) -> tuple[Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], str]:
    """Steps over batches of (id, seq, start, then EVENT) in order of id and seq, and the shape of what they give."""
    own = {"seq": "bigint", "op": "string", "kind": "string", "last": "boolean"} | HELD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind_of_id, open_row, here, state = None, None, object(), None

        def batch(rows: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [kind_of_id, *(_ARROW[t] for t in own.values())], strict=True)], ["id", *own])

        for part in batches:
            kind_of_id, rows = part.schema.field(0).type, []
            for id_, seq, start, *event in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if id_ != here:
                    here, state = id_, None
                    if open_row:
                        open_row[4] = True
                if start is not None:
                    state = start if start["status"] is not None else None
                    continue
                state, fault = step(state, *event)
                if open_row:
                    rows.append(open_row)
                open_row = [id_, seq, event[0], fault, False, *(state or dict.fromkeys(FIELDS)).values()]
            if rows:
                yield batch(rows)
        if open_row:
            open_row[4] = True
            yield batch([open_row])

    return run, ", ".join(f"{n} {t}" for n, t in ({"id": id_type} | own).items())


def stepped(events: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """(id, seq, op, kind, last, then HELD) of each cleaned event: why it was rejected (null: it stands), whether it is the
    last of its id, and the state after it. Ids begin as in `starts` (id, then HELD), the others unregistered."""
    shape = "struct<" + ",".join(f"{n}:{t}" for n, t in HELD.items()) + ">"
    rows = events.select("id", "seq", F.lit(None).cast(shape).alias("start"), *EVENT)
    if starts is not None:
        rows = rows.unionByName(starts.select("id", F.struct(*HELD).alias("start")), allowMissingColumns=True)
    run, out = _stepped(events.schema["id"].dataType.simpleString())
    return rows.repartition("id").sortWithinPartitions("id", F.col("start").isNull(), "seq", *EVENT).mapInArrow(run, out)


def typed(rows: DataFrame) -> DataFrame:
    """HELD columns as FIELDS."""
    back = {"date": F.date_from_unix_date, "timestamp": F.timestamp_micros}
    return rows.withColumns({n: back[t](n) for n, t in FIELDS.items() if t in back})


def outcomes(events: DataFrame) -> DataFrame:
    """(id, seq, op, kind, last, then FIELDS) of each event: why it was rejected (null: it stands), whether it is the last of
    its id, and the state after it. Events of equal seq are taken in the order of their other fields, as cleaned."""
    return typed(stepped(cleaned(events)))


def fold(events: DataFrame) -> DataFrame:
    """(id, state, rejects) of each id, its rejects in one array; `states` and `rejects` give the same row by row."""
    reject = F.when(F.col("kind").isNotNull(), F.struct("seq", "op", "kind"))
    done = outcomes(events).groupBy("id").agg(F.max_by(F.struct(*FIELDS), "last").alias("state"), F.array_sort(F.collect_list(reject)).alias("rejects"))
    return done.select("id", "state", "rejects")


def states(events: DataFrame) -> DataFrame:
    """Instruments as they are after their events; an id that was never registered has none."""
    return outcomes(events).filter("last AND status IS NOT NULL").select("id", *FIELDS)


def rejects(events: DataFrame) -> DataFrame:
    """(id, seq, op, kind) of the events that were refused."""
    return outcomes(events).filter("kind IS NOT NULL").select("id", "seq", "op", "kind")


def registered_exchanges(requests: DataFrame) -> DataFrame:
    """Requests (id, code, name, time_zone_id, mic, at_utc) as exchange rows with `fault`, null where all rules hold."""
    c = F.col
    good = ~codes.is_nil(c("id")) & codes.exchange_code(c("code")).isNotNull() & codes.name(c("name"), 200).isNotNull() & codes.is_time_zone(c("time_zone_id")) & ~codes.mic_is_bad(c("mic")) & c("at_utc").isNotNull()
    fault = F.when(~good, F.lit("validation"))
    return requests.select("id", codes.exchange_code(c("code")).alias("code"), codes.name(c("name"), 200).alias("name"), "time_zone_id", codes.mic(c("mic")).alias("mic"), c("at_utc").alias("created_at_utc"), c("at_utc").alias("updated_at_utc"), fault.alias("fault"))


def renamed_exchanges(exchanges: DataFrame, renames: DataFrame) -> DataFrame:
    """exchanges after the last valid rename of each, from (id, seq, name, at_utc); invalid ones change nothing."""
    valid = renames.join(exchanges.select("id", "created_at_utc"), "id").filter(codes.name(F.col("name"), 200).isNotNull() & (F.col("at_utc") >= F.col("created_at_utc")))
    last = valid.groupBy("id").agg(F.max_by(F.struct(codes.name(F.col("name"), 200).alias("n"), "at_utc"), "seq").alias("r"))
    out = exchanges.join(last, "id", "left").withColumns({"name": F.coalesce("r.n", "name"), "updated_at_utc": F.coalesce("r.at_utc", "updated_at_utc")})
    return out.select(exchanges.columns)
