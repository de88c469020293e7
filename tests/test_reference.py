from __future__ import annotations

import datetime as dt
import itertools
import uuid

import pytest
from pyspark.sql import functions as F

from tallyforge.functions.codes import NIL_UUID
from tallyforge.operators import audits, lifecycle, reads, status
from tallyforge.sources import schemas, snapshots, tables
from tallyforge.streaming import lifecycle as stream

T0 = dt.datetime(2024, 1, 1)
EVENTS = "id string, seq bigint, op string, at_utc timestamp, exchange_id string, ticker string, name string, asset_type int, currency string, on_date date"


def venue(id_="x1", code="XVEN", **k):
    return {"id": id_, "code": code, "name": "Venue", "time_zone_id": "Europe/Oslo", "mic": None, "created_at_utc": T0, "updated_at_utc": T0} | k


def paper(id_, ticker="ABC", status_=1, **k):
    return {"id": id_, "exchange_id": "x1", "ticker": ticker, "name": "Paper", "asset_type": 1, "currency": "USD", "status": status_, "listed_on": dt.date(2024, 1, 2), "delisted_on": None, "created_at_utc": T0, "updated_at_utc": T0} | k


def frame(spark, table, *rows):
    names = schemas.TABLES[table].names
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schemas.TABLES[table])


def test_reads(spark):
    rows = frame(spark, "instruments", paper("a", status_=3), paper("b", created_at_utc=T0 + dt.timedelta(1)), paper("c", "XYZ", 0), paper("d", exchange_id="x2"))
    assert reads.by_id(rows, "a").first().status == 3 and reads.by_id(rows, "q").isEmpty()
    assert reads.active_by_ticker(rows, "x1", "ABC").first().id == "b"
    assert reads.active_by_ticker(rows, "x1", "XYZ").first().id == "c"  # pending counts as active
    assert [r.id for r in reads.ticker_history(rows, "x1", "ABC").collect()] == ["b", "a"]
    assert reads.ticker_is_taken(rows, "x1", "ABC") and not reads.ticker_is_taken(rows.filter("id <> 'b'"), "x1", "ABC")
    assert {(r.exchange_id, r.ticker, r.id) for r in reads.current_holders(rows).collect()} == {("x1", "ABC", "b"), ("x1", "XYZ", "c"), ("x2", "ABC", "d")}
    assert {(r.id, r.turn) for r in reads.histories(rows).collect()} == {("b", 1), ("a", 2), ("c", 1), ("d", 1)}
    venues = frame(spark, "exchanges", venue(), venue("x2", "AAA"))
    assert reads.exchange_by_code(venues, " xven ").first().id == "x1" and reads.exchange_by_code(venues, "x-ven").isEmpty()
    assert [r.code for r in reads.exchanges_listed(venues).collect()] == ["AAA", "XVEN"]


def test_history_ties_are_ordered_by_id(spark):
    rows = frame(spark, "instruments", paper("a", status_=3), paper("b"), paper("c", status_=3))
    assert [r.id for r in reads.ticker_history(rows, "x1", "ABC").collect()] == ["c", "b", "a"]


def test_audits_find_planted_rows(spark):
    rows = frame(spark, "instruments", paper("a"), paper("a", "QQQ"), paper("b"), paper("c", status_=3), paper("d", "ORPH", exchange_id="gone"))
    venues = frame(spark, "exchanges", venue(), venue("x3", "XVEN"), venue("x4", "UNUSED"))
    assert [r.id for r in audits.duplicates(rows, "id").collect()] == ["a"]
    assert [r.id for r in audits.orphans(rows, venues, "exchange_id").collect()] == ["d"]
    assert [r.id for r in audits.referenced(venues, rows, "exchange_id").collect()] == ["x1"]
    assert [(r.ticker, r.n) for r in audits.active_ticker_conflicts(rows).collect()] == [("ABC", 2)]
    assert [r.code for r in audits.duplicates(venues, "code").collect()] == ["XVEN"]
    bad = frame(spark, "instruments", paper("a", asset_type=9), paper("b", status_=8), paper("c", "a.b"), paper("d", delisted_on=dt.date(2023, 1, 1)), paper("e", currency="usd"), paper("f"))
    assert {r.id for r in audits.bad_instruments(bad).collect()} == set("abcde")
    worse = frame(spark, "exchanges", venue(), venue("b", "x"), venue("c", "ABC", mic="AB"), venue("d", "ABD", time_zone_id="No/Where"), venue("e", "ABE", updated_at_utc=T0 - dt.timedelta(1)))
    assert {r.id for r in audits.bad_exchanges(worse).collect()} == set("bcde")


def test_store(spark, tmp_path):
    store = snapshots.Store(spark, f"file://{tmp_path}/store")
    assert store.current() is None and store.read("exchanges").isEmpty()
    store.add("exchanges", frame(spark, "exchanges", venue()))
    store.add("instruments", frame(spark, "instruments", paper("a")))
    assert store.commit() == 2
    assert store.read("instruments").first().ticker == "ABC"
    store.add("instruments", frame(spark, "instruments", paper("b")))
    with pytest.raises(snapshots.Rejected, match="active tickers"):
        store.commit()
    assert store.read("instruments").count() == 1
    # A delisted paper gives its ticker free; the same ticker on another venue is no conflict.
    store.add("exchanges", frame(spark, "exchanges", venue("x2", "OTHER")))
    store.add("instruments", frame(spark, "instruments", paper("a", status_=3)))
    store.add("instruments", frame(spark, "instruments", paper("b"), paper("c", exchange_id="x2")))
    assert store.commit() == 4
    assert {(r.id, r.status) for r in store.read("instruments").collect()} == {("a", 3), ("b", 1), ("c", 1)}
    store.add("instruments", frame(spark, "instruments", paper("e", "ZZZ", exchange_id="gone")))
    with pytest.raises(snapshots.Rejected, match="have an exchange"):
        store.commit()
    assert not any(n.startswith("delete") or n.startswith("remove") for n in dir(snapshots.Store))


def test_migrations_and_retry(spark):
    schemas.migrate(spark, database="mig")
    assert {r.tableName for r in spark.sql("SHOW TABLES IN mig").collect()} >= {"exchanges", "instruments"}
    assert spark.table("mig.instruments").schema.names == schemas.INSTRUMENTS.names
    schemas.migrate(spark, to="1_empty", database="mig")
    assert spark.sql("SHOW TABLES IN mig").filter("not isTemporary").isEmpty()
    waits, left = [], [2]

    def work():
        if left[0]:
            left[0] -= 1
            raise OSError

    assert schemas.with_retry(work, sleep=waits.append) and waits == [2, 4]
    left[0] = 99
    waits.clear()
    assert not schemas.with_retry(work, sleep=waits.append) and waits == [2, 4, 6, 8, 10, 12, 14, 15, 15]


def test_jdbc_options():
    got = tables.jdbc_options({"DB_PASSWORD": " s ", "DB_PORT": " "})
    assert got["url"].endswith("localhost:5432/reference") and got["password"] == "s"
    for bad in ({"DB_PASSWORD": " "}, {"DB_PASSWORD": "s", "DB_PORT": "0"}, {"DB_PASSWORD": "s", "DB_PORT": "x"}):
        with pytest.raises(ValueError):
            tables.jdbc_options(bad)


def test_jdbc_ranges_hold_each_id_once(spark):
    ids = [None, NIL_UUID, "ffffffff-ffff-ffff-ffff-ffffffffffff", *(str(uuid.UUID(int=k << 124)) for k in range(16)), *(str(uuid.UUID(int=(k << 124) - 1)) for k in range(1, 17))]
    rows = spark.createDataFrame([(i,) for i in ids], "id string")
    for parts in (1, 2, 3, 8):
        assert tables.id_ranges(parts) and sum(rows.filter(p).count() for p in tables.id_ranges(parts)) == len(ids)
    with pytest.raises(ValueError, match="one part"):
        tables.id_ranges(0)


def event(seq, op, id_="i", **k):
    return {"id": id_, "seq": seq, "op": op, "at_utc": T0 + dt.timedelta(seq), "exchange_id": "x1", "ticker": "abc", "name": " Name ", "asset_type": 1, "currency": "usd", "on_date": dt.date(2024, 2, 1)} | k


def events_frame(spark, events):
    names = [x.strip().split()[0] for x in EVENTS.split(",")]
    return spark.createDataFrame([tuple(e[n] for n in names) for e in events], EVENTS)


#: Ways into each status.
WAYS = {0: [], 1: ["list"], 2: ["list", "suspend"], 3: ["list", "delist"]}
#: Status after an operation from each status; None: refused for the status.
ALLOWED = {
    "list": [1, None, None, None], "suspend": [None, 2, None, None], "resume": [None, None, 1, None], "delist": [None, 3, 3, None],
    "rename": [0, 1, 2, 3], "change_ticker": [0, 1, 2, None], "transfer": [0, 1, 2, None], "reclassify": [0, 1, 2, 3],
}


def test_every_operation_from_every_status(spark):
    events, want = [], {}
    for start, (op, after) in itertools.product(WAYS, ALLOWED.items()):
        id_ = f"{start}-{op}"
        ops = ["register", *WAYS[start], op]
        events += [event(i, o, id_, ticker="new" if i == len(ops) - 1 else "abc") for i, o in enumerate(ops)]
        want[id_] = (start if after[start] is None else after[start], [] if after[start] is not None else ["state"])
    got = {r.id: (r.state.status, [x.kind for x in r.rejects]) for r in lifecycle.fold(events_frame(spark, events)).collect()}
    assert got == want


def rules():
    yield [event(0, "list")], None, ["state"]
    yield [event(0, "register", ticker="a.b")], None, ["validation"]
    yield [event(0, "register", exchange_id=NIL_UUID)], None, ["validation"]
    yield [event(0, "register"), event(1, "register")], 0, ["state"]
    yield [event(0, "register"), event(1, "list"), event(2, "delist", on_date=dt.date(2024, 1, 31))], 1, ["validation"]
    yield [event(0, "register"), event(1, "list"), event(2, "delist")], 3, []
    yield [event(0, "register"), event(1, "reclassify", asset_type=0)], 0, ["validation"]
    yield [event(0, "register"), event(1, "reclassify", asset_type=9)], 0, ["validation"]
    yield [event(0, "register"), event(1, "rename", name=" ")], 0, ["validation"]
    yield [event(0, "register"), event(1, "list", at_utc=T0 - dt.timedelta(1))], 0, ["validation"]
    yield [event(0, "register"), event(1, "list"), event(2, "delist"), event(3, "transfer", exchange_id=None), event(4, "transfer")], 3, ["validation", "state"]
    yield [event(0, "register"), event(1, "fly")], 0, ["validation"]


def test_rules_and_stream_agree(spark, tmp_path):
    events, want = [], {}
    for i, (ev, status_, kinds) in enumerate(rules()):
        events += [e | {"id": str(i)} for e in ev]
        want[str(i)] = (status_, kinds)
    rows = events_frame(spark, events)
    got = {r.id: (r.state.status, [x.kind for x in r.rejects]) for r in lifecycle.fold(rows).collect()}
    assert got == want
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    read = spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in")
    q = stream.replay(read).writeStream.format("memory").queryName("replayed").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    out = spark.table("replayed").collect()
    assert len(out) == len(events)
    for id_, (status_, kinds) in want.items():
        own = sorted((r for r in out if r.id == id_), key=lambda r: r.seq)
        assert (own[-1].status, [r.kind for r in own if r.kind]) == (status_, kinds)


def test_identity_survives_changes(spark):
    rows = events_frame(spark, [event(0, "register"), event(1, "change_ticker", ticker="new"), event(2, "transfer", exchange_id=" X9 ")])
    one = lifecycle.states(rows).first()
    assert (one.id, one.ticker, one.exchange_id, one.name, one.currency) == ("i", "NEW", "x9", "Name", "USD")
    assert lifecycle.rejects(rows).isEmpty()


def test_exchange_requests(spark):
    rows = spark.createDataFrame([("a", "abc", "N", "Europe/Oslo", " ", T0), ("b", "abc", "N", "No/Where", None, T0), ("c", "abc", "N", "Europe/Oslo", "ABC", T0)], "id string, code string, name string, time_zone_id string, mic string, at_utc timestamp")
    made = lifecycle.registered_exchanges(rows)
    assert {r.id: r.fault for r in made.collect()} == {"a": None, "b": "validation", "c": "validation"}
    renames = spark.createDataFrame([("a", 1, "First", T0), ("a", 2, " Last ", T0 + dt.timedelta(1)), ("a", 3, " ", T0), ("a", 4, "Early", T0 - dt.timedelta(1))], "id string, seq bigint, name string, at_utc timestamp")
    assert lifecycle.renamed_exchanges(made.filter("fault is null").drop("fault"), renames).first().name == "Last"


def test_status_reports(spark):
    empty = status.report(spark.createDataFrame([], "place int, name string, status string, duration_ms double, description string"))
    assert '"status":"Healthy"' in empty.first().json
    broken = spark.createDataFrame([("{}", True), ("not json", True), (None, False)], "json string, live boolean")
    assert {r.status for r in status.services(status.parsed(broken), ["db"]).collect()} == {"unknown"}
    assert reads.liveness(spark).count() == 1 and reads.round_trip(spark).first().one == 1
