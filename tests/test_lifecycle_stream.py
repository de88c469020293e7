"""The lifecycle as a stream against the fold of all its events: late, repeated and broken-off batches."""

from __future__ import annotations

import random

import pytest

from tallyforge.operators import lifecycle
from tallyforge.streaming.lifecycle import Ledger, replay

from .test_reference import EVENTS, event, events_frame

OPS = [o for o in lifecycle.OPS if o != "register"]


def history(seed: int) -> list[dict]:
    """Ids of many events, one of which has a third of all; some are never registered or ask for what is refused."""
    pick, out = random.Random(seed), []
    for i, n in enumerate([40, 20, 20, 12, 12, 8, 8, 1]):
        for k in range(n):
            op = "register" if k == 0 and i != 4 else pick.choice([*OPS, "list", "resume", "register", "fly"])
            out.append(event(k, op, f"i{i}", ticker=pick.choice(["abc", " new ", "a.b", None]), exchange_id=pick.choice(["x1", " X2 ", "", None]) if k else "x", asset_type=pick.choice([0, 1, 2, 9, None])))
            if k == 0:
                out[-1] |= {"ticker": "abc"}
    return out + [event(0, "list", "i1") | {"seq": None}, event(5, "list", None), event(6, "register", None)]


def told(rows):
    return sorted(repr(tuple(r)) for r in rows.collect())


def wanted(spark, events):
    done = lifecycle.outcomes(events_frame(spark, events).distinct())
    return told(done.drop("last")), told(done.filter("last AND status IS NOT NULL").select("id", *lifecycle.FIELDS))


class Broken(Ledger):
    def _commit(self, spark, counts, number):
        if number == 1:
            raise OSError("the machine went away before the batch was audited")
        super()._commit(spark, counts, number)


def test_any_order_over_batches(spark, tmp_path):
    events = history(1)
    mixed = random.Random(2).sample(events, len(events))
    parts = [mixed[:50], mixed[50:90] + mixed[:10], [], mixed[90:] + mixed[90:95], [event(99, "rename", "i0"), event(0, "register", "new")]]
    to = Ledger(str(tmp_path), snapshot_every=2)
    for number, part in enumerate(parts):
        to.batch(events_frame(spark, part), number)
        seen = [e for p in parts[: number + 1] for e in p]
        assert (told(to.outcomes(spark)), told(to.states(spark))) == wanted(spark, seen)
    audit = {r.batch: r for r in to.audit(spark).collect()}
    assert audit[1].replayed_ids > 0 and audit[4].replayed_ids == 0 and audit[4].ids == 2 and audit[3].has_snapshot
    to.batch(events_frame(spark, parts[4]), 4)  # a batch that runs again leaves all as it was
    assert told(to.outcomes(spark)) == wanted(spark, [e for p in parts for e in p])[0]


def test_a_stream_that_broke_off_resumes(spark, tmp_path):
    events = sorted(history(3), key=lambda e: e["seq"] or 0)
    for part in (events[:60], events[60:]):
        events_frame(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    read = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    with pytest.raises(Exception, match="went away"):
        Broken(str(tmp_path)).start(read).awaitTermination()
    to = Ledger(str(tmp_path))
    assert to.audit(spark).count() == 1
    to.start(read).awaitTermination()
    assert (told(to.outcomes(spark)), told(to.states(spark))) == wanted(spark, events)


def test_late_events_of_the_state_store_are_told(spark, tmp_path):
    first = [event(0, "register"), event(5, "list")]
    second = [event(3, "suspend"), event(5, "list"), event(7, "suspend")]
    for part in (first, second):
        events_frame(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = replay(spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in")).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted((r.seq, r.op, r.kind or "", r.status) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(0, "register", "", 0), (3, "suspend", "late", 1), (5, "list", "", 1), (5, "list", "late", 1), (7, "suspend", "", 2)]


def test_no_events(spark, tmp_path):
    none, to = events_frame(spark, []), Ledger(str(tmp_path))
    assert lifecycle.outcomes(none).isEmpty() and lifecycle.fold(none).isEmpty() and to.outcomes(spark).isEmpty() and to.states(spark).isEmpty()
    to.batch(none, 0)
    assert to.outcomes(spark).isEmpty() and to.states(spark).isEmpty()
