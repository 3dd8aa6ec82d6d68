"""Stateful streams: timers, leases and sessions whose state goes."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from corpusloom.catalog import queries
from corpusloom.streaming import log as L
from corpusloom.streaming import stateful as S

DAY = datetime.datetime(2024, 1, 1)


def at(seconds: float) -> datetime.datetime:
    return DAY + datetime.timedelta(seconds=seconds)


def fed(spark, folder, schema: str, batches: list[list[tuple]]):
    """A stream that reads each list of rows as a batch of its own; the first field is ``at`` in seconds."""
    folder.mkdir()
    for n, rows in enumerate(batches):
        frame = spark.createDataFrame([(at(r[0]), *r[1:]) for r in rows], f"at timestamp, {schema}")
        frame.coalesce(1).write.parquet(str(folder.parent / f"one{n}"))
        (file,) = (folder.parent / f"one{n}").glob("part*.parquet")
        file.rename(folder / f"{n}.parquet")
        os.utime(folder / f"{n}.parquet", (1_700_000_000 + 60 * n,) * 2)
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_bursts_join_wait_and_keep_their_distance():
    assert S.bursts([0, 30, 100], None, 45, 20, 1000) == ([(0, 30, 2, 75), (100, 100, 1, 145)], [], 145)
    assert S.bursts([0, 30, 100], None, 45, 20, 75) == ([], [0, 30, 100], None)  # not yet past
    assert S.bursts([0, 30, 100], None, 45, 20, 76) == ([(0, 30, 2, 75)], [100], 75)
    assert S.bursts([5], 0, 10, 100, 1000) == ([(5, 5, 1, 100)], [], 100)  # quiet, but too soon after the last
    assert S.bursts([5, 90], 0, 10, 100, 1000) == ([(5, 90, 2, 100)], [], 100)  # joins what waits
    assert S.bursts([5, 100], 0, 10, 100, 1000) == ([(5, 5, 1, 100), (100, 100, 1, 200)], [], 200)


def test_debounce_with_late_pushes_and_a_timer_at_the_end(spark, tmp_path):
    batches = [[(0, "a"), (1000, "b"), (30, "a")], [(4000, "b"), (20, "a"), (100, "a")], [(4030, "b")]]
    ending = L.Ending(spark, fed(spark, tmp_path / "in", "k string", batches))
    with L.keyed_state(spark):
        out, progress = L.run(S.debounced(ending.log, "k"), spark, ending=ending)
    got = sorted((r.k, *((x - DAY).total_seconds() for x in (r["first"], r["last"])), r.n, (r.sent - DAY).total_seconds()) for r in out.collect())
    assert got == [("a", 0, 30, 3, 75), ("a", 100, 100, 1, 145), ("b", 1000, 1000, 1, 1045), ("b", 4000, 4030, 2, 4075)]
    # what is left of a key is the time of its last burst
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] <= 2


def test_debounce_by_the_clock(spark, tmp_path):
    log = fed(spark, tmp_path / "in", "k string", [[(0, "a"), (1, "a"), (2, "b")]])
    with L.keyed_state(spark):
        frame = S.debounced(log, "k", quiet_s=2, interval_s=1, by_clock=True)
        stream = frame.writeStream.outputMode("append").format("memory").queryName("clocked").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(60):
            stream.awaitTermination(1)
            found = spark.table("clocked").collect()
            if len(found) == 2:
                break
    finally:
        stream.stop()
    assert sorted((r.k, r.n) for r in found) == [("a", 2), ("b", 1)]
    assert all((r.sent - r["last"]).total_seconds() == 2 for r in found)


def plain_leases(operations: list[dict], lease: int, end: int) -> list[tuple]:
    """One queue's outcome by a plain loop over its operations in order."""
    items, out = {}, []

    def expire(now):
        for until, item in sorted((v["until"], k) for k, v in items.items() if v["status"] == "claimed" and v["until"] < now):
            out.append((until, "expired", item, items[item]["worker"]))
            items[item]["status"] = "todo"

    for o in sorted(operations, key=lambda o: (o["at"], o["seq"])):
        expire(o["at"])
        if o["op"] == "add":
            items.setdefault(o["item"], {"status": "todo", "team": o["team"]})
        elif o["op"] == "claim":
            open_ = [v["team"] for v in items.values() if v["status"] != "done"]
            todo = [(v["team"] is None, open_.count(v["team"]) if v["team"] else 0, v["team"] or "", k) for k, v in items.items() if v["status"] == "todo"]
            for *_, k in sorted(todo)[: o["n"]]:
                items[k] |= {"status": "claimed", "worker": o["worker"], "until": o["at"] + lease}
                out.append((o["at"], "served", k, o["worker"]))
        elif o["item"] in items and items[o["item"]]["status"] != "done":
            v = items[o["item"]]
            own = v["status"] == "claimed" and o["worker"] in (None, v["worker"])
            v["status"] = "done"
            out.append((o["at"], "done" if own else "late", o["item"], o["worker"]))
    expire(end)
    return out


def test_leases_expire_by_a_timer_and_are_served_again(spark, tmp_path):
    op = lambda t, seq, op, item=None, team=None, worker=None, n=None: (t, "q", seq, op, item, team, worker, n)
    batches = [
        [op(0, 1, "add", "x", "big"), op(0, 2, "add", "y", "big"), op(0, 3, "add", "z", "small"), op(0, 4, "add", "x", "small"), op(1, 5, "add", "w")],
        [op(10, 6, "claim", worker="ann", n=2), op(20, 7, "complete", "z", worker="ann")],
        [op(9_000, 8, "add", "zz", "big")],  # moves the watermark past the lease of x
        [op(9_100, 9, "claim", worker="bob", n=1), op(9_200, 10, "complete", "x", worker="ann"), op(9_300, 11, "complete", "x", worker="bob"), op(9_400, 12, "complete", "nothing")],
    ]
    ending = L.Ending(spark, fed(spark, tmp_path / "in", "queue string, seq long, op string, item string, team string, worker string, n long", batches))
    with L.keyed_state(spark):
        out, progress = L.run(S.leased(ending.log, "queue"), spark, ending=ending)
    got = sorted(((r.at - DAY).total_seconds(), r.what, r.item, r.worker) for r in out.collect())
    assert got == [
        (10, "served", "x", "ann"), (10, "served", "z", "ann"), (20, "done", "z", "ann"), (1810, "expired", "x", "ann"),
        (9100, "served", "x", "bob"), (9200, "late", "x", "ann"),
    ]
    before = [p["batchId"] for p in progress]
    assert len(before) > 4  # timers ran in batches without rows


def test_lease_query_is_the_loop(spark, sf):
    from corpusloom.plans.streams import operations

    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("at", F.col("ts").cast("timestamp"))
    of: dict[int, list] = {}
    for r in operations(events).withColumn("at", F.unix_micros("at")).collect():
        of.setdefault(r.user_id, []).append(r.asDict())
    want = sorted((u, *x) for u, rows in of.items() for x in plain_leases(rows, 86_400_000_000, 1 << 62))
    found = queries()["stream_lease"](spark, sf).withColumn("at", F.unix_micros(F.col("at").cast("timestamp")))
    got = sorted((r.user_id, r.at, r.what, r.item, r.worker) for r in found.collect())
    assert len({w[2] for w in want}) == 4 and sorted(got, key=str) == sorted(want, key=str)


def test_sessions_leave_no_state(spark, tmp_path):
    batches = [[(0, 1), (60, 1), (100, 2)], [(9_000, 1), (9_010, 2)], [(20_000, 2)]]
    ending = L.Ending(spark, fed(spark, tmp_path / "in", "user_id long", batches))
    out, progress = L.run(L.sessions(ending.log, "30 minutes"), spark, ending=ending)
    got = sorted((r.user_id, (r.start - DAY).total_seconds(), r.n) for r in out.collect())
    assert got == [(1, 0, 2), (1, 9_000, 1), (2, 100, 1), (2, 9_010, 1), (2, 20_000, 1)]
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in progress]
    assert max(rows) < 5 and rows[-1] == 0


@pytest.mark.parametrize("n_items", [5, 400])
def test_replay_writes_the_touched_items_alone(spark, tmp_path, n_items):
    first = [(k, 1, k, k, "C", 0.1) for k in range(n_items)]
    batches = [first, [(20_000, 1, 9_000, 3, "W", None)], [(40_000, 1, 9_001, 3, "C", 0.5)]]
    log = fed(spark, tmp_path / "in", "uid long, event_id long, k long, res string, bf double", batches)
    with L.keyed_state(spark):
        out, progress = L.run(S.replayed(log), spark, "update")
    assert out.where("_batch = 2 and k = 3").count() == 1
    # a later batch with one attempt updates a fixed number of rows, however many items there are
    assert progress[2]["stateOperators"][0]["numRowsUpdated"] <= 8


class CountedMap(dict):
    """A state map in memory that counts how often it is asked."""

    calls = 0

    def __getattribute__(self, name):
        if name in ("containsKey", "getValue", "updateValue", "removeKey", "iterator", "values", "exists"):
            CountedMap.calls += 1
        return super().__getattribute__(name)

    containsKey, getValue, updateValue = dict.__contains__, dict.get, dict.__setitem__
    exists = dict.__len__

    def removeKey(self, key):
        self.pop(key, None)

    def iterator(self):
        return iter(list(self.items()))


class Held:
    """What a processor asks of its handle, for one key."""

    def __init__(self):
        self.timers = []

    def getMapState(self, *_):
        return CountedMap()

    def registerTimer(self, at):
        self.timers.append(at)


class Clock:
    getCurrentProcessingTimeInMs = getCurrentWatermarkInMs = staticmethod(lambda: 0)


def test_a_batch_of_operations_asks_the_state_for_what_it_changes():
    from types import SimpleNamespace as Op

    one, CountedMap.calls = S.Leases("queue", 1_000, False), 0
    one.init(Held())
    ops = [Op(at_us=k, seq=k, op=("add", "claim", "complete")[k % 3], item=f"i{k % 5}", team="t", worker="w", n=1) for k in range(3_000)]
    plain = plain_leases([dict(vars(o), at=o.at_us) for o in ops], 1_000, 0)
    got = list(one.handleInputRows(("q",), ops, Clock))
    assert sorted((r.at_us, r.what, r.item, r.worker) for r in got) == sorted(plain) and len(got) > 5
    assert CountedMap.calls < 50  # two maps, and the five items
    assert len(one.handle.timers) <= 5


def test_first_attempts_of_a_user_ask_for_no_item():
    from types import SimpleNamespace

    class Asked:
        """State values and maps in memory that count how often they are asked."""

        calls = 0

        def __init__(self, empty=None):
            self.empty = self.value = empty
            self.kept = {}

        def get(self):
            Asked.calls += 1
            return self.value

        def exists(self):
            Asked.calls += 1
            return bool(self.value)

        def update(self, value):
            Asked.calls, self.value = Asked.calls + 1, value

        def clear(self):
            self.update(self.empty)

        put = update

        def getValue(self, key):
            Asked.calls += 1
            return self.kept.get(key)

        def updateValue(self, key, value):
            Asked.calls += 1
            self.kept[key] = value

    handle = SimpleNamespace(getMapState=lambda *_: Asked(), getValueState=lambda *_: Asked(), getListState=lambda *_: Asked(()))
    clock, one = SimpleNamespace(getCurrentWatermarkInMs=lambda: 0), S.Replay()
    one.init(handle)
    row = lambda k: S.Row(uid=1, at_us=k, event_id=k, k=k % 50 if k % 7 else None, res="CWD"[k % 3], bf=None if k % 2 else 0.2)
    states: dict = {}
    list(one.handleInputRows((1,), map(row, range(100)), clock))
    assert Asked.calls <= 3  # before: also once for each of the items
    got = list(one.handleInputRows((1,), [row(100)], clock))
    assert [r.k for r in got] == [0] and got[0].last == 100 and Asked.calls <= 6  # nothing is settled yet
    clock.getCurrentWatermarkInMs = lambda: 1  # all is settled
    list(one.handleInputRows((1,), [row(2000)], clock))
    got = list(one.handleInputRows((1,), [row(3000)], clock))
    S.played(states, 0, [tuple(row(k))[1:] for k in [*range(101), 2000, 3000]])
    k = 3000 % 50
    assert [[r.stab, r.diff, r.reps, r.lapses, r.last] for r in got if r.k == k] == [states[k]]
