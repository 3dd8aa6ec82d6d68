"""Stateful operators with timers and keyed state: debounce, leases, review state by item.

Each is a ``StatefulProcessor`` whose decisions are plain functions over times in
microseconds, so that they run alike on the log's own time (``eventTime``, timers follow
the watermark) and on the clock (``processingTime``).
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from corpusloom.streaming.log import END, LATE, review_start, review_step

# How long after the last record a push waits, the least time between two, and how long a lease holds.
QUIET_S, INTERVAL_S, LEASE_S = 45, 20, 1800
SECOND = 1_000_000


def to_ms(at: int) -> int:
    """The first millisecond after a time in microseconds."""
    return at // 1000 + 1


def bursts(times: list[int], sent: int | None, quiet: int, interval: int, mark: int) -> tuple[list[tuple[int, int, int, int]], list[int], int | None]:
    """Pushes that have gone out by ``mark``: (first, last, number, when), the times still held, and when the last burst went.

    A burst goes out once no push has come for ``quiet`` and ``interval`` has passed since the
    one before; pushes that come earlier join it.
    """
    out, at = [], 0
    while at < len(times):
        last = at
        due = lambda k: times[k] + quiet if sent is None else max(times[k] + quiet, sent + interval)
        while last + 1 < len(times) and times[last + 1] < due(last):
            last += 1
        when = due(last)
        if when >= mark:
            break
        out.append((times[at], times[last], last + 1 - at, when))
        sent, at = when, last + 1
    return out, times[at:], sent


class Debounce(StatefulProcessor):
    """Folds a key's pushes into bursts; a timer sends a burst when no further push comes."""

    def __init__(self, key: str, quiet: int, interval: int, by_clock: bool):
        self.key, self.quiet, self.interval, self.by_clock = key, quiet, interval, by_clock

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "at long")
        self.sent = handle.getValueState("sent", "at long")

    def _now(self, timerValues) -> int:
        return 1000 * (timerValues.getCurrentProcessingTimeInMs() if self.by_clock else timerValues.getCurrentWatermarkInMs())

    def _settle(self, key, times: list[int], mark: int) -> Iterator[Row]:
        sent = self.sent.get()[0] if self.sent.exists() else None
        gone, rest, sent = bursts(sorted(times), sent, self.quiet, self.interval, mark)
        if gone:
            self.sent.update((sent,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if rest:
            self.held.put([(t,) for t in rest])
            # the first burst that is still held goes out then if nothing joins it
            self.handle.registerTimer(to_ms(bursts(rest, sent, self.quiet, self.interval, 1 << 62)[0][0][3]))
        else:
            self.held.clear()
        for first, last, n, when in gone:
            yield Row(**{self.key: key[0], "first_us": first, "last_us": last, "n": n, "sent_us": when})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        mark = self._now(timerValues)
        new = [mark if self.by_clock else r.at_us for r in rows]
        yield from self._settle(key, [t for (t,) in self.held.get()] + new, mark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._settle(key, [t for (t,) in self.held.get()], self._now(timerValues))

    def close(self) -> None:
        pass


def debounced(log: DataFrame, key: str, *, quiet_s: float = QUIET_S, interval_s: float = INTERVAL_S, late: str = LATE, by_clock: bool = False) -> DataFrame:
    """(key, first, last, n, sent): pushes of a key folded until none came for ``quiet_s``, with ``interval_s`` between two bursts at least.

    By the log's time ``at`` a burst is sent when the watermark has passed it, so pushes may
    come in any order up to ``late``; by the clock, when they arrive is what counts.
    """
    kind = log.schema[key].dataType.simpleString()
    log = log.withWatermark("at", late).where(F.col("at") < F.lit(END).cast("timestamp"))
    rows = log.select(key, "at", F.unix_micros("at").alias("at_us"))
    one = Debounce(key, int(quiet_s * SECOND), int(interval_s * SECOND), by_clock)
    out = rows.groupBy(key).transformWithState(one, f"{key} {kind}, first_us long, last_us long, n long, sent_us long", "append", "processingTime" if by_clock else "eventTime")
    return out.select(key, *(F.timestamp_micros(f"{c}_us").alias(c) for c in ("first", "last")), "n", F.timestamp_micros("sent_us").alias("sent"))


class Leases(StatefulProcessor):
    """A work queue: items are added, claimed for a time and completed; a claim that runs out is served again.

    Todo, held and done items are maps of their own, so a timer looks at held items alone.  A
    batch reads the open items once, plays its operations on them in memory and writes what
    changed; of done items, which only grow, it reads those that it touches.
    """

    def __init__(self, key: str, lease: int, by_clock: bool):
        self.key, self.lease, self.by_clock = key, lease, by_clock

    def init(self, handle) -> None:
        self.handle = handle
        self.stored = {
            "todo": handle.getMapState("todo", "item string", "team string"),
            "held": handle.getMapState("held", "item string", "team string, worker string, until long"),
            "done": handle.getMapState("done", "item string", "worker string"),
        }

    def _read(self, *names: str) -> None:
        """Take the state of the key at hand into memory."""
        for name in ("todo", "held"):
            setattr(self, name, {k[0]: tuple(v) for k, v in self.stored[name].iterator()} if name in names else {})
        self.before = {"todo": dict(self.todo), "held": dict(self.held), "done": {}}
        self.done: dict[str, tuple] = {}
        self.undone: set[str] = set()  # items known not to be done
        self.first = min((v[2] for v in self.held.values()), default=None)

    def _write(self) -> None:
        for name, was in self.before.items():
            now = getattr(self, name)
            for item in was.keys() - now.keys():
                self.stored[name].removeKey((item,))
            for item, value in now.items():
                if was.get(item) != value:
                    self.stored[name].updateValue((item,), value)

    def _is_done(self, item: str) -> bool:
        if item not in self.done and item not in self.undone:
            if self.stored["done"].containsKey((item,)):
                self.done[item] = self.before["done"][item] = tuple(self.stored["done"].getValue((item,)))
            else:
                self.undone.add(item)
        return item in self.done

    def _row(self, key, at: int, what: str, item: str, worker: str | None) -> Row:
        return Row(**{self.key: key[0], "at_us": at, "what": what, "item": item, "worker": worker})

    def _expired(self, key, now: int) -> Iterator[Row]:
        """Claims that ran out before ``now`` go back, in the order of their ends."""
        if self.first is None or self.first >= now:
            return
        ended = sorted((v[2], k, v[0], v[1]) for k, v in self.held.items() if v[2] < now)
        for until, item, team, worker in ended:
            del self.held[item]
            self.todo[item] = (team,)
            yield self._row(key, until, "expired", item, worker)
        self.first = min((v[2] for v in self.held.values()), default=None)

    def _served(self, key, at: int, worker: str, n: int) -> Iterator[Row]:
        """Up to ``n`` items: of the team with the fewest left first, then by team and item; items without a team last."""
        if not self.todo:
            return
        left = Counter(v[0] for d in (self.todo, self.held) for v in d.values())
        order = lambda x: (x[0] is None, left[x[0]] if x[0] is not None else 0, x[0] or "", x[1])
        for team, item in heapq.nsmallest(len(self.todo) if n is None else n, ((v[0], k) for k, v in self.todo.items()), key=order):
            del self.todo[item]
            self.held[item] = (team, worker, at + self.lease)
            self.first = at + self.lease if self.first is None else min(self.first, at + self.lease)
            yield self._row(key, at, "served", item, worker)

    def _completed(self, key, at: int, item: str, worker: str | None) -> Iterator[Row]:
        held = self.held.get(item)
        if (held is None and item not in self.todo) or self._is_done(item):
            return
        own = held is not None and (worker is None or held[1] == worker)
        self.held.pop(item, None)
        self.todo.pop(item, None)
        self.done[item] = (worker,)
        yield self._row(key, at, "done" if own else "late", item, worker)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        clock = 1000 * timerValues.getCurrentProcessingTimeInMs()
        self._read("todo", "held")
        for r in sorted(rows, key=lambda r: (0 if self.by_clock else r.at_us, r.seq)):
            at = clock if self.by_clock else r.at_us
            yield from self._expired(key, at)
            if r.op == "add":
                if r.item not in self.todo and r.item not in self.held and not self._is_done(r.item):
                    self.todo[r.item] = (r.team,)
            elif r.op == "claim":
                yield from self._served(key, at, r.worker, r.n)
            elif r.op == "complete":
                yield from self._completed(key, at, r.item, r.worker)
        # claims that ended within the batch need no timer
        was = self.before["held"]
        for until in {v[2] for item, v in self.held.items() if was.get(item) != v}:
            self.handle.registerTimer(to_ms(until))
        self._write()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._read("held")
        yield from self._expired(key, 1000 * expiredTimerInfo.getExpiryTimeInMs())
        self._write()

    def close(self) -> None:
        pass


def leased(log: DataFrame, key: str, *, lease_s: float = LEASE_S, late: str = LATE, by_clock: bool = False) -> DataFrame:
    """(key, at, what, item, worker): what happens in the queues that a log of operations (key, at, seq, op, item, team, worker, n) drives.

    ``add`` puts an item into its queue once; ``claim`` serves up to ``n`` todo items to a worker
    for ``lease_s``; ``complete`` ends an item, ``late`` if the worker's claim had run out.  A claim
    that runs out is ``expired`` by a timer and served again by itself.  A queue is one key's
    state, so large works are split over queues.
    """
    kind = log.schema[key].dataType.simpleString()
    log = log.withWatermark("at", late).where(F.col("at") < F.lit(END).cast("timestamp"))
    rows = log.select(key, "at", F.unix_micros("at").alias("at_us"), "seq", "op", "item", "team", "worker", "n")
    one = Leases(key, int(lease_s * SECOND), by_clock)
    out = rows.groupBy(key).transformWithState(one, f"{key} {kind}, at_us long, what string, item string, worker string", "append", "processingTime" if by_clock else "eventTime")
    return out.select(key, F.timestamp_micros("at_us").alias("at"), "what", "item", "worker")


def played(states: dict[int, list], clock: int, attempts: list[tuple]) -> int:
    """Put attempts (at, event, item, result, depth), in order, on top of ``states``; the clock after them."""
    for _, _, k, res, bf in attempts:
        if k is not None:
            states[k] = review_step(states.get(k) or review_start(), res, bf, clock)
        clock += 1
    return clock


class Replay(StatefulProcessor):
    """Review state of each item in a map, so an attempt reads and writes one item's entry.

    Attempts behind the watermark are settled; later ones are kept in a list, in order, and
    played on top of what is settled, so each batch gives the state of the whole log so far.
    Of a user without settled attempts, whose clock hasn't begun, no item is asked for.
    """

    def init(self, handle) -> None:
        self.items = handle.getMapState("items", "k long", "stab double, diff double, reps long, lapses long, last long")
        self.clock = handle.getValueState("clock", "n long")
        self.open = handle.getListState("open", "at long, event long, k long, res string, bf double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        mark = 1000 * timerValues.getCurrentWatermarkInMs()
        before = [tuple(r) for r in self.open.get()]
        new = [(r.at_us, r.event_id, r.k, r.res, r.bf) for r in rows]
        began = self.clock.get()
        clock = start = began[0] if began else 0
        settled = {}
        for k in {a[2] for a in before + new} - {None} if start else ():
            held = self.items.getValue((k,))
            if held is not None:
                settled[k] = list(held)
        was = dict(settled)
        played(was, clock, before)
        attempts = sorted(before + new, key=lambda a: a[:2])
        n = sum(a[0] < mark for a in attempts)
        now = dict(settled)
        clock = played(now, clock, attempts[:n])
        for k in {a[2] for a in attempts[:n]} - {None}:
            self.items.updateValue((k,), tuple(now[k]))
        if clock != start:
            self.clock.update((clock,))
        if attempts[n:] != before:
            self.open.put(attempts[n:]) if attempts[n:] else self.open.clear()
        played(now, clock, attempts[n:])
        for k in sorted(now):
            if now[k] != was.get(k):
                stab, diff, reps, lapses, last = now[k]
                yield Row(uid=key[0], k=k, stab=stab, diff=diff, reps=reps, lapses=lapses, last=last)

    def close(self) -> None:
        pass


def replayed(log: DataFrame, late: str = LATE) -> DataFrame:
    """Review state of every (uid, k) that a batch of attempts (uid, at, event_id, k, res, bf) changed; attempts may be up to ``late`` behind the newest."""
    log = log.withWatermark("at", late).select("uid", "at", F.unix_micros("at").alias("at_us"), "event_id", F.col("k").cast("long").alias("k"), "res", F.col("bf").cast("double").alias("bf"))
    return log.groupBy("uid").transformWithState(Replay(), "uid long, k long, stab double, diff double, reps long, lapses long, last long", "update", "eventTime")
