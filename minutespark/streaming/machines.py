"""Keyed machines with timers, on streams and in batch form: leases that expire, requests that lapse, cooldowns that end, throttles.

A machine is a small fold over the events of a key in order of time: ``step`` takes an event, ``due`` names the time at which its state ends by
itself, ``lapse`` is what happens then. On a stream (``transformWithState``, RocksDB state) events wait in the key's list state until the watermark
has passed them, so that late ones within the watermark come in order; a timer is set for the first of them, or for the time that the state is due. The batch
form folds the same events in one pass and, like a stream that has ended, lets everything lapse at last.

Each call into the state store is a message to the executor, so a key has one timer at a time, the next at which anything happens to it, and not
one for each event: the calls of a batch grow with the keys that it touches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from minutespark.operators.folds import fold_in_order
from minutespark.streaming.streams import run

#: Columns of events: the key, seconds, an order among equal times, and what happened.
EVENTS = "key string, at double, o long, kind string"
PROVIDER, ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Machine:
    """State is a dict of JSON values, at first empty. Results are (at, o, what, until)."""

    def step(self, state: dict, at: float, o: int, kind: str) -> list[tuple]:
        raise NotImplementedError

    def due(self, state: dict) -> float | None:
        return None

    def lapse(self, state: dict, at: float) -> list[tuple]:
        return []


RESULT = "key string, at double, o long, what string, until double"


class Lease(Machine):
    """``claim`` is granted if no lease runs, and runs for ``seconds``; ``done`` ends it before. A lease that runs out is reported."""

    def __init__(self, seconds: float = 300.0):
        self.seconds = seconds

    def step(self, state, at, o, kind):
        if kind == "claim" and "until" not in state:
            state |= {"until": at + self.seconds, "o": o}
            return [(at, o, "granted", at + self.seconds)]
        if kind == "done" and "until" in state:
            del state["until"]
            return [(at, o, "done", None)]
        return [(at, o, "refused", state.get("until"))] if kind == "claim" else []

    def due(self, state):
        return state.get("until")

    def lapse(self, state, at):
        del state["until"]
        return [(at, state["o"], "expired", None)]


class Request(Machine):
    """A ``request`` is pending until it is confirmed, or lapses after ``seconds``; while one is pending others add nothing."""

    def __init__(self, seconds: float = 48 * 3600.0):
        self.seconds = seconds

    def step(self, state, at, o, kind):
        if kind == "request" and "until" not in state:
            state |= {"until": at + self.seconds, "o": o}
            return [(at, o, "pending", at + self.seconds)]
        if kind == "confirm" and "until" in state:
            del state["until"]
            return [(at, state["o"], "confirmed", None)]
        return []

    def due(self, state):
        return state.get("until")

    def lapse(self, state, at):
        del state["until"]
        return [(at, state["o"], "lapsed", None)]


class Cooldown(Machine):
    """Failures in a row: each makes the pause twice as long, up to ``most`` days; anything else ends the streak, and the end of a pause is reported."""

    def __init__(self, days: int = 1, most: int = 30):
        self.days, self.most = days, most

    def step(self, state, at, o, kind):
        if kind != "failed":
            state.clear()
            return [(at, o, "streak 0", None)]
        streak = state.get("streak", 0) + 1
        until = at + 86400.0 * min(self.most, self.days * 2 ** min(streak - 1, 30))
        state |= {"streak": streak, "until": until, "o": o}
        return [(at, o, f"streak {streak}", until)]

    def due(self, state):
        return state.get("until")

    def lapse(self, state, at):
        """The streak goes on if the next one fails, too."""
        del state["until"]
        return [(at, state["o"], "over", None)]


class Throttle(Machine):
    """One event passes only ``seconds`` after the last that did."""

    def __init__(self, seconds: float = 180.0):
        self.seconds = seconds

    def step(self, state, at, o, kind):
        if "last" in state and at - state["last"] < self.seconds:
            return []
        state["last"] = at
        return [(at, o, "passed", None)]


def _lapsed(machine: Machine, state: dict, until: float | None) -> Iterator[tuple]:
    """What is due before ``until`` (all if null)."""
    while (due := machine.due(state)) is not None and (until is None or due <= until):
        yield from machine.lapse(state, due)


class _Fold:
    """The batch form, for ``fold_in_order``."""

    def __init__(self, machine: Machine):
        self.machine, self.state, self.key = machine, {}, None

    def step(self, row: dict) -> list[tuple]:
        if row["at"] is None:
            return []
        self.key = row["key"]
        out = [*_lapsed(self.machine, self.state, row["at"]), *self.machine.step(self.state, row["at"], row["o"], row["kind"])]
        return [(self.key, *x) for x in out]

    def finish(self) -> list[tuple]:
        return [(self.key, *x) for x in _lapsed(self.machine, self.state, None)]


def in_batch(events: DataFrame, machine: Machine) -> DataFrame:
    """Results of ``events`` (key, at, o, kind) as they are; events without a time are left out."""
    schema = T.StructType.fromDDL(RESULT)
    return fold_in_order(events.select("key", "at", "o", "kind"), "key", ["at", "o"], lambda: _Fold(machine), schema)


def _milliseconds(at: float) -> int:
    """The first millisecond that is not before."""
    return -int(-at * 1000 // 1)


class _Processor(StatefulProcessor):
    def __init__(self, machine: Machine):
        self.machine = machine

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Events as JSON, an element for all those of a batch: elements are turned over one by one.
        self.waiting = handle.getListState("waiting", "events string")
        # The machine's state, and the key's timer.
        self.state = handle.getValueState("state", "value string, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [(r["at"], r["o"], r["kind"]) for r in rows if r["at"] is not None]
        if new:
            value, timer = self.state.get() or ("{}", None)
            self.waiting.appendValue((json.dumps(new),))
            first = _milliseconds(min(new)[0])
            if timer is None or first < timer:
                self._wake(value, timer, first)
        return iter(())

    def _wake(self, value: str, timer: int | None, at: int) -> None:
        """Set the key's timer in the place of another that has not expired."""
        if timer is not None:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at)
        self.state.update((value, at))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() / 1000
        value, _ = self.state.get() or ("{}", None)
        state = json.loads(value)
        events = sorted(tuple(x) for part in self.waiting.get() for x in json.loads(part[0]))
        out = []
        for at, o, kind in (x for x in events if x[0] <= now):
            out += [*_lapsed(self.machine, state, at), *self.machine.step(state, at, o, kind)]
        out += _lapsed(self.machine, state, now)
        left = [x for x in events if x[0] > now]
        if left:
            self.waiting.put([(json.dumps(left),)])
        elif events:
            self.waiting.clear()
        ahead = [left[0][0]] if left else []
        if (due := self.machine.due(state)) is not None:
            ahead.append(due)
        if ahead:
            self._wake(json.dumps(state), None, _milliseconds(min(ahead)))
        elif state:
            self.state.update((json.dumps(state), None))
        else:
            self.state.clear()
        return iter([Row(key=key[0], at=a, o=o, what=w, until=u) for a, o, w, u in out])

    def close(self) -> None:
        pass


def on_stream(events: DataFrame, machine: Machine, late: str) -> DataFrame:
    """The machine over a stream of ``events`` (key, at, o, kind) that come up to ``late`` out of order."""
    timed = events.withColumn("time", F.timestamp_micros((F.col("at") * 1e6).cast("long"))).withWatermark("time", late)
    return timed.groupBy("key").transformWithState(_Processor(machine), RESULT, "append", "eventTime")


def run_machine(events: DataFrame, machine: Machine, late: str, name: str) -> DataFrame:
    """Run over what is available and return the results; the session has its own state store again afterwards."""
    spark = events.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return run(on_stream(events, machine, late), name)
    finally:
        spark.conf.set(PROVIDER, before)
