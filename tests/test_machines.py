import json
import os
import random
import tempfile

import pytest

from minutespark.plans.catalog import QUERIES
from minutespark.streaming import machines as m

FOLDER = "/root/testdata/sf0.001"

HOUR = 3600.0
MACHINES = {
    "lease": (m.Lease(), ["claim", "claim", "done"], 400.0),
    "request": (m.Request(), ["request", "request", "confirm"], 40 * HOUR),
    "cooldown": (m.Cooldown(), ["failed", "failed", "ok"], 30 * HOUR),
    "throttle": (m.Throttle(), ["x"], 120.0),
}


@pytest.fixture(scope="module")
def results(spark):
    """Each machine's results, by stream over several files with late events, and by batch."""
    out = {}
    for name, (machine, kinds, step) in MACHINES.items():
        rng = random.Random(name)
        rows, at = [], 1_000_000.0
        for o in range(150):
            at += rng.random() * step
            rows.append((rng.choice("abc"), at - rng.choice([0, 0, rng.random() * 5 * step]), o, rng.choice(kinds)))  # up to five steps late
        rows.append(("a", rows[-1][1], 1000, kinds[0]))  # a tie
        rows.append((None, rows[-1][1], 1001, kinds[0]))
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        end = [("end", at + 1e9, 9999, "none")]  # moves the watermark past everything
        for part in (rows[:50], rows[50:100], rows[100:], end):
            spark.createDataFrame(part, m.EVENTS).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(m.EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)
        got = m.run_machine(stream, machine, f"{int(6 * step)} seconds", f"machine-{name}").collect()
        batch = m.in_batch(spark.createDataFrame(rows, m.EVENTS), machine).collect()
        out[name] = [sorted((tuple(r) for r in x if r["key"] != "end"), key=str) for x in (got, batch)], rows
    return out


@pytest.mark.parametrize("name", MACHINES)
def test_stream_equals_batch(results, name):
    (got, batch), _ = results[name]
    assert got == batch and got


def test_leases_by_hand(spark):
    rows = [("j", 0.0, 1, "claim"), ("j", 100.0, 2, "claim"), ("j", 150.0, 3, "done"), ("j", 150.0, 4, "claim"), ("j", 450.0, 5, "claim"), (None, 0.0, 6, "done"), ("k", None, 7, "claim")]
    got = [tuple(r)[1:] for r in m.in_batch(spark.createDataFrame(rows, m.EVENTS), m.Lease()).orderBy("at", "o").collect()]
    assert got == [(0.0, 1, "granted", 300.0), (100.0, 2, "refused", 300.0), (150.0, 3, "done", None), (150.0, 4, "granted", 450.0), (450.0, 4, "expired", None), (450.0, 5, "granted", 750.0), (750.0, 5, "expired", None)]


def test_requests_and_cooldowns_by_hand(spark):
    rows = [("u", 0.0, 1, "request"), ("u", HOUR, 2, "request"), ("u", 47 * HOUR, 3, "confirm"), ("u", 50 * HOUR, 4, "request"), ("u", 98.5 * HOUR, 5, "confirm")]
    got = [tuple(r)[1:4] for r in m.in_batch(spark.createDataFrame(rows, m.EVENTS), m.Request()).orderBy("at", "o").collect()]
    assert got == [(0.0, 1, "pending"), (47 * HOUR, 1, "confirmed"), (50 * HOUR, 4, "pending"), (98 * HOUR, 4, "lapsed")]
    rows = [("u", 0.0, 1, "failed"), ("u", HOUR, 2, "failed"), ("u", 50 * HOUR, 3, "failed"), ("u", 51 * HOUR, 4, "ok")]
    got = [tuple(r)[1:] for r in m.in_batch(spark.createDataFrame(rows, m.EVENTS), m.Cooldown()).orderBy("at", "o").collect()]
    assert got == [(0.0, 1, "streak 1", 24 * HOUR), (HOUR, 2, "streak 2", 49 * HOUR), (49 * HOUR, 2, "over", None), (50 * HOUR, 3, "streak 3", 146 * HOUR), (51 * HOUR, 4, "streak 0", None)]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_stream_queries_equal_their_batch_twins(spark):
    events = spark.read.parquet(f"{FOLDER}/events.parquet").selectExpr("cast(user_id as string) key", "unix_micros(cast(ts as timestamp)) / 1e6 at", "event_id o", "event_type")
    for name, machine, kind in (
        ("stm1_stream_leases", m.Lease(), "if(event_type = 'error', 'done', 'claim')"),
        ("stm3_stream_requests", m.Request(), "if(event_type = 'purchase', 'confirm', 'request')"),
        ("stm11_stream_throttle", m.Throttle(6 * HOUR), "event_type"),
    ):
        twin = m.in_batch(events.selectExpr("key", "at", "o", f"{kind} kind"), machine).selectExpr("cast(key as long) user_id", "o", "o event_id", "what", "at", "until")
        got = QUERIES[name](spark, FOLDER)
        assert sorted(map(str, got.collect())) == sorted(map(str, twin.select(*got.columns).collect()))


class Store:
    """A handle that counts calls."""

    def __init__(self):
        self.calls, self.value, self.parts, self.timers = [], None, [], set()

    def getListState(self, *_):
        return type("L", (), {"appendList": lambda _, x: self._list(x), "appendValue": lambda _, x: self._list([x]), "get": lambda _: iter(self.parts), "exists": lambda _: bool(self.parts), "put": lambda _, x: self._list(x, []), "clear": lambda _: self._list([], [])})()

    def getValueState(self, *_):
        return type("V", (), {"get": lambda _: self.value, "exists": lambda _: self.value is not None, "update": lambda _, x: self._set(x), "clear": lambda _: self._set(None)})()

    def _list(self, new, before=None):
        self.calls.append("list")
        self.parts = (self.parts if before is None else before) + list(new)

    def _set(self, x):
        self.calls.append("value")
        self.value = x

    def registerTimer(self, at):
        self.calls.append("timer")
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


def test_a_key_has_one_timer():
    """Calls to the store do not grow with the events of a key, and the timers fired give what the batch form does."""
    store, now = Store(), type("Now", (), {"getCurrentWatermarkInMs": lambda s: s.at})()
    p = m._Processor(m.Lease(10.0))
    p.init(store)
    rows = [{"at": 100.0 + 3 * i, "o": i, "kind": "claim"} for i in range(200)]
    for part in (rows[150:], rows[:150]):
        list(p.handleInputRows(("k",), iter(part), None))
        assert len(store.timers) == 1
    assert store.timers == {100_000} and len(store.calls) <= 8
    got = []
    for now.at in (100_000, 250_500, 10_000_000):
        due = [t for t in store.timers if t <= now.at]
        got += [x for _ in due for x in p.handleExpiredTimer(("k",), now, None)]
        store.timers -= set(due)
        assert len(store.timers) <= 1
    fold = m._Fold(m.Lease(10.0))
    expected = [y for r in rows for y in fold.step({"key": "k", **r})] + fold.finish()
    assert [tuple(r) for r in got] == expected and store.timers == set() and not store.parts
    assert store.value == (json.dumps(fold.state), None)
