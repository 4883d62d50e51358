"""Queue, retry, alert and outbox machines over snapshots and event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from minutespark.operators.folds import fold_in_order
from minutespark.operators.containment import containing

LEASE_MINUTES = 5
FAILURES, RETRIES, RETRY_PRIORITY = 3, 3, 10


def claimable(status: Column, next_retry: Column, claimed: Column, now: Column) -> Column:
    """Queued, running or due for a retry, and not under a running lease."""
    due = status.isin("queued", "in_progress") | ((status == "retry_scheduled") & (next_retry <= now))
    return due & F.coalesce(claimed < now - F.expr(f"interval {LEASE_MINUTES} minutes"), F.lit(True))


def claim(jobs: DataFrame, now: Column) -> DataFrame:
    """The one job to work on next."""
    ready = jobs.where(claimable(F.col("status"), F.col("next_retry_at"), F.col("claimed_at"), now))
    return ready.orderBy(F.desc("priority"), "created_at", "id").limit(1)


def transition(state: dict, ok: bool, at: float) -> dict:
    """One chunk result applied to a job: total, done, consecutive, retries, priority, status, next."""
    s = dict(state)
    if s["status"] in ("completed", "failed"):
        return s
    if ok:
        s["consecutive"], s["done"] = 0, s["done"] + 1
        s["status"] = "completed" if s["done"] >= s["total"] else "in_progress"
        return s
    s["consecutive"] += 1
    if s["consecutive"] >= FAILURES:
        if s["priority"] >= RETRY_PRIORITY and s["retries"] < RETRIES:
            s["retries"] += 1
            s["status"], s["next"], s["consecutive"] = "retry_scheduled", at + min(3600.0 * 2 ** (s["retries"] - 1), 21600.0), 0
        else:
            s["status"] = "failed"
    return s


STATE = "job long, total long, done long, consecutive long, retries long, priority long, status string, next double"


_KINDS = {"long": T.LongType(), "string": T.StringType(), "double": T.DoubleType()}


class _Job:
    """One job's state; the last one is the result."""

    def __init__(self):
        self.state: dict | None = None

    def step(self, row: dict) -> list[tuple]:
        if self.state is None:
            self.job = row["job"]
            self.state = {"total": row["total"], "done": 0, "consecutive": 0, "retries": 0, "priority": row["priority"], "status": "queued", "next": None}
        self.state = transition(self.state, bool(row["ok"]), float(row["at"]))
        return []

    def finish(self) -> list[tuple]:
        return [(self.job, *self.state.values())]


def run_jobs(results: DataFrame) -> DataFrame:
    """Final state of each job from its results (job, total, priority, ok, at, id) in order; a fold that holds one state, however
    long a job's history is."""
    schema = T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (c.split() for c in STATE.split(", "))])
    return fold_in_order(results.select("job", "total", "priority", "ok", "at", "id"), "job", ["at", "id"], _Job, schema)


def cooldowns(log: DataFrame, key: str, time: str, order: str, failed: Column, days: int = 1, most: int = 30) -> DataFrame:
    """(key, streak, until): the failure streak from the newest entry and the end of its cooldown."""
    w = Window.partitionBy(key).orderBy(F.desc(time), F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    rows = log.withColumn("_breaks", F.sum((~failed).cast("int")).over(w))
    out = rows.groupBy(key).agg(F.count_if(F.col("_breaks") == 0).alias("streak"), F.max(time).alias("_last"))
    length = F.least(F.lit(most), F.lit(days) * F.pow(F.lit(2), F.col("streak") - 1)).cast("int")
    until = F.when(F.col("streak") > 0, F.timestamp_add("DAY", length, F.col("_last").cast("timestamp")).cast("timestamp_ntz"))
    return out.select(key, "streak", until.alias("until"))


def new_matches(searches: DataFrame, docs: DataFrame, id_col: str, created: str) -> DataFrame:
    """Pairs of saved searches (search_id, term, cursor) and documents that came after the cursor and contain the term: the searches'
    columns with the document's id and time. One automaton of all terms runs over each text once (``containment``)."""
    kept = list(dict.fromkeys([id_col, created]))
    hits = containing(docs, "text", searches.select(F.col("search_id").alias("term_id"), "term"), *kept)
    return searches.join(hits.withColumnRenamed("term_id", "search_id"), "search_id").where(F.col(created) > F.col("cursor"))


def advance(searches: DataFrame, sent: DataFrame) -> DataFrame:
    """Cursors move to the newest match that was sent; others stay."""
    newest = sent.groupBy("search_id").agg(F.max("created").alias("_new"))
    return searches.join(newest, "search_id", "left").select("search_id", "term", F.greatest("cursor", "_new").alias("cursor"))


def outbox(log: DataFrame, ok: Column, pushed: Column, tries: Column, time: str, order: str, worth: Column, now: Column, limit: int, most: int = 5, minutes: int = 5) -> DataFrame:
    """The oldest entries still to be pushed; the content test comes before the limit."""
    pending = ok & ~pushed & (tries < most) & (F.col(time) <= now - F.expr(f"interval {minutes} minutes"))
    return log.where(pending & worth).orderBy(time, order).limit(limit)


def plan_batch(items: DataFrame, lane: str, order: str, ready: DataFrame, size: int) -> DataFrame:
    """One item per ready lane, the earliest first."""
    first = items.join(ready, lane, "left_semi").groupBy(lane).agg(F.min(order).alias(order))
    return first.orderBy(order).limit(size)


def resumed(jobs: DataFrame, checkpoints: DataFrame, key: str, seconds: float = 1.0) -> DataFrame:
    """``jobs`` (key, chunk_size, chunks, duration) with done: the checkpoint's progress if it was taken of the same work (equal chunk
    size and count, duration within ``seconds``), else 0."""
    c = checkpoints.select(F.col(key).alias("_key"), *(F.col(x).alias(f"_{x}") for x in ("chunk_size", "chunks", "duration", "done")))
    fits = (F.col("chunk_size") == F.col("_chunk_size")) & (F.col("chunks") == F.col("_chunks")) & (F.abs(F.col("duration") - F.col("_duration")) <= seconds)
    both = jobs.join(c, F.col(key) == F.col("_key"), "left")
    return both.select(*jobs.columns, F.coalesce(F.when(fits, F.col("_done")), F.lit(0).cast("long")).alias("done"))


class _Throttle:
    def __init__(self, seconds: float):
        self.seconds, self.last = seconds, None

    def step(self, row: dict) -> list[tuple]:
        if row["t"] is None or (self.last is not None and row["t"] - self.last < self.seconds):
            return []
        self.last = row["t"]
        return [(row["key"], row["o"])]

    def finish(self) -> list[tuple]:
        return []


def throttle(rows: DataFrame, key: str, time: str, order: str, seconds: float) -> DataFrame:
    """(key, order) of the rows that pass when one is let through only ``seconds`` after the last that was (a greedy fold that holds
    one time). Rows without a time do not pass."""
    slim = rows.select(F.col(key).alias("key"), F.col(time).cast("double").alias("t"), F.col(order).alias("o"))
    schema = T.StructType([T.StructField(key, rows.schema[key].dataType), T.StructField(order, rows.schema[order].dataType)])
    return fold_in_order(slim, "key", ["t", "o"], lambda: _Throttle(seconds), schema)
