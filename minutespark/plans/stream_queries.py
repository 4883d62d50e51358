"""Streams over events, run to the end of what is there; compared with their batch forms by oracle or test."""

from __future__ import annotations

from pyspark.sql import functions as F

from minutespark.plans.registry import Tables, query
from minutespark.streaming import machines, refresh
from minutespark.streaming import streams as st
from minutespark.streaming.streams import work_folder


def events(t: Tables):
    return st.read_events(t.spark, f"{t._folder}/event[s].parquet")


LATE = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query(f"""
SELECT start, event_type, count(*) AS n FROM (SELECT date_trunc('hour', ts) AS start, event_type FROM events) WHERE start + INTERVAL 1 HOUR <= {LATE} GROUP BY 1, 2""")
def stm12_stream_tumbling(t: Tables):
    rows = st.run(st.tumbling(events(t), "ts", ["event_type"], "1 hour", "1 hour"), "tumbling")
    return rows.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(f"""
SELECT start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE * k AS start FROM events, generate_series(0, 1) g(k)) WHERE start + INTERVAL 1 HOUR <= {LATE} GROUP BY 1""")
def stm13_stream_sliding(t: Tables):
    rows = st.run(st.sliding(events(t), "ts", [], "1 hour", "30 minutes", "1 hour"), "sliding")
    return rows.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(f"""
SELECT min(ts) AS start, user_id, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s
FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events)) GROUP BY user_id, s HAVING max(ts) + INTERVAL 6 HOUR <= {LATE}""")
def win12_stream_sessions(t: Tables):
    rows = st.run(st.sessions(events(t), "ts", ["user_id"], "6 hours", "1 hour"), "sessions")
    return rows.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT event_id, user_id FROM events")
def stm15_stream_dedupe(t: Tables):
    """Every event twice, deduplicated within the watermark."""
    twice = events(t).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    return st.run(st.deduplicated(twice, "ts", ["event_id"], "1 hour").select("event_id", "user_id"), "dedupe")


@query()
def stm2_stream_jobs(t: Tables):
    """The retry machine with keyed state; its batch twin is stm2_result_transitions."""
    e = events(t)
    at = F.unix_micros("ts") / 1e6
    results = e.select(F.col("user_id").alias("job"), F.lit(300).cast("long").alias("total"), (F.col("user_id") % 20).alias("priority"), (F.col("value") < 15).alias("ok"), at.alias("at"), F.col("event_id").alias("id"))
    return st.latest(st.run(st.job_states(results), "jobs", each=lambda df, n: df), "job")


def through(t: Tables, machine: machines.Machine, kind, name: str):
    """Results of a machine over each user's events as a stream, ended by an event far ahead (of a key of its own) that lets the watermark pass them all."""
    rows = t.events.select(F.col("user_id").cast("string").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.col("event_id").alias("o"), kind.alias("kind"))
    end = rows.agg(F.lit("end").alias("key"), (F.max("at") + 1e9).alias("at"), F.lit(0).cast("long").alias("o"), F.lit("end").alias("kind")).where("at is not null")
    source = work_folder(t.spark, f"{name}-events")
    rows.unionByName(end).write.parquet(source)
    stream = t.spark.readStream.schema(rows.schema).parquet(source)
    found = machines.run_machine(stream, machine, "1 hour", name).where("key <> 'end'")
    return found.withColumn("user_id", F.col("key").cast("long")).drop("key")


@query()
def stm1_stream_leases(t: Tables):
    """Views claim a user's job for five minutes, errors end the lease; its batch twin is machines.in_batch."""
    kind = F.when(F.col("event_type") == "error", "done").otherwise("claim")
    return through(t, machines.Lease(), kind, "leases").select("user_id", "o", "what", "at", "until")


@query()
def stm3_stream_requests(t: Tables):
    """Requests that lapse after two days unless a purchase confirms them."""
    kind = F.when(F.col("event_type") == "purchase", "confirm").otherwise("request")
    return through(t, machines.Request(), kind, "requests").select("user_id", "o", "what", "at", "until")


@query("""
WITH s AS (SELECT user_id, count(*) FILTER (breaks = 0) AS streak, max(ts) AS last FROM (SELECT user_id, ts, sum(CASE WHEN value >= 5 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS breaks FROM events) GROUP BY 1)
SELECT user_id, streak, CASE WHEN streak > 0 THEN last + CAST(least(30, power(2, streak - 1)) AS INTEGER) * INTERVAL 1 DAY END AS until FROM s""")
def stm5_stream_cooldown(t: Tables):
    """Each user's streak and pause as the stream leaves them."""
    found = through(t, machines.Cooldown(), F.when(F.col("value") >= 5, "failed").otherwise("ok"), "cooldowns").where("what <> 'over'")
    last = found.groupBy("user_id").agg(F.max_by(F.struct("what", "until"), F.struct("at", "o")).alias("l"))
    until = F.timestamp_micros(F.round(F.col("l.until") * 1e6).cast("long")).cast("timestamp_ntz")
    return last.select("user_id", F.regexp_extract("l.what", r"\d+", 0).cast("long").alias("streak"), until.alias("until"))


@query()
def stm11_stream_throttle(t: Tables):
    """An event of a user passes only six hours after the last that did; its batch twin is stm11_throttle's fold."""
    return through(t, machines.Throttle(6 * 3600.0), F.col("event_type"), "throttle").select("user_id", F.col("o").alias("event_id"))


@query("""
WITH d AS (SELECT CASE WHEN doc_id % 3 = 0 THEN lang || ' ' || source ELSE text END AS text FROM documents WHERE doc_id % 3 = 0 OR doc_id % 7 <> 0)
SELECT word, count(*) AS n FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9'']+'))) AS word FROM d) WHERE length(word) <= 255 GROUP BY 1""")
def txt17_incremental_refresh(t: Tables):
    """The vocabulary after a stream of all texts, deletions of every seventh and later rewrites of every third (so that some deletions come too late)."""
    source, state = work_folder(t.spark, "changes"), work_folder(t.spark, "refreshed")
    rows = t.documents.select(F.col("doc_id").alias("id"), "text", F.timestamp_seconds(F.lit(0)).alias("at"), F.lit(False).alias("deleted"), "lang", "source")
    rewritten = rows.where("id % 3 = 0").withColumn("text", F.concat("lang", F.lit(" "), "source")).withColumn("at", F.timestamp_seconds(F.lit(7200)))
    deleted = rows.where("id % 7 = 0").withColumn("deleted", F.lit(True)).withColumn("at", F.timestamp_seconds(F.lit(3600)))
    for part in (rows, rewritten, deleted):
        part.drop("lang", "source").write.mode("append").parquet(source)
    stream = t.spark.readStream.schema(rows.drop("lang", "source").schema).option("maxFilesPerTrigger", 2).parquet(source)
    refresh.follow(stream, state, f"{state}/checkpoint")
    return refresh.vocabulary(t.spark, state)
