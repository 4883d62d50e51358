"""Failure analytics: events of type error are failures, a user is a job, props.k its chunk."""

from __future__ import annotations

from pyspark.sql import functions as F

from minutespark.operators import failures as fail
from minutespark.plans.registry import Tables, query

E = "(SELECT event_id, ts, user_id, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, 'h' || (user_id % 7) || '.d' || (user_id % 3) || '.org' AS host FROM events WHERE event_type = 'error')"
# Jobs with an in-window failure: orders returned in part, their chunks being line numbers.
J = "(SELECT l_orderkey AS job, l_linenumber - 1 AS idx FROM lineitem WHERE l_returnflag = 'R')"
T = "(SELECT l_orderkey AS job, max(l_linenumber) AS total FROM lineitem GROUP BY 1)"


def errors(t: Tables):
    u = F.col("user_id")
    host = F.concat(F.lit("h"), u % 7, F.lit(".d"), u % 3, F.lit(".org"))
    return t.events.where("event_type = 'error'").select("event_id", "ts", "user_id", "value", F.get_json_object("props", "$.k").cast("int").alias("k"), host.alias("host"))


def chunk_failures(t: Tables):
    return t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("job"), (F.col("l_linenumber") - 1).alias("index"))


def failing_jobs(t: Tables):
    totals = t.lineitem.groupBy(F.col("l_orderkey").alias("job")).agg(F.max("l_linenumber").alias("total"))
    return totals.join(chunk_failures(t).select("job").distinct(), "job")


@query(f"""
SELECT host, user_id, k, count(*) AS failures, count(*) FILTER (value > 20) AS timeouts, count(*) FILTER (k = 0) AS first, count(*) FILTER (NOT k = 0) AS later, count(DISTINCT user_id) AS jobs
FROM (SELECT *, user_id AS job FROM {E}) GROUP BY GROUPING SETS ((host), (user_id), (k))""")
def agg20_grouping_sets(t: Tables):
    rows = errors(t).withColumn("job", F.col("user_id"))
    return fail.summary(rows, ["host", "user_id", "k"], "job", F.col("value") > 20, F.col("k") == 0).select("host", "user_id", "k", "failures", "timeouts", "first", "later", "jobs")


@query(f"""
WITH a AS (SELECT job, unnest(generate_series(0, total - 1)) AS index FROM {T} WHERE job IN (SELECT job FROM {J})),
f AS (SELECT idx, count(*) AS failures FROM {J} GROUP BY 1)
SELECT index::INTEGER AS index, count(*) AS attempts, coalesce(any_value(failures), 0) AS failures, round(coalesce(any_value(failures), 0) / count(*), 3) AS rate FROM a LEFT JOIN f ON idx = index GROUP BY 1""")
def agg21_attempt_rate(t: Tables):
    return fail.rate_by(fail.attempts(failing_jobs(t), "job", "total"), chunk_failures(t), "index")


@query(f"""
WITH a AS (SELECT job, total, unnest(generate_series(0, total - 1)) AS index FROM {T} WHERE job IN (SELECT job FROM {J})),
f AS (SELECT least(9, idx * 10 // total)::INTEGER AS decile, count(*) AS failures FROM {J} JOIN {T} USING (job) GROUP BY 1)
SELECT d AS decile, count(*) AS attempts, coalesce(any_value(failures), 0) AS failures, round(coalesce(any_value(failures), 0) / count(*), 3) AS rate
FROM (SELECT least(9, index * 10 // total)::INTEGER AS d FROM a) LEFT JOIN f ON f.decile = d GROUP BY 1""")
def agg22_decile_rate(t: Tables):
    jobs = failing_jobs(t)
    attempted = fail.attempts(jobs, "job", "total").withColumn("decile", fail.decile(F.col("index"), F.col("total")))
    failed = chunk_failures(t).join(jobs, "job").withColumn("decile", fail.decile(F.col("index"), F.col("total")))
    return fail.rate_by(attempted, failed, "decile")


@query(f"SELECT CASE WHEN k = 0 THEN '0' WHEN k BETWEEN 1 AND 2 THEN '1-2' WHEN k >= 3 THEN '3+' ELSE 'unknown' END AS bucket, count(*) AS n FROM {E} GROUP BY 1")
def agg23_position_buckets(t: Tables):
    return errors(t).groupBy(fail.position_bucket(F.col("k")).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"SELECT host, round(count(*) FILTER (k < 10) / count(*), 3) AS share FROM {E} GROUP BY 1")
def agg24_first_share(t: Tables):
    return errors(t).groupBy("host").agg(F.round(F.try_divide(F.count_if(F.col("k") < 10), F.count("*")), 3).alias("share"))


@query(f"""
WITH e AS (SELECT * FROM {E})
SELECT CASE WHEN a.user_id = b.user_id THEN 'same_job' WHEN a.host = b.host THEN 'same_host' WHEN split_part(a.host, '.', 2) = split_part(b.host, '.', 2) THEN 'same_domain' ELSE 'unrelated' END AS shape, count(*) AS pairs
FROM e a JOIN e b ON b.ts BETWEEN a.ts AND a.ts + INTERVAL 10 MINUTE AND (b.ts > a.ts OR b.event_id > a.event_id) GROUP BY 1""")
def jn9_failure_pairs(t: Tables):
    return fail.pair_shapes(errors(t), "ts", "event_id", "user_id", "host")


@query(f"""
SELECT host, max(n) AS burst FROM (SELECT host, count(*) OVER (PARTITION BY host ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n FROM {E}) GROUP BY 1""")
def agg20_host_burst(t: Tables):
    return fail.burst(errors(t), "host", "ts")
