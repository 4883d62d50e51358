"""State machines in batch form. Orders are jobs, line items their chunks, events a log."""

from __future__ import annotations

from pyspark.sql import functions as F

from minutespark.operators import state as st
from minutespark.plans.registry import Tables, query

NOW = "2024-01-30 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


@query("""
SELECT o_orderkey AS id FROM orders WHERE o_orderstatus IN ('P', 'O') AND (o_orderkey % 7 <> 0) ORDER BY 6 - CAST(left(o_orderpriority, 1) AS INTEGER) DESC, o_orderdate, o_orderkey LIMIT 1""")
def stm1_claim(t: Tables):
    """Orders with keys divisible by 7 are under a running lease."""
    status = F.when(F.col("o_orderstatus") == "P", "queued").when(F.col("o_orderstatus") == "O", "in_progress").otherwise("completed")
    claimed = F.when(F.col("o_orderkey") % 7 == 0, now() - F.expr("interval 1 minute")).otherwise(now() - F.expr("interval 1 hour"))
    jobs = t.orders.select(F.col("o_orderkey").alias("id"), status.alias("status"), (6 - F.left("o_orderpriority", F.lit(1)).cast("int")).alias("priority"), F.col("o_orderdate").alias("created_at"), now().alias("next_retry_at"), claimed.alias("claimed_at"))
    return st.claim(jobs, now()).select("id")


def results(t: Tables):
    """Events of each user as results of a job of 300 chunks; errors fail."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return t.events.select(F.col("user_id").alias("job"), F.lit(300).cast("long").alias("total"), (F.col("user_id") % 20).alias("priority"), (F.col("value") < 15).alias("ok"), at.alias("at"), F.col("event_id").alias("id"))


@query()
def stm2_result_transitions(t: Tables):
    return st.run_jobs(results(t))


@query("""
SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus IN ('P', 'O')) AND (SELECT count(*) FROM orders WHERE o_orderstatus = 'X') < 15""")
def stm3_create_jobs(t: Tables):
    """Requests without an active job, while the queue has room."""
    active = t.orders.where("o_orderstatus in ('P', 'O')").select(F.col("o_custkey").alias("c_custkey"))
    room = 15 - t.orders.where("o_orderstatus = 'X'").count()
    return t.customer.join(active, "c_custkey", "left_anti").where(F.lit(room > 0)).select("c_custkey")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderdate >= TIMESTAMP '1998-01-01' THEN 'queued' WHEN o_orderstatus = 'P' THEN 'expired' ELSE o_orderstatus END AS status FROM orders")
def stm4_confirm(t: Tables):
    live = F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")
    pending = F.col("o_orderstatus") == "P"
    return t.orders.select("o_orderkey", F.when(pending & live, "queued").when(pending, "expired").otherwise(F.col("o_orderstatus")).alias("status"))


@query("""
WITH s AS (SELECT user_id, count(*) FILTER (breaks = 0) AS streak, max(ts) AS last FROM (SELECT user_id, ts, sum(CASE WHEN value >= 5 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS breaks FROM events) GROUP BY 1)
SELECT user_id, streak, CASE WHEN streak > 0 THEN last + CAST(least(30, power(2, streak - 1)) AS INTEGER) * INTERVAL 1 DAY END AS until FROM s""")
def stm5_cooldown(t: Tables):
    return st.cooldowns(t.events, "user_id", "ts", "event_id", F.col("value") >= 5)


@query("""
SELECT item_id AS search_id, count(*) AS matches, max(doc_id) AS newest FROM (SELECT item_id, array_to_string(string_split(text, ' ')[3:5], ' ') AS term, item_id % 10 AS cursor FROM benchmark) s
JOIN documents ON doc_id > cursor AND contains(lower(text), lower(term)) WHERE trim(term) <> '' GROUP BY 1""")
def stm6_alerts(t: Tables):
    """Matches of saved searches since their cursors; every benchmark item saves a phrase of its three words from the third on."""
    phrase = F.array_join(F.slice(F.split("text", " "), 3, 3), " ")
    searches = t.benchmark.select(F.col("item_id").alias("search_id"), phrase.alias("term"), (F.col("item_id") % 10).alias("cursor"))
    return st.new_matches(searches, t.documents, "doc_id", "doc_id").groupBy("search_id").agg(F.count("*").alias("matches"), F.max("doc_id").alias("newest"))


@query("SELECT user_id, CASE WHEN min(ts) FILTER (event_type = 'signup') IS NOT NULL THEN min(ts) FILTER (event_type = 'signup') ELSE TIMESTAMP '2024-01-30' END AS cursor FROM events GROUP BY 1")
def stm7_saved_cursor(t: Tables):
    """A search that exists keeps its cursor, a new one starts now."""
    first = F.min(F.when(F.col("event_type") == "signup", F.col("ts")))
    return t.events.groupBy("user_id").agg(F.coalesce(first, now()).alias("cursor"))


@query("""
SELECT event_id FROM events WHERE event_type <> 'error' AND NOT event_type = 'view' AND user_id % 7 < 5 AND ts <= TIMESTAMP '2024-01-30' - INTERVAL 5 MINUTE AND value > 40 ORDER BY ts, event_id LIMIT 50""")
def stm8_outbox(t: Tables):
    return st.outbox(t.events, F.col("event_type") != "error", F.col("event_type") == "view", F.col("user_id") % 7, "ts", "event_id", F.col("value") > 40, now(), 50).select("event_id")


@query("SELECT user_id, count(*) AS hits, max(ts) AS last_seen, max(ts) >= TIMESTAMP '2024-01-29 23:00:00' AS fresh FROM events GROUP BY 1")
def stm9_cache(t: Tables):
    last = F.max("ts")
    return t.events.groupBy("user_id").agg(F.count("*").alias("hits"), last.alias("last_seen"), (last >= now() - F.expr("interval 1 hour")).alias("fresh"))


@query("SELECT source, min(doc_id) AS doc_id FROM documents WHERE source IN (SELECT source FROM documents GROUP BY 1 HAVING max(n_chars) > 5000) GROUP BY 1 ORDER BY 2 LIMIT 8")
def stm10_plan_batch(t: Tables):
    ready = t.documents.groupBy("source").agg(F.max("n_chars").alias("m")).where("m > 5000").select("source")
    return st.plan_batch(t.documents, "source", "doc_id", ready, 8)


@query()
def stm11_throttle(t: Tables):
    """One event of each user in three hours."""
    rows = t.events.select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"))
    return st.throttle(rows, "user_id", "s", "event_id", 3 * 3600.0)


@query("SELECT user_id, date_trunc('hour', ts) AS hour, count(*) AS n, count(*) > 2 AS limited FROM events GROUP BY 1, 2")
def stm12_rate_limit(t: Tables):
    return t.events.groupBy("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"), (F.count("*") > 2).alias("limited"))


@query("""
SELECT event_type, count(*) AS n FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR GROUP BY 1""")
def stm13_last_day(t: Tables):
    newest = t.events.agg(F.max("ts")).first()[0]
    return t.events.where(F.col("ts") > F.lit(newest) - F.expr("interval 24 hours")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("""
SELECT doc_id, source, lang, coalesce(quality, 0) AS quality FROM (SELECT doc_id, source, coalesce(nullif(lang, ''), 'und') AS lang FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1) LEFT JOIN labels USING (doc_id)""")
def stm14_ingest(t: Tables):
    """Find, merge, dedupe by content, promote: the batch form of one ingest step."""
    first = t.documents.groupBy(F.md5(F.col("text").cast("binary")).alias("h")).agg(F.min_by(F.struct("doc_id", "source", "lang"), "doc_id").alias("d")).select("d.*")
    merged = first.withColumn("lang", F.coalesce(F.nullif("lang", F.lit("")), F.lit("und")))
    return merged.join(t.labels, "doc_id", "left").select("doc_id", "source", "lang", F.coalesce("quality", F.lit(0)).alias("quality"))
