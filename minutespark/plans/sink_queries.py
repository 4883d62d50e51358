"""Sinks. Upserts, inserts, deletes and updates write tables of versions in the cluster's shared folder and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from minutespark.operators import relational as rel
from minutespark.plans.registry import Tables, query
from minutespark.sources import captions, versions
from minutespark.streaming.streams import work_folder

#: Parts of the tables written here.
PARTS = 16


@query("""
SELECT doc_id, coalesce(nullif(n.source, ''), o.source) AS source, coalesce(n.lang, o.lang) AS lang FROM (SELECT doc_id, source, lang FROM documents WHERE doc_id % 2 = 0) o
FULL JOIN (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'new' END AS source, CASE WHEN doc_id % 5 > 0 THEN lang END AS lang FROM documents WHERE doc_id % 4 < 2) n USING (doc_id)""")
def snk1_upsert(t: Tables):
    old = t.documents.where("doc_id % 2 = 0").select("doc_id", "source", "lang")
    new = t.documents.where("doc_id % 4 < 2").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "").otherwise("new").alias("source"), F.when(F.col("doc_id") % 5 > 0, F.col("lang")).alias("lang"))
    path = work_folder(t.spark, "upsert")
    versions.create(old, path, ["doc_id"], PARTS)
    # A row that is only new keeps an empty value as null.
    versions.change(t.spark, path, new, lambda rows, changes: rel.upsert(rows, changes, "doc_id"))
    return versions.read(t.spark, path)


@query("SELECT source, lang FROM (SELECT DISTINCT source, lang FROM documents WHERE lang = 'en') UNION SELECT DISTINCT source, lang FROM documents")
def snk2_insert_absent(t: Tables):
    """Vocabulary-like insert: what is there stays, what is new comes once (snk3)."""
    old = t.documents.where("lang = 'en'").select("source", "lang").distinct()
    path = work_folder(t.spark, "insert")
    versions.create(old, path, ["source", "lang"], PARTS)
    versions.change(t.spark, path, t.documents.select("source", "lang"), lambda rows, changes: rel.insert_absent(rows, changes, ["source", "lang"]))
    return versions.read(t.spark, path)


@query("SELECT user_id, event_type, min(event_id) AS winner FROM events GROUP BY 1, 2")
def snk4_claim_once(t: Tables):
    return t.events.groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("event_id")).alias("winner"))


@query("""
SELECT 'documents' AS tbl, count(*) AS kept FROM documents WHERE source <> 'src3' UNION ALL
SELECT 'labels', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src3')""")
def snk6_cascade_delete(t: Tables):
    """Children first, so that no version of them points to a parent that has gone."""
    gone = t.documents.where("source = 'src3'").select("doc_id")
    kept = []
    for name in ("labels", "documents"):
        path = work_folder(t.spark, f"cascade-{name}")
        versions.create(getattr(t, name).select("doc_id"), path, ["doc_id"], PARTS)
        versions.delete(t.spark, path, gone)
        kept.append(versions.read(t.spark, path).agg(F.lit(name).alias("tbl"), F.count("*").alias("kept")))
    return kept[0].unionByName(kept[1])


@query("SELECT count(*) FILTER (user_id <> 7) AS kept, count(*) FILTER (user_id = 7) AS removed FROM events")
def snk7_account_delete(t: Tables):
    return t.events.agg(F.count_if(F.col("user_id") != 7).alias("kept"), F.count_if(F.col("user_id") == 7).alias("removed"))


@query("SELECT n_nationkey, n_name AS old, 'NATION-' || n_nationkey AS new FROM nation WHERE n_regionkey = 1")
def snk8_bulk_update_diff(t: Tables):
    """A bulk update: the rows that it changes, as a dry run has them and as the versions before and after differ."""
    path = work_folder(t.spark, "update")
    versions.create(t.nation.select("n_nationkey", "n_name", "n_regionkey"), path, ["n_nationkey"], PARTS)
    planned = t.nation.where("n_regionkey = 1").select("n_nationkey", F.concat(F.lit("NATION-"), F.col("n_nationkey")).alias("new"))
    made = versions.change(
        t.spark, path, planned, lambda rows, new: rows.join(new, "n_nationkey", "left").withColumn("n_name", F.coalesce("new", "n_name"))
    )
    before, after = (versions.read(t.spark, path, n).select("n_nationkey", F.col("n_name").alias(name)) for n, name in ((0, "old"), (made, "new")))
    return before.join(after, "n_nationkey").where(~F.col("old").eqNullSafe(F.col("new")))


@query("""
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AS is_default FROM events WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 12""")
def snk9_capped_store(t: Tables):
    """At most 12 per page; the newest is the default."""
    rows = rel.keep_latest(t.events.where("event_type = 'view'"), ["user_id"], F.desc("ts"), F.desc("event_id"), k=12)
    newest = rows.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("d"))
    return rows.join(newest, "user_id").select("user_id", "event_id", (F.col("event_id") == F.col("d")).alias("is_default"))


@query("""
SELECT conv_id, md5(string_agg((turn + 1)::VARCHAR || chr(10) || '00:' || lpad((turn * 10 // 60)::VARCHAR, 2, '0') || ':' || lpad((turn * 10 % 60)::VARCHAR, 2, '0') || ',000 --> 00:' || lpad(((turn * 10 + 8) // 60)::VARCHAR, 2, '0') || ':' || lpad(((turn * 10 + 8) % 60)::VARCHAR, 2, '0') || ',000' || chr(10) || text || chr(10), chr(10) ORDER BY turn)) AS body_md5
FROM conversations GROUP BY 1""")
def snk10_srt_export(t: Tables):
    s = F.col("turn") * 10.0
    item = F.struct("turn", s.alias("start"), (s + 8).alias("end"), "text")
    files = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("segments"))
    return captions.to_srt(files, "segments", "body").select("conv_id", F.md5(F.col("body").cast("binary")).alias("body_md5"))


@query("SELECT source, lang, max(doc_id) AS updated, count(*) AS pages FROM documents WHERE n_chars >= 200 GROUP BY 1, 2 HAVING count(*) >= 2")
def snk13_sitemap(t: Tables):
    """Indexable hubs by their latest update (top14)."""
    return t.documents.where("n_chars >= 200").groupBy("source", "lang").agg(F.max("doc_id").alias("updated"), F.count("*").alias("pages")).where("pages >= 2").orderBy(F.desc("updated"))
