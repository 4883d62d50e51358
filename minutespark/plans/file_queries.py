"""File sources and sinks: files are written from the tables into the cluster's shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from minutespark.operators import state as st
from minutespark.plans.registry import Tables, query
from minutespark.sources import tables
from minutespark.streaming.streams import work_folder


@query("SELECT lower(source) AS name, list_sort(list_distinct(list(lang))) AS states FROM documents WHERE source IS NOT NULL GROUP BY 1")
def src12_gazetteer(t: Tables):
    """A list of names with the languages they occur in, as a gazetteer of names and states."""
    path = work_folder(t.spark, "gazetteer")
    tables.write_csv(t.documents.where("source is not null").select(F.concat(F.upper("source"), F.lit(" ")).alias("name"), F.col("lang").alias("state")), path)
    return tables.gazetteer(t.spark, path)


@query("SELECT p_partkey, p_name || 'é' AS p_name, p_size FROM part")
def src13_delimited(t: Tables):
    """Pipe-delimited Latin-1 lines."""
    path = work_folder(t.spark, "delimited")
    rows = t.part.select(F.col("p_partkey").cast("string"), F.concat("p_name", F.lit("é")).alias("p_name"), F.col("p_size").cast("string"))
    rows.write.csv(path, sep="|", encoding="iso-8859-1", header=True)
    return tables.delimited(t.spark, path).select(F.col("p_partkey").cast("long"), "p_name", F.col("p_size").cast("int"))


@query("""
SELECT unnest(CASE WHEN url IN (SELECT url FROM pages WHERE page_id % 4 = 1 AND page_id % 5 > 0) THEN [url || '/1', url || '/2'] ELSE [url] END) AS url FROM pages WHERE page_id % 5 > 0 AND trim(url) <> ''""")
def src14_url_list(t: Tables):
    """An address list with comments and blank lines; every fourth address is a playlist of two, wherever it is listed."""
    path = work_folder(t.spark, "addresses")
    t.pages.select(F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("# "), "url")).otherwise(F.concat(F.lit("  "), "url", F.lit("\n"))).alias("value")).write.text(path)
    playlists = t.pages.where("page_id % 4 = 1 and page_id % 5 > 0").select("url", F.array(F.concat("url", F.lit("/1")), F.concat("url", F.lit("/2"))).alias("entries")).dropDuplicates(["url"])
    return tables.expand(tables.url_list(t.spark, path), playlists)


@query("SELECT CASE WHEN event_id % 3 > 0 THEN ts::DATE END AS date, event_id::VARCHAR AS id FROM events")
def src15_ledger(t: Tables):
    """'date TAB id' lines, and undated ids."""
    path = work_folder(t.spark, "ledger")
    day, number = F.date_format("ts", "yyyy-MM-dd"), F.col("event_id").cast("string")
    t.events.select(F.when(F.col("event_id") % 3 > 0, F.concat(day, F.lit("\t"), number)).otherwise(number).alias("value")).write.text(path)
    return tables.ledger(t.spark, path)


@query("SELECT event_type, count(*) AS n, max(event_id) AS newest FROM events GROUP BY 1")
def snk5_append(t: Tables):
    """A log that grows by appends."""
    path = work_folder(t.spark, "log")
    for part in range(3):
        tables.append(t.events.where(F.col("event_id") % 3 == part).select("event_id", "event_type"), path)
    return t.spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("newest"))


@query("SELECT c_custkey, c_name || ', \"x\"' AS c_name, c_acctbal FROM customer")
def snk12_csv(t: Tables):
    """Rows with separators and quotes through CSV and back."""
    path = work_folder(t.spark, "csv")
    tables.write_csv(t.customer.select("c_custkey", F.concat("c_name", F.lit(', "x"')).alias("c_name"), "c_acctbal"), path)
    return t.spark.read.csv(path, header=True, escape='"', schema="c_custkey long, c_name string, c_acctbal double")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'done' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 7 > 0")
def snk14_replace(t: Tables):
    """A table rewritten from its own rows."""
    path = work_folder(t.spark, "table")
    t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status")).write.parquet(path)
    own = t.spark.read.parquet(path)
    return tables.replace(own.where("o_orderkey % 7 > 0").withColumn("status", F.when(F.col("status") == "P", "done").otherwise(F.col("status"))), path)


@query("""
SELECT o_orderkey AS job, CASE WHEN o_orderkey % 4 <> 1 AND o_orderkey % 5 <> 2 AND abs(o_orderkey % 3 - 0.5) <= 1 THEN o_orderkey % 6 ELSE 0 END AS done FROM orders WHERE o_orderkey % 8 > 0
UNION ALL SELECT o_orderkey, 0 FROM orders WHERE o_orderkey % 8 = 0""")
def snk15_checkpoint(t: Tables):
    """Checkpoints of jobs as JSON lines; one is taken up only if chunk size, chunk count and length (within a second) are the job's."""
    path = work_folder(t.spark, "checkpoints")
    key = F.col("o_orderkey")
    t.orders.where("o_orderkey % 8 > 0").select(
        key.alias("job"), F.when(key % 4 == 1, 600).otherwise(900).alias("chunk_size"), F.when(key % 5 == 2, 7).otherwise(8).alias("chunks"), (F.lit(7200.0) + key % 3 - 0.5).alias("duration"), (key % 6).alias("done")
    ).write.json(path)
    held = t.spark.read.json(path, schema="job long, chunk_size int, chunks int, duration double, done long")
    jobs = t.orders.select(key.alias("job"), F.lit(900).alias("chunk_size"), F.lit(8).alias("chunks"), F.lit(7200.0).alias("duration"))
    return st.resumed(jobs, held, "job").select("job", "done")
