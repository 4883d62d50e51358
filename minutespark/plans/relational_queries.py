"""Filters, joins, aggregations, windows, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from minutespark.operators import relational as rel
from minutespark.plans.registry import Tables, query


def long(c, name):
    return c.cast("long").alias(name)


@query("SELECT * FROM documents WHERE doc_id = 42")
def src2_point_lookup(t: Tables):
    return t.documents.where("doc_id = 42")


@query("""
SELECT p.page_id, coalesce(a.item_id, b.doc_id) AS found, CASE WHEN a.item_id IS NOT NULL THEN 0 WHEN b.doc_id IS NOT NULL THEN 1 END AS rank
FROM pages p LEFT JOIN benchmark a ON a.item_id * 5 = p.page_id LEFT JOIN (SELECT doc_id FROM documents WHERE lang = 'en') b ON b.doc_id = p.page_id""")
def src3_alias_lookup(t: Tables):
    """Aliases before pages: the first source that knows a key answers."""
    aliases = t.benchmark.select((F.col("item_id") * 5).alias("k"), F.col("item_id").alias("v"))
    own = t.documents.where("lang = 'en'").select(F.col("doc_id").alias("k"), F.col("doc_id").alias("v"))
    return rel.first_match(t.pages.select("page_id"), "page_id", (aliases, "k", "v"), (own, "k", "v"))


@query("SELECT doc_id, source FROM documents WHERE doc_id > 100 ORDER BY doc_id LIMIT 200")
def src5_keyset_batch(t: Tables):
    """One keyset page of 200 rows."""
    return t.documents.where("doc_id > 100").orderBy("doc_id").limit(200).select("doc_id", "source")


@query("SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1")
def src16_since_cutoff(t: Tables):
    return t.events.where(F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_name ILIKE '%nation_1%' OR n_name ILIKE '%_2'")
def flt2_contains_any_case(t: Tables):
    return t.nation.where(F.ilike("n_name", F.lit("%nation_1%")) | F.ilike("n_name", F.lit("%_2"))).select("n_nationkey", "n_name")


@query("SELECT doc_id FROM documents WHERE contains(text, '%') OR contains(text, '_')")
def flt3_literal_like(t: Tables):
    return t.documents.where(F.contains("text", F.lit("%")) | F.contains("text", F.lit("_"))).select("doc_id")


@query("SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') BETWEEN '1997-01-01' AND '1997-06-30'")
def flt4_iso_date_range(t: Tables):
    day = F.date_format(F.col("o_orderdate"), "yyyy-MM-dd")
    return t.orders.where(day.between("1997-01-01", "1997-06-30")).select("o_orderkey")


@query("SELECT event_id FROM events WHERE ts > (SELECT min(ts) FROM events) + INTERVAL 20 DAY")
def flt5_after_cursor(t: Tables):
    first = t.events.agg(F.min("ts")).first()[0]
    return t.events.where(F.col("ts") > F.lit(first) + F.expr("interval 20 days")).select("event_id")


@query("""
SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN true WHEN source IN ('src3') THEN false END AS flag FROM documents""")
def flt6_tri_state(t: Tables):
    return t.documents.select("doc_id", F.when(F.col("source").isin("src1", "src2"), True).when(F.col("source") == "src3", False).alias("flag"))


@query("""
SELECT c.conv_id FROM conversations c GROUP BY 1 HAVING count(*) FILTER (role = 'system') > 0""")
def flt7_nonempty_array(t: Tables):
    items = t.conversations.groupBy("conv_id").agg(F.collect_list(F.when(F.col("role") == "system", F.col("turn"))).alias("agenda"))
    return items.where(F.coalesce(F.size("agenda"), F.lit(0)) > 0).select("conv_id")


@query("SELECT doc_id FROM documents d WHERE n_chars < 500 AND source <> 'src0' AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def flt8_empty_page(t: Tables):
    return t.documents.where("n_chars < 500 and source <> 'src0'").join(t.labels, "doc_id", "left_anti").select("doc_id")


@query("SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1 AND toxic = 0)")
def flt9_good_transcript(t: Tables):
    return t.documents.join(t.labels.where("quality = 1 and toxic = 0"), "doc_id", "left_semi").select("doc_id")


@query("SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) FILTER (contains(text, '###') OR contains(text, '%%%')) = 0")
def flt10_warning_free(t: Tables):
    texts = t.conversations.groupBy("conv_id").agg(F.collect_list("text").alias("w"))
    bad = F.exists("w", lambda x: F.contains(x, F.lit("###")) | F.contains(x, F.lit("%%%")))
    return texts.where(~bad).select("conv_id")


@query("""
SELECT doc_id, concat_ws(',', CASE WHEN n_chars < 300 THEN 'short' END, CASE WHEN lang <> 'en' THEN 'language' END, CASE WHEN toxic = 1 THEN 'flagged' END) AS reasons
FROM documents LEFT JOIN labels USING (doc_id) WHERE n_chars < 300 OR lang <> 'en' OR toxic = 1""")
def flt11_review_queue(t: Tables):
    rows = t.documents.join(t.labels, "doc_id", "left")
    reasons = F.array_compact(F.array(F.when(F.col("n_chars") < 300, "short"), F.when(F.col("lang") != "en", "language"), F.when(F.col("toxic") == 1, "flagged")))
    return rows.select("doc_id", reasons.alias("r")).where(F.size("r") > 0).select("doc_id", F.array_join("r", ",").alias("reasons"))


@query("""
SELECT user_id, event_id, value FROM events WHERE event_type <> 'error' AND (value > 50 OR ts >= TIMESTAMP '2024-01-29')
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def flt12_cache_lookup(t: Tables):
    """Newest usable answer of each key: successes with a result, or fresh ones."""
    fresh = (F.col("value") > 50) | (F.col("ts") >= F.lit("2024-01-29").cast("timestamp_ntz"))
    usable = t.events.where((F.col("event_type") != "error") & fresh)
    best = usable.groupBy("user_id").agg(F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("b"))
    return best.select("user_id", "b.event_id", "b.value")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND (o_orderdate IS NULL OR o_orderdate < TIMESTAMP '1996-01-01')")
def flt14_candidates(t: Tables):
    old = F.col("o_orderdate").isNull() | (F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz"))
    return t.orders.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & old).select("o_orderkey")


@query("SELECT n_nationkey FROM nation WHERE n_name LIKE '%\\_1' ESCAPE '\\' AND split_part(n_name, '_', -1) = '1'")
def flt15_anchored_suffix(t: Tables):
    return t.nation.where(F.endswith("n_name", F.lit("_1")) & (F.split_part("n_name", F.lit("_"), F.lit(-1)) == "1")).select("n_nationkey")


@query("SELECT event_id FROM events WHERE value BETWEEN 5 AND 20")
def flt16_plausible_range(t: Tables):
    return t.events.where(F.col("value").between(5, 20)).select("event_id")


@query("""
SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE source <> 'src0' AND n_chars >= 500 AND toxic = 0 AND (lang = 'en' OR lang IS NULL)""")
def flt17_quality_gate(t: Tables):
    rows = t.documents.join(t.labels, "doc_id")
    return rows.where("source <> 'src0' and n_chars >= 500 and toxic = 0 and (lang = 'en' or lang is null)").select("doc_id")


@query("SELECT page_id FROM pages WHERE contains(html, '<table') OR contains(html, '<ul>') OR length(html) > 8000")
def flt18_has_content(t: Tables):
    return t.pages.where(F.contains("html", F.lit("<table")) | F.contains("html", F.lit("<ul>")) | (F.length("html") > 8000)).select("page_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice > 0")
def flt21_publishable(t: Tables):
    return t.orders.where((F.col("o_orderstatus") != "P") & (F.col("o_totalprice") > 0)).select("o_orderkey")


@query("""
SELECT p_partkey, CASE WHEN p_type <> 'ECONOMY' THEN 'not_supported' WHEN p_size < 5 THEN 'too_small' WHEN p_size > 40 THEN 'too_large' ELSE 'ok' END AS verdict FROM part""")
def flt23_feasibility(t: Tables):
    size = F.col("p_size")
    verdict = F.when(F.col("p_type") != "ECONOMY", "not_supported").when(size < 5, "too_small").when(size > 40, "too_large").otherwise("ok")
    return t.part.select("p_partkey", verdict.alias("verdict"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM supplier WHERE lower(trim(replace(s_name, 'Supplier', ''))) = lower(trim(replace(c_name, 'Customer', ''))))")
def flt24_known_place(t: Tables):
    name = F.lower(F.trim(F.replace("c_name", F.lit("Customer"), F.lit(""))))
    known = t.supplier.select(F.lower(F.trim(F.replace("s_name", F.lit("Supplier"), F.lit("")))).alias("name"))
    return t.customer.withColumn("name", name).join(known, "name", "left_semi").select("c_custkey")


@query("SELECT count(*) FILTER (doc_id IN (1, 2, 3, 5, 8)) AS included, count(*) FILTER (doc_id IN (13, 21)) AS skipped FROM documents")
def flt20_id_filter(t: Tables):
    return t.documents.agg(F.count_if(F.col("doc_id").isin(1, 2, 3, 5, 8)).alias("included"), F.count_if(F.col("doc_id").isin(13, 21)).alias("skipped"))


@query("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND l.toxic = 0")
def jn1_left_default(t: Tables):
    return t.documents.join(t.labels.where("toxic = 0"), "doc_id", "left").select("doc_id", "quality")


@query("SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def jn2_job_page(t: Tables):
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_orderstatus")


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey = 1")
def jn3_three_way(t: Tables):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.join(t.nation.where("n_regionkey = 1"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("o_orderkey", "c_name", "n_name")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def jn4_anti(t: Tables):
    return t.customer.join(t.orders.where("o_orderstatus = 'F'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) AS large FROM customer")
def jn5_existence_column(t: Tables):
    keys = t.orders.where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("hit")).distinct()
    return t.customer.join(keys, "c_custkey", "left").select("c_custkey", F.col("hit").isNotNull().alias("large"))


@query("SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def jn6_lookup_join(t: Tables):
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("s_suppkey", "n_name", "r_name")


@query("SELECT d.doc_id, l.quality FROM documents d JOIN labels l USING (doc_id) WHERE quality = 1")
def jn8_dangling(t: Tables):
    return t.labels.where("quality = 1").join(t.documents.select("doc_id"), "doc_id").select("doc_id", "quality")


@query("""
SELECT e.event_id, (SELECT max(p.event_id) FROM (SELECT user_id, event_id, ts FROM events WHERE event_type = 'signup') p
  WHERE p.user_id = e.user_id AND p.ts <= e.ts) AS signup_id FROM events e WHERE event_type = 'purchase'""")
def jn10_as_of(t: Tables):
    """Each purchase with the last signup event of its user (event ids rise with time)."""
    left = t.events.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    right = t.events.where("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("signup_id"))
    return rel.as_of(left, right, "user_id", "ts", ["signup_id"]).select("event_id", "signup_id")


@query("""
SELECT p_partkey, arg_min(r_name, pos) AS place FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS cand, generate_subscripts(string_split(p_name, ' '), 1) AS pos FROM part) c
JOIN (SELECT r_name, CASE r_regionkey WHEN 0 THEN 'red' WHEN 1 THEN 'blue' WHEN 2 THEN 'bolt' ELSE 'ring' END AS key FROM region WHERE r_regionkey < 4) g ON cand = key GROUP BY 1""")
def jn11_gazetteer(t: Tables):
    """Ordered candidates of a name against a gazetteer: the first that is known."""
    key = F.when(F.col("r_regionkey") == 0, "red").when(F.col("r_regionkey") == 1, "blue").when(F.col("r_regionkey") == 2, "bolt").otherwise("ring")
    places = t.region.where("r_regionkey < 4").select("r_name", key.alias("cand"))
    words = t.part.select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("pos", "cand"))
    return words.join(places, "cand").groupBy("p_partkey").agg(F.min_by("r_name", F.col("pos")).alias("place"))


@query("SELECT c_custkey, CASE WHEN n = 1 THEN seg END AS state FROM customer JOIN (SELECT c_nationkey, count(DISTINCT c_mktsegment) AS n, min(c_mktsegment) AS seg FROM customer WHERE c_acctbal > 9500 GROUP BY 1) USING (c_nationkey)")
def jn12_unique_or_null(t: Tables):
    known = t.customer.where("c_acctbal > 9500").groupBy("c_nationkey").agg(F.count_distinct("c_mktsegment").alias("n"), F.min("c_mktsegment").alias("seg"))
    return t.customer.join(known, "c_nationkey").select("c_custkey", F.when(F.col("n") == 1, F.col("seg")).alias("state"))


@query("SELECT l_orderkey, l_partkey AS best_part FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey DESC, l_linenumber DESC) = 1")
def jn13_largest_overlap(t: Tables):
    best = t.lineitem.groupBy("l_orderkey").agg(F.max(F.struct("l_quantity", "l_partkey")).alias("b"))
    return best.select("l_orderkey", F.col("b.l_partkey").alias("best_part"))


@query("SELECT s_suppkey, r_name FROM supplier JOIN region ON r_regionkey = CAST(substring(s_name, 18, 1) AS INTEGER)")
def jn14_code_map(t: Tables):
    return t.supplier.withColumn("r_regionkey", F.substring("s_name", 18, 1).try_cast("int")).join(F.broadcast(t.region), "r_regionkey").select("s_suppkey", "r_name")


@query("""
WITH w AS (SELECT e.event_id, e.ts::DATE AS d, e.event_type FROM events e WHERE value > 45),
c AS (SELECT w.event_id, o.event_id AS candidate, count(*) OVER (PARTITION BY w.event_id) AS n FROM w JOIN (SELECT event_id, ts::DATE AS d, event_type FROM events WHERE value < 0.2) o ON o.d = w.d AND o.event_type = w.event_type)
SELECT event_id, candidate FROM c WHERE n = 1""")
def jn17_unambiguous_match(t: Tables):
    """A match on day and kind counts only if there is exactly one."""
    day = F.to_date("ts").alias("d")
    wanted = t.events.where("value > 45").select("event_id", day, "event_type")
    offers = t.events.where("value < 0.2").select(F.col("event_id").alias("candidate"), day, "event_type")
    one = offers.groupBy("d", "event_type").agg(F.count("*").alias("n"), F.min("candidate").alias("candidate")).where("n = 1")
    return wanted.join(one, ["d", "event_type"]).select("event_id", "candidate")


@query("""
SELECT o_orderkey, coalesce(a.s_suppkey, b.s_suppkey) AS found FROM orders LEFT JOIN supplier a ON a.s_suppkey = year(o_orderdate) - 1990 AND a.s_acctbal > 0
LEFT JOIN supplier b ON b.s_suppkey = year(o_orderdate) - 1991""")
def jn18_fallback_probe(t: Tables):
    year = F.year("o_orderdate")
    now = t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("a"))
    before = t.supplier.select(F.col("s_suppkey").alias("b"))
    rows = t.orders.select("o_orderkey", (year - 1990).alias("y")).join(now, F.col("y") == F.col("a"), "left").join(before, F.col("y") - 1 == F.col("b"), "left")
    return rows.select("o_orderkey", F.coalesce("a", "b").alias("found"))


@query("SELECT count(*) AS n, coalesce(sum(n_chars), 0)::BIGINT AS chars, coalesce(sum(n_chars - length(text)), 0)::BIGINT AS rest FROM documents")
def agg1_counts(t: Tables):
    return t.documents.agg(F.count("*").alias("n"), long(F.coalesce(F.sum("n_chars"), F.lit(0)), "chars"), long(F.coalesce(F.sum(F.col("n_chars") - F.length("text")), F.lit(0)), "rest"))


@query("""
SELECT count(*) FILTER (o_orderstatus = 'P') AS queued, count(*) FILTER (o_orderstatus = 'O') AS running, count(*) FILTER (o_orderstatus = 'F') AS done,
 round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 0), 2) AS remaining, max(o_orderdate) AS newest, min(o_orderdate) AS oldest, count(DISTINCT o_custkey) AS requesters FROM orders""")
def agg5_queue_summary(t: Tables):
    def status(s):
        return F.col("o_orderstatus") == s

    return t.orders.agg(
        F.count_if(status("P")).alias("queued"), F.count_if(status("O")).alias("running"), F.count_if(status("F")).alias("done"),
        F.round(F.coalesce(F.sum(F.when(status("P"), F.col("o_totalprice"))), F.lit(0.0)), 2).alias("remaining"),
        F.max("o_orderdate").alias("newest"), F.min("o_orderdate").alias("oldest"), F.count_distinct("o_custkey").alias("requesters"),
    )


@query("SELECT sum(n)::BIGINT AS segments FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)")
def agg4_array_length_sum(t: Tables):
    arrays = t.conversations.groupBy("conv_id").agg(F.collect_list("turn").alias("segments"))
    return arrays.agg(F.sum(F.size("segments")).alias("segments"))


@query("""
SELECT day, total, total - lag(total) OVER (ORDER BY day) AS delta FROM (SELECT ts::DATE AS day, sum(count(*)) OVER (ORDER BY ts::DATE)::BIGINT AS total FROM events GROUP BY 1)""")
def agg6_snapshot_delta(t: Tables):
    """Cumulative daily snapshots (a bounded number of days) and their change."""
    days = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    return days.select("day", total.alias("total")).select("day", "total", (F.col("total") - F.lag("total").over(Window.orderBy("day"))).alias("delta"))


@query("SELECT source, lang, count(*) AS pages, max(n_chars) AS largest FROM documents GROUP BY 1, 2")
def agg7_hub_groups(t: Tables):
    return t.documents.groupBy("source", "lang").agg(F.count("*").alias("pages"), F.max("n_chars").alias("largest"))


@query("""
SELECT slug, sum(pages)::BIGINT AS pages, max(latest) AS latest, string_agg(source, ',' ORDER BY source) AS names FROM
(SELECT source, substring(source, 1, 4) AS slug, count(*) AS pages, max(n_chars) AS latest FROM documents GROUP BY 1) GROUP BY slug HAVING sum(pages) >= 2""")
def agg8_two_stage(t: Tables):
    groups = t.documents.groupBy("source").agg(F.count("*").alias("pages"), F.max("n_chars").alias("latest"))
    merged = groups.groupBy(F.substring("source", 1, 4).alias("slug")).agg(F.sum("pages").alias("pages"), F.max("latest").alias("latest"), F.array_join(F.array_sort(F.collect_list("source")), ",").alias("names"))
    return merged.where("pages >= 2")


OUTCOME = "CASE WHEN n_chars < 200 THEN 'no_video' WHEN quality IS NULL THEN 'blank' WHEN toxic = 1 THEN 'garbled' WHEN lang <> 'en' THEN 'non_english' ELSE 'success' END"


def outcome():
    return (
        F.when(F.col("n_chars") < 200, "no_video").when(F.col("quality").isNull(), "blank").when(F.col("toxic") == 1, "garbled").when(F.col("lang") != "en", "non_english").otherwise("success")
    )


@query(f"SELECT {OUTCOME} AS outcome, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def agg9_outcomes(t: Tables):
    return t.documents.join(t.labels, "doc_id", "left").groupBy(outcome().alias("outcome")).agg(F.count("*").alias("n"))


@query("""
SELECT CASE WHEN regexp_matches(url, '/[0-9]+$') THEN 'plain' WHEN regexp_matches(url, '\\.html') THEN 'html' WHEN regexp_matches(url, '[?]') THEN 'query' WHEN regexp_matches(url, '#') THEN 'fragment' ELSE 'other' END AS shape, count(*) AS n, min(url) AS example FROM pages GROUP BY 1""")
def agg10_shape_histogram(t: Tables):
    u = F.col("url")
    shape = F.when(u.rlike("/[0-9]+$"), "plain").when(u.rlike(r"\.html"), "html").when(u.rlike("[?]"), "query").when(u.rlike("#"), "fragment").otherwise("other")
    return t.pages.groupBy(shape.alias("shape")).agg(F.count("*").alias("n"), F.min("url").alias("example"))


RANKED = "CASE o WHEN 'success' THEN 0 WHEN 'non_english' THEN 1 WHEN 'garbled' THEN 2 WHEN 'blank' THEN 3 ELSE 5 END"


@query(f"""
SELECT source, count(*) AS pages, bool_or(quality = 1) IS TRUE AS any_good, bool_or(toxic = 1) IS TRUE AS any_flag, bool_or(lang <> 'en') AS any_foreign, max(n_chars) AS largest,
 arg_min(doc_id, rnk * 1000000 + doc_id) AS example FROM (SELECT *, {RANKED} AS rnk FROM (SELECT d.*, quality, toxic, {OUTCOME} AS o FROM documents d LEFT JOIN labels USING (doc_id))) GROUP BY 1""")
def agg11_coverage(t: Tables):
    rows = t.documents.join(t.labels, "doc_id", "left").withColumn("o", outcome())
    rank = F.when(F.col("o") == "success", 0).when(F.col("o") == "non_english", 1).when(F.col("o") == "garbled", 2).when(F.col("o") == "blank", 3).otherwise(5)
    return rows.groupBy("source").agg(
        F.count("*").alias("pages"), F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("any_good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("any_flag"),
        F.bool_or(F.col("lang") != "en").alias("any_foreign"), F.max("n_chars").alias("largest"), F.min_by("doc_id", F.struct(rank, "doc_id")).alias("example"),
    )


@query("""
SELECT source, count(*) AS pages, arg_min(doc_id, CASE WHEN l.doc_id2 IS NULL THEN 1000000 ELSE 0 END + doc_id) AS example
FROM documents d LEFT JOIN (SELECT doc_id AS doc_id2 FROM labels) l ON d.doc_id = l.doc_id2 GROUP BY 1""")
def agg12_preferred_example(t: Tables):
    has = t.labels.select("doc_id", F.lit(True).alias("has")).distinct()
    rows = t.documents.join(has, "doc_id", "left")
    return rows.groupBy("source").agg(F.count("*").alias("pages"), F.min_by("doc_id", F.struct(F.col("has").isNull(), "doc_id")).alias("example"))


@query("""
SELECT r_name, count(DISTINCT n_nationkey) AS nations, count(*) AS customers, max(c_acctbal) AS top FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def agg13_state_index(t: Tables):
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name").agg(F.count_distinct("n_nationkey").alias("nations"), F.count("*").alias("customers"), F.max("c_acctbal").alias("top")).orderBy(F.col("r_name") != "AMERICA", "r_name")


@query("""
SELECT source, count(*) AS pages, count(*) FILTER (quality = 1) AS good, min(n_chars) AS smallest, max(n_chars) AS largest,
 string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1 HAVING count(*) >= 2""")
def agg14_hub_data(t: Tables):
    rows = t.documents.join(t.labels, "doc_id", "left")
    out = rows.groupBy("source").agg(F.count("*").alias("pages"), F.count_if(F.col("quality") == 1).alias("good"), F.min("n_chars").alias("smallest"), F.max("n_chars").alias("largest"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))
    return out.where("pages >= 2")


@query("SELECT lang, source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) <= 25")
def agg15_state_page_top(t: Tables):
    """The 25 largest pages of each state (here: language)."""
    return rel.keep_latest(t.documents.select("lang", "source", "doc_id", "n_chars"), ["lang"], F.desc("n_chars"), F.col("doc_id"), k=25)


@query("SELECT n_nationkey, n_name, count(s_suppkey) AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY 1, 2")
def agg16_registry_left(t: Tables):
    rows = t.nation.join(t.supplier.where("s_acctbal > 5000"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return rows.groupBy("n_nationkey", "n_name").agg(F.count("s_suppkey").alias("suppliers"))


@query("""
WITH r AS (SELECT d.source, d.doc_id, d.lang, l.doc_id IS NOT NULL AS has, row_number() OVER (PARTITION BY d.source, d.lang ORDER BY l.doc_id IS NOT NULL DESC, d.doc_id) > 1 AS again FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT source, doc_id, lang FROM r QUALIFY row_number() OVER (PARTITION BY source ORDER BY again, has DESC, doc_id) <= 5""")
def agg17_diverse_examples(t: Tables):
    has = t.labels.select("doc_id", F.lit(True).alias("has")).distinct()
    rows = t.documents.join(has, "doc_id", "left").withColumn("has", F.coalesce("has", F.lit(False)))
    return rel.diverse_examples(rows, ["source"], "lang", F.col("has"), "doc_id", 5).select("source", "doc_id", "lang")


@query("SELECT event_type, CASE WHEN value > 10 THEN 'high' ELSE 'low' END AS outcome, count(*) AS n FROM events GROUP BY 1, 2")
def agg18_two_keys(t: Tables):
    return t.events.groupBy("event_type", F.when(F.col("value") > 10, "high").otherwise("low").alias("outcome")).agg(F.count("*").alias("n")).orderBy("event_type", "outcome")


@query("SELECT user_id, round(count(*) FILTER (event_type <> 'error')::DOUBLE / count(*), 6) AS rate, round(avg(value), 4) AS mean FROM events GROUP BY 1")
def agg19_rates(t: Tables):
    rate = F.try_divide(F.count_if(F.col("event_type") != "error"), F.count("*"))
    return t.events.groupBy("user_id").agg(F.round(rate, 6).alias("rate"), F.round(F.avg("value"), 4).alias("mean"))


@query("SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, count(*) AS n FROM pages GROUP BY 1")
def agg25_by_host(t: Tables):
    return t.pages.groupBy(F.lower(F.try_parse_url("url", F.lit("HOST"))).alias("host")).agg(F.count("*").alias("n"))


@query("""
SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, CASE WHEN contains(url, '?') THEN 'query' ELSE 'path' END AS reason, count(*) AS n, min(page_id) AS example FROM pages GROUP BY GROUPING SETS ((host), (reason))""")
def agg26_stuck_report(t: Tables):
    rows = t.pages.select("page_id", F.try_parse_url("url", F.lit("HOST")).alias("host"), F.when(F.contains("url", F.lit("?")), "query").otherwise("path").alias("reason"))
    return rows.groupingSets([["host"], ["reason"]], "host", "reason").agg(F.count("*").alias("n"), F.min("page_id").alias("example")).select("host", "reason", "n", "example")


@query("""
SELECT source, arg_max(lang, w * 100 - ascii(lang) % 100) AS lang FROM (SELECT source, lang, sum(length(text)) AS w FROM documents GROUP BY 1, 2) GROUP BY 1""")
def agg27_language_vote(t: Tables):
    """The language with most characters of each source."""
    votes = t.documents.groupBy("source", "lang").agg(F.sum(F.length("text")).alias("w"))
    return votes.groupBy("source").agg(F.max_by("lang", F.struct("w", -F.ascii("lang"))).alias("lang"))


@query("SELECT source, count(*) FILTER (quality = 1) AS pass, count(*) FILTER (quality = 0 AND toxic = 0) AS partial, count(*) FILTER (toxic = 1) AS fail FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def agg28_scorecard(t: Tables):
    rows = t.documents.join(t.labels, "doc_id")
    return rows.groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("pass"), F.count_if((F.col("quality") == 0) & (F.col("toxic") == 0)).alias("partial"), F.count_if(F.col("toxic") == 1).alias("fail"))


@query("SELECT source, round(sum(c)::DOUBLE / sum(c * n), 6) AS ratio, sum(c * n)::BIGINT AS total_chars FROM (SELECT source, text, length(text) AS c, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY 1")
def agg29_retained_ratio(t: Tables):
    once = t.documents.groupBy("source", F.md5(F.col("text").cast("binary")).alias("h")).agg(F.first(F.length("text")).alias("c"), F.count("*").alias("n"))
    return once.groupBy("source").agg(F.round(F.sum("c") / F.sum(F.col("c") * F.col("n")), 6).alias("ratio"), F.sum(F.col("c") * F.col("n")).alias("total_chars"))


@query("SELECT count(*) AS n, count(*) FILTER (d IS NULL) AS undated, min(d) AS oldest, max(d) AS newest FROM (SELECT CASE WHEN event_type <> 'view' THEN ts::DATE END AS d FROM events)")
def agg30_ledger_stats(t: Tables):
    rows = t.events.select(F.when(F.col("event_type") != "view", F.to_date("ts")).alias("d"))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("d").isNull()).alias("undated"), F.min("d").alias("oldest"), F.max("d").alias("newest"))


@query("SELECT greatest(max(n) * 30.0, sum(n) * 30.0 / 8)::DOUBLE AS seconds FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)")
def agg31_wall_clock(t: Tables):
    lanes = t.documents.groupBy("source").agg(F.count("*").alias("n"))
    return lanes.agg(F.greatest(F.max("n") * 30.0, F.sum("n") * 30.0 / 8).cast("double").alias("seconds"))


@query("SELECT doc_id, n_chars, count(*) OVER () AS total, greatest(1, ceil(count(*) OVER () / 50))::BIGINT AS pages FROM documents WHERE lang = 'de' ORDER BY n_chars DESC, doc_id DESC LIMIT 50 OFFSET 50")
def win1_total_beside_page(t: Tables):
    """Page 2 of 50 with the total and the number of pages (top1, top2, top3)."""
    rows = t.documents.where("lang = 'de'").select("doc_id", "n_chars")
    page = rel.page_with_total(rows, [F.desc("n_chars"), F.desc("doc_id")], 50, 50)
    return page.withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / 50)).cast("long"))


@query("""
SELECT user_id, max(n) AS burst FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n FROM events WHERE event_type = 'error') GROUP BY 1""")
def win2_burst(t: Tables):
    errors = t.events.where("event_type = 'error'").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-3_600_000_000, 0)
    return errors.select("user_id", F.count("*").over(w).alias("n")).groupBy("user_id").agg(F.max("n").alias("burst"))


@query("""
SELECT user_id, count(*) FILTER (breaks = 0) AS streak FROM (SELECT user_id, sum(CASE WHEN value > 10 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS breaks FROM events) GROUP BY 1""")
def win3_streak(t: Tables):
    """Consecutive failures (values up to 10) from the newest event back."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, 0)
    rows = t.events.select("user_id", F.sum((F.col("value") > 10).cast("int")).over(w).alias("breaks"))
    return rows.groupBy("user_id").agg(F.count_if(F.col("breaks") == 0).alias("streak"))


@query("SELECT o_custkey, o_orderkey AS latest FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def win4_latest_per_key(t: Tables):
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'F' DESC, o_orderdate, o_orderkey) AS place FROM orders")
def win5_ordered_versions(t: Tables):
    w = Window.partitionBy("o_custkey").orderBy((F.col("o_orderstatus") == "F").desc(), "o_orderdate", "o_orderkey")
    return t.orders.select("o_custkey", "o_orderkey", long(F.row_number().over(w), "place"))


@query("""
SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 + 0.5)::DOUBLE * count(*) OVER () / count(*) OVER (PARTITION BY source) AS position FROM documents""")
def win13_interleave(t: Tables):
    return rel.interleave(t.documents.select("source", "doc_id"), "source", "doc_id").select("source", "doc_id", "position")


@query("SELECT text AS url, min(doc_id) AS first_at FROM (SELECT doc_id, source || '/' || lang AS text FROM documents) GROUP BY 1")
def win14_first_seen(t: Tables):
    return t.documents.groupBy(F.concat_ws("/", "source", "lang").alias("url")).agg(F.min("doc_id").alias("first_at"))


@query("SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality DESC NULLS LAST, doc_id LIMIT 100")
def top5_nulls_last(t: Tables):
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", "quality").orderBy(F.desc_nulls_last("quality"), "doc_id").limit(100)


@query("SELECT p_partkey, p_name FROM part ORDER BY lower(p_name), p_name, p_partkey LIMIT 40")
def top6_case_folded(t: Tables):
    return t.part.select("p_partkey", "p_name").orderBy(F.lower("p_name"), "p_name", "p_partkey").limit(40)


@query("SELECT doc_id, coalesce(CASE WHEN quality = 1 THEN source END, '') AS date FROM documents LEFT JOIN labels USING (doc_id) ORDER BY 2 DESC, doc_id LIMIT 25")
def top7_coalesced_sort(t: Tables):
    date = F.coalesce(F.when(F.col("quality") == 1, F.col("source")), F.lit(""))
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", date.alias("date")).orderBy(F.desc("date"), "doc_id").limit(25)


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 1")
def top9_queue_head(t: Tables):
    return t.orders.where("o_orderstatus = 'P'").orderBy("o_orderpriority", "o_orderdate", "o_orderkey").limit(1).select("o_orderkey", "o_orderpriority")


@query("SELECT doc_id FROM documents WHERE len(string_split(text, ' ')) > 1000 AND contains(text, 'the') ORDER BY doc_id LIMIT 20")
def top10_first_passing(t: Tables):
    """The first 20 that pass an expensive test."""
    return t.documents.where((F.size(F.split("text", " ")) > 1000) & F.contains("text", F.lit("the"))).orderBy("doc_id").limit(20).select("doc_id")


@query("""
(SELECT o_orderkey, true AS flagged FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey > 5000)
UNION ALL (SELECT o_orderkey, false FROM (SELECT o_orderkey FROM orders WHERE o_orderpriority <> '1-URGENT' AND o_orderkey > 5000 ORDER BY o_orderkey LIMIT 100))""")
def top11_keyset_union(t: Tables):
    """Flagged rows all, others a keyset page of 100 (set1)."""
    later = t.orders.where("o_orderkey > 5000")
    flagged = later.where("o_orderpriority = '1-URGENT'").select("o_orderkey", F.lit(True).alias("flagged"))
    rest = later.where("o_orderpriority <> '1-URGENT'").orderBy("o_orderkey").limit(100).select("o_orderkey", F.lit(False).alias("flagged"))
    return flagged.unionByName(rest)


@query("SELECT event_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 20")
def top12_recent_failures(t: Tables):
    return t.events.where("event_type = 'error'").orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id")


@query("SELECT doc_id, source FROM documents WHERE n_chars >= 200 ORDER BY doc_id DESC LIMIT 50")
def top13_feed(t: Tables):
    return t.documents.where("n_chars >= 200").orderBy(F.desc("doc_id")).limit(50).select("doc_id", "source")


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2 HAVING count(*) >= 2")
def top15_indexable_hubs(t: Tables):
    return t.documents.groupBy("source", "lang").agg(F.count("*").alias("n")).where("n >= 2").orderBy("source", "lang")


@query("""
SELECT conv_id, arg_min(turn, rnk) AS pick FROM (SELECT conv_id, turn, CASE role WHEN 'system' THEN 0 WHEN 'assistant' THEN 1000 ELSE 2000 END + turn AS rnk FROM conversations) GROUP BY 1""")
def top17_track_pick(t: Tables):
    rank = F.when(F.col("role") == "system", 0).when(F.col("role") == "assistant", 1000).otherwise(2000)
    return t.conversations.groupBy("conv_id").agg(F.min_by("turn", F.struct(rank, "turn")).alias("pick"))


@query("SELECT n_name AS name FROM nation UNION SELECT r_name FROM region")
def set2_union_distinct(t: Tables):
    return t.nation.select(F.col("n_name").alias("name")).union(t.region.select("r_name")).distinct().orderBy("name")


@query("SELECT item_id AS id FROM benchmark EXCEPT SELECT doc_id FROM labels")
def set3_difference(t: Tables):
    return t.benchmark.select(F.col("item_id").alias("id")).subtract(t.labels.select("doc_id"))


@query("""
SELECT doc_id AS id, 'new' AS kind FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL
SELECT doc_id, 'kept' FROM (SELECT doc_id, min(quality) AS q FROM labels GROUP BY 1) WHERE q = 1""")
def set5_ledger(t: Tables):
    """Unseen ids are appended (set4); of the ledger, what is old goes."""
    ledger = t.labels.groupBy("doc_id").agg(F.min("quality").alias("q"))
    fresh = t.documents.join(ledger, "doc_id", "left_anti").select(F.col("doc_id").alias("id"), F.lit("new").alias("kind"))
    return fresh.unionByName(ledger.where("q = 1").select(F.col("doc_id").alias("id"), F.lit("kept").alias("kind")))


@query("SELECT p_partkey FROM part WHERE len(list_filter(['red', 'ring'], lambda w: NOT list_contains(string_split(p_name, ' '), w))) = 0")
def set6_subset(t: Tables):
    wanted = F.array(F.lit("red"), F.lit("ring"))
    return t.part.where(F.size(F.array_except(wanted, F.split("p_name", " "))) == 0).select("p_partkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def jn7_set_based_lookup(t: Tables):
    """What would be a lookup for each row, as one semi and one anti join."""
    poor = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    returned = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.join(poor, "o_custkey", "left_semi").join(returned, "o_orderkey", "left_anti").select("o_orderkey")


@query("SELECT conv_id, u.turn, a.turn AS answer FROM conversations u JOIN conversations a USING (conv_id) WHERE u.role = 'user' AND a.role = 'assistant' AND a.turn = u.turn + 1")
def jn16_items_to_points(t: Tables):
    """Items of a page looked up in the map of the page's points; items without a point are dropped."""
    assistant = F.col("role") == "assistant"
    pages = t.conversations.groupBy("conv_id").agg(
        F.map_from_entries(F.collect_set(F.when(assistant, F.struct((F.col("turn") - 1).alias("item"), F.col("turn"))))).alias("points"),
        F.collect_list(F.when(F.col("role") == "user", F.col("turn"))).alias("items"),
    )
    rows = pages.select("conv_id", F.explode("items").alias("turn"), "points")
    return rows.select("conv_id", "turn", F.try_element_at("points", F.col("turn")).alias("answer")).where("answer is not null")


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")
def top8_clamped_limit(t: Tables):
    """A wished limit of 5000 is held within 1 to 1000."""
    return t.events.orderBy(F.desc("ts"), F.desc("event_id")).limit(max(1, min(1000, 5000))).select("event_id")


@query("SELECT source, pages, row_number() OVER (ORDER BY pages DESC, source) AS place FROM (SELECT source, count(*) AS pages FROM documents WHERE lang = 'en' GROUP BY 1)")
def top16_renumbered_table(t: Tables):
    """A table of sources (few rows), filtered, sorted and numbered anew."""
    table = t.documents.where("lang = 'en'").groupBy("source").agg(F.count("*").alias("pages"))
    return table.select("source", "pages", long(F.row_number().over(Window.orderBy(F.desc("pages"), "source")), "place"))


@query("SELECT doc_id, min(tab) AS first_tab FROM (SELECT doc_id, 0 AS tab FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 1 FROM documents WHERE n_chars > 1000) GROUP BY 1")
def src17_two_tabs(t: Tables):
    """A listing over two tabs, the first mention of each id kept."""
    one = t.documents.where("lang = 'en'").select("doc_id", F.lit(0).alias("first_tab"))
    return one.unionByName(t.documents.where("n_chars > 1000").select("doc_id", F.lit(1).alias("first_tab"))).groupBy("doc_id").agg(F.min("first_tab").alias("first_tab"))


@query("""
SELECT event_id, CASE WHEN event_type = 'error' THEN 'resolve_failed' WHEN event_type = 'signup' THEN 'calendar_page' WHEN value < 2 THEN 'no_video' WHEN value < 4 THEN 'blank_transcript' WHEN value < 5 THEN 'garbled_transcript' WHEN user_id % 10 = 0 THEN 'non_english_transcript' ELSE 'success' END AS outcome FROM events""")
def str37_resolver_outcome(t: Tables):
    """Statuses other than success pass through; then flags decide in order."""
    kind, v = F.col("event_type"), F.col("value")
    status = F.when(kind == "error", "resolve_failed").when(kind == "signup", "calendar_page")
    flags = F.when(v < 2, "no_video").when(v < 4, "blank_transcript").when(v < 5, "garbled_transcript").when(F.col("user_id") % 10 == 0, "non_english_transcript").otherwise("success")
    return t.events.select("event_id", F.coalesce(status, flags).alias("outcome"))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)")
def set4_filter_unseen(t: Tables):
    have = t.supplier.select(F.col("s_nationkey").alias("n_nationkey")).distinct()
    seen = t.customer.where("c_acctbal > 9900").select(F.col("c_nationkey").alias("n_nationkey"))
    return t.nation.join(have, "n_nationkey", "left_semi").join(seen, "n_nationkey", "left_anti").select("n_nationkey", "n_name")
