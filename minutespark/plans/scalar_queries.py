"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from minutespark.functions import names, text, times, urls
from minutespark.operators import places
from minutespark.plans.registry import Tables, query

HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1))"
_RULES = "CASE " + " ".join(
    f"WHEN regexp_matches({HOST if what == 'host' else 'regexp_extract(url, $$^[a-z]+://[^/?#]*([^?#]*)$$, 1)'}, '{pattern}') THEN '{label}'" for label, what, pattern in urls.PLATFORM_RULES
) + " ELSE 'unknown' END"


@query("""
WITH u AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS w FROM pages),
p AS (SELECT page_id, lower(regexp_extract(w, '^([a-z]+://[^/?]*)', 1)) AS head, split_part(regexp_replace(w, '^[a-z]+://[^/?]*', ''), '?', 1) AS path, CASE WHEN contains(w, '?') THEN regexp_extract(w, '[?](.*)$', 1) END AS q FROM u)
SELECT page_id, head || CASE WHEN length(path) > 1 THEN regexp_replace(path, '/$', '') ELSE path END || CASE WHEN q <> '' THEN '?' || array_to_string(list_sort(string_split(q, '&')), '&') ELSE '' END AS url FROM p""")
def str1_url_normalize(t: Tables):
    return t.pages.select("page_id", urls.normalize(F.col("url")).alias("url"))


@query(f"SELECT page_id, {HOST} AS host, split_part({HOST}, '.', -2) || '.' || split_part({HOST}, '.', -1) AS domain FROM pages")
def str2_host(t: Tables):
    """Host and registered domain (str3)."""
    h = urls.host(F.col("url"))
    return t.pages.select("page_id", h.alias("host"), urls.registered_domain(h).alias("domain"))


@query(f"SELECT page_id, {_RULES} AS platform FROM pages")
def str4_platform(t: Tables):
    return t.pages.select("page_id", urls.platform(F.col("url")).alias("platform"))


@query(f"SELECT {_RULES} AS platform, CASE WHEN {_RULES} IN ('blog', 'www', 'mobile') THEN 'wrapper' WHEN {_RULES} = 'unknown' THEN 'unknown' ELSE 'native' END AS kind, count(*) AS n FROM pages GROUP BY 1, 2")
def str5_delegation(t: Tables):
    p = urls.platform(F.col("url"))
    kind = F.when(p.isin("blog", "www", "mobile"), "wrapper").when(p == "unknown", "unknown").otherwise("native")
    return t.pages.groupBy(p.alias("platform"), kind.alias("kind")).agg(F.count("*").alias("n"))


MARKERS = [("click", "user"), ("view", "user"), ("signup", "account")]


@query("""SELECT event_id, CASE WHEN contains(m, 'click') THEN 'user' WHEN contains(m, 'view') THEN 'user' WHEN contains(m, 'signup') THEN 'account'
 WHEN regexp_extract(m, '\\b([45]\\d\\d)\\b', 1) <> '' THEN 'http_' || regexp_extract(m, '\\b([45]\\d\\d)\\b', 1) ELSE 'other' END AS bucket
FROM (SELECT event_id, event_type || ' status ' || CAST(400 + user_id % 150 AS VARCHAR) AS m FROM events)""")
def str6_reason_bucket(t: Tables):
    message = F.concat(F.col("event_type"), F.lit(" status "), (400 + F.col("user_id") % 150).cast("string"))
    return t.events.select("event_id", text.reason_bucket(message, MARKERS).alias("bucket"))


SLUG = "regexp_replace(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"


@query(f"SELECT p_partkey, regexp_replace(left({SLUG.format('p_name || $$ $$ || p_brand || $$ $$ || p_type')}, 16), '-$', '') AS slug FROM part")
def str7_slug(t: Tables):
    return t.part.select("p_partkey", names.base_slug(F.col("p_name"), F.col("p_brand"), F.col("p_type"), longest=16).alias("slug"))


@query(f"""
SELECT p_partkey, CASE WHEN p_partkey = min(p_partkey) OVER (PARTITION BY slug) THEN slug ELSE slug || '-' || left(sha256(CAST(p_partkey AS VARCHAR)), 8) END AS slug
FROM (SELECT p_partkey, {SLUG.format('p_name')} AS slug FROM part)""")
def str7_unique_slug(t: Tables):
    return names.unique_slugs(t.part.select("p_partkey", names.slug(F.col("p_name")).alias("slug")), "slug", "p_partkey")


@query("""
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'TX' WHEN 1 THEN 'OH' END AS state FROM customer""")
def str8_state_suffix(t: Tables):
    k = F.col("c_custkey") % 4
    place = F.concat(F.col("c_name"), F.when(k == 0, ", Texas").when(k == 1, ", OH").when(k == 2, ", nowhere").otherwise(""))
    return t.customer.select("c_custkey", names.state_suffix(place).alias("state"))


@query(f"""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN 'City and County of ' || c_name ELSE c_name END AS shown, {SLUG.format("CASE WHEN c_custkey % 3 = 2 THEN 'City and County of ' || c_name ELSE c_name END")} AS hub FROM customer""")
def str10_display(t: Tables):
    k = F.col("c_custkey") % 3
    raw = F.concat(F.when(k == 0, "City of ").when(k == 1, "The city of ").otherwise("City and County of "), F.col("c_name"))
    shown = names.display(raw)
    return t.customer.select("c_custkey", shown.alias("shown"), names.slug(shown).alias("hub"))


@query("""
SELECT c_custkey, 'saint ' || n AS name, list_distinct(['saint ' || n, n, 'saint ' || split_part(n, ' ', 1)]) IS NOT NULL AS has FROM (SELECT c_custkey, lower(replace(c_name, '#', ' ')) AS n FROM customer)""")
def str11_normalize_name(t: Tables):
    """Abbreviations are written out (str12)."""
    raw = F.concat(F.lit("St. "), F.col("c_name"))
    return t.customer.select("c_custkey", names.normalize(raw).alias("name"), (F.size(names.candidates(raw)) > 0).alias("has"))


@query("SELECT p_partkey, split_part(p_name, ' ', 1) AS prefix, split_part(p_name, ' ', 2) AS tail FROM part WHERE split_part(p_name, ' ', 1) IN (SELECT split_part(p_name, ' ', 1) FROM part WHERE p_size = 1)")
def str13_longest_known_prefix(t: Tables):
    known = t.part.where("p_size = 1").select(F.substring_index("p_name", " ", 1).alias("known")).distinct()
    return names.longest_known_prefix(t.part, "p_partkey", "p_name", known, "known")


@query("SELECT s_suppkey, 'Board' AS body, replace(s_name, '#', ' ') AS place FROM supplier")
def str14_split_entity(t: Tables):
    body, place = names.split_entity(F.concat(F.lit("Board of "), F.replace("s_name", F.lit("#"), F.lit(" "))))
    return t.supplier.select("s_suppkey", body.alias("body"), place.alias("place"))


@query("""
SELECT s_suppkey, CASE WHEN r.r_regionkey = 0 THEN 'authoritative' WHEN s_acctbal < 0 AND s_suppkey % 2 = 0 THEN 'fallback' WHEN s_acctbal < 0 THEN 'blank' WHEN k.n_nationkey IS NOT NULL THEN 'validated' WHEN s_acctbal > 9000 THEN 'repaired'
 WHEN s_suppkey % 2 = 0 THEN 'fallback' ELSE 'unverified' END AS confidence
FROM supplier JOIN nation n ON s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey LEFT JOIN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) k ON k.n_nationkey = s_nationkey""")
def str15_confidence(t: Tables):
    known = t.nation.where("n_regionkey = 1").select(F.col("n_nationkey").alias("known"))
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(known, F.col("s_nationkey") == F.col("known"), "left")
    name = F.when(F.col("s_acctbal") >= 0, F.col("s_name"))
    found = names.confidence(F.col("n_regionkey") == 0, name, F.col("known").isNotNull(), F.col("s_acctbal") > 9000, F.col("s_suppkey") % 2 == 0)
    return rows.select("s_suppkey", found.alias("confidence"))


@query("""
SELECT page_id, coalesce(a.n_name, b.r_name, 'none') AS state FROM (SELECT page_id, split_part(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '.', -1) AS tld, page_id % 30 AS k FROM pages)
LEFT JOIN (SELECT 'org' AS tld, n_name FROM nation WHERE n_nationkey = 0) a USING (tld) LEFT JOIN region b ON b.r_regionkey = k""")
def str17_resolve_state(t: Tables):
    """Domain registry (str16) first, then a name lookup, then a default."""
    rows = t.pages.select("page_id", F.substring_index(urls.host(F.col("url")), ".", -1).alias("tld"), (F.col("page_id") % 30).alias("k"))
    registry = t.nation.where("n_nationkey = 0").select(F.lit("org").alias("tld"), "n_name")
    rows = rows.join(F.broadcast(registry), "tld", "left").join(t.region, F.col("k") == F.col("r_regionkey"), "left")
    return rows.select("page_id", F.coalesce("n_name", "r_name", F.lit("none")).alias("state"))


@query("SELECT s_suppkey, ['OH ' || (10000 + s_suppkey), 'TX ' || (20000 + s_suppkey)] AS zips FROM supplier")
def str18_zip_addresses(t: Tables):
    k = F.col("s_suppkey")
    address = F.concat(F.lit("1 Main St, Town, OH "), 10000 + k, F.lit(" and Elm, TX "), 20000 + k, F.lit(". Oh 123"))
    return t.supplier.select("s_suppkey", text.zip_addresses(address).alias("zips"))


@query("""
SELECT page_id, CASE k WHEN 0 THEN 'text' WHEN 1 THEN 'text' WHEN 2 THEN 'markup' WHEN 3 THEN 'host' END AS tier, CASE k WHEN 0 THEN 'City' WHEN 1 THEN 'County' WHEN 2 THEN 'Town' END AS body,
 CASE WHEN k < 4 THEN lower(p_name) END AS place, CASE WHEN k = 1 THEN 'repaired' WHEN k < 4 THEN 'validated' END AS confidence
FROM (SELECT page_id, page_id % 5 AS k, page_id % (SELECT count(*) FROM part) AS p_partkey FROM pages) JOIN part USING (p_partkey)""")
def str20_place_of_page(t: Tables):
    """Part names as the table of places, one on each page: in its text (with words too many in some), its markup, or its host."""
    size = t.part.count()
    rows = t.pages.withColumn("p_partkey", F.col("page_id") % size).join(t.part.select("p_partkey", "p_name"), "p_partkey")
    k, name = F.col("page_id") % 5, F.initcap("p_name")
    head = (
        F.when(k == 0, F.concat(F.lit("<p>Welcome to the City of "), name, F.lit(". Next Steps</p>")))
        .when(k == 1, F.concat(F.lit("<p>County of "), name, F.lit(" Residents met</p>")))
        .when(k == 2, F.concat(F.lit("<h1>TOWN OF "), F.upper("p_name"), F.lit("</h1>")))
        .otherwise("<p>City of Nowhere Known, nothing</p>")
    )
    url = F.when(k == 3, F.concat(F.lit("https://cityof"), F.regexp_replace(F.lower("p_name"), "[^a-z]", ""), F.lit(".example.org/1"))).otherwise("https://www.example.org/1")
    html = F.concat(head, F.lit(" "), F.coalesce("html", F.lit("")))
    pages = rows.select("page_id", html.alias("html"), F.regexp_replace(html, "<[^>]*>", " ").alias("text"), url.alias("url"))
    return places.of_pages(pages, "page_id", "text", "html", "url", t.part, "p_name")


@query("""
WITH m AS (SELECT event_id, round_even(value * 1000, 0)::BIGINT AS ms, floor(value * 97)::BIGINT AS s FROM events)
SELECT event_id, lpad((ms // 3600000)::VARCHAR, 2, '0') || ':' || lpad((ms // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((ms // 1000 % 60)::VARCHAR, 2, '0') || ',' || lpad((ms % 1000)::VARCHAR, 3, '0') AS srt,
 CASE WHEN s >= 3600 THEN (s // 3600)::VARCHAR || ':' || lpad((s // 60 % 60)::VARCHAR, 2, '0') ELSE (s // 60)::VARCHAR END || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS short, ms / 1000.0::DOUBLE AS parsed FROM m""")
def str21_timestamps(t: Tables):
    """Cue times, short times (str39) and their parser (str22)."""
    srt = times.srt_time(F.col("value"))
    return t.events.select("event_id", srt.alias("srt"), times.short_time(F.floor(F.col("value") * 97)).alias("short"), F.round(times.parse_time(srt), 3).alias("parsed"))


TODAY = "1998-06-30"


@query(f"""
SELECT o_orderkey, d AS day, CASE WHEN d > DATE '{TODAY}' THEN 'upcoming' WHEN DATE '{TODAY}' - d <= 30 AND o_orderstatus <> 'F' THEN 'recent' END AS status
FROM (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 10 > 0 THEN o_orderdate::DATE END AS d FROM orders)""")
def str24_date_status(t: Tables):
    """Dates kept as strings (str23), some in a form that is refused, and their status on a given day."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    written = F.when(F.col("o_orderkey") % 10 > 0, F.concat(day, F.lit("T00:00"))).otherwise(F.replace(day, F.lit("-"), F.lit("")))
    d = times.meeting_date(written)
    return t.orders.select("o_orderkey", d.alias("day"), times.date_status(d, F.col("o_orderstatus") == "F", F.lit(TODAY).cast("date")).alias("status"))


@query("SELECT o_orderkey, o_orderdate::DATE AS found FROM orders")
def str25_scan_date(t: Tables):
    """Dates written in three forms inside titles (str26)."""
    k, d = F.col("o_orderkey") % 3, F.col("o_orderdate")
    title = F.concat(F.lit("Council "), F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "M/d/yyyy")).otherwise(F.date_format(d, "MMMM d, yyyy")), F.lit(" part 2"))
    return t.orders.select("o_orderkey", times.scan_date(title).alias("found"))


@query("""
SELECT l_orderkey, l_linenumber, coalesce(l_shipdate::DATE - o_orderdate::DATE >= -1, true) AS plausible FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def str27_plausible_date(t: Tables):
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select("l_orderkey", "l_linenumber", times.plausible_upload(F.to_date("l_shipdate"), F.to_date("o_orderdate")).alias("plausible"))


@query("""
SELECT p_partkey, coalesce(CASE WHEN p_size > 40 THEN (p_size * 60 + 20) // 20 * 20 END, CASE WHEN p_retailprice >= 600 THEN floor(p_retailprice - 300) END, floor(p_retailprice / 2), 600)::BIGINT AS at FROM part""")
def str28_thumbnail_offset(t: Tables):
    chapter = F.when(F.col("p_size") > 40, F.col("p_size") * 60)
    return t.part.select("p_partkey", times.thumbnail_offset(F.col("p_retailprice"), chapter).alias("at"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'abcdefg' || lpad(page_id::VARCHAR, 4, '0') END AS video FROM pages")
def str29_video_id(t: Tables):
    vid = F.concat(F.lit("abcdefg"), F.lpad(F.col("page_id").cast("string"), 4, "0"))
    url = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("https://www.youtube.com/watch?t=1&v="), vid)).when(F.col("page_id") % 4 == 2, F.concat(F.lit("https://youtu.be/"), vid)).otherwise(F.col("url"))
    return t.pages.select("page_id", urls.video_id(url).alias("video"))


@query()
def str30_signed_token(t: Tables):
    """HMAC tokens of conversations; compared with Python's hmac in the tests."""
    return t.conversations.select("conv_id").distinct().select("conv_id", text.sign("key", F.col("conv_id").cast("string")).alias("token"))


@query("""
SELECT event_id, CASE WHEN s >= 3600 THEN (s // 3600)::VARCHAR || 'h ' || lpad((s // 60 % 60)::VARCHAR, 2, '0') || 'm' WHEN s >= 60 THEN (s // 60)::VARCHAR || 'm ' || lpad((s % 60)::VARCHAR, 2, '0') || 's' ELSE s::VARCHAR || 's' END AS duration,
 least(3600.0, 5.0 * power(2.0, user_id % 12))::DOUBLE AS delay FROM (SELECT event_id, user_id, floor(value * 100)::BIGINT AS s FROM events)""")
def str31_duration(t: Tables):
    """Readable durations and retry delays (str38)."""
    return t.events.select("event_id", times.human_duration(F.floor(F.col("value") * 100)).alias("duration"), times.backoff(F.col("user_id") % 12, 5.0, 3600.0).alias("delay"))


_ESC = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query(f"SELECT page_id, regexp_replace({_ESC.format('$$see <$$ || url || $$> now$$')}, '(https?://[^\\s<]+)', '<a href=\"\\1\">\\1</a>', 'g') AS html FROM pages")
def str32_linkify(t: Tables):
    return t.pages.select("page_id", text.linkify(F.concat(F.lit("see <"), F.col("url"), F.lit("> now"))).alias("html"))


@query("""
SELECT item_id, CASE WHEN length(text) > 300 - length(link) - 1 THEN rtrim(left(text, 300 - length(link) - 2)) || '…' ELSE text END || ' ' || link AS post FROM (SELECT item_id, text, 'https://example.org/m/' || item_id AS link FROM benchmark)""")
def str33_fit_post(t: Tables):
    """A post within 300 characters with its deep link (str35)."""
    link = F.concat(F.lit("https://example.org/m/"), F.col("item_id"))
    return t.benchmark.select("item_id", text.fit(F.col("text"), link).alias("post"))


@query("SELECT CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' WHEN 'es' THEN 'Spanish' ELSE lang END AS language, count(*) AS n FROM documents GROUP BY 1")
def str34_language_name(t: Tables):
    return t.documents.groupBy(text.language_name(F.col("lang")).alias("language")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN regexp_matches(regexp_replace(url, '[?#].*$', ''), '\\.html?$') THEN 'page' ELSE 'other' END AS kind, count(*) AS n FROM pages GROUP BY 1")
def str36_media_kind(t: Tables):
    return t.pages.groupBy(urls.media_kind(F.col("url")).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, right(array_to_string(list_filter(string_split(text, chr(10)), lambda s: NOT regexp_matches(s, '^[A-M]')), chr(10)), 200) AS tail FROM documents")
def str40_tail(t: Tables):
    return t.documents.select("doc_id", text.tail(F.col("text"), "^[A-M]", 200).alias("tail"))


@query("SELECT user_id, user_id % 4 IN (0, 1) AS blocked FROM (SELECT DISTINCT user_id FROM events)")
def flt22_blocked_address(t: Tables):
    u = F.col("user_id")
    ip = F.concat(F.when(u % 4 == 0, "10.0.").when(u % 4 == 1, "172.31.").when(u % 4 == 2, "172.32.").otherwise("8.8."), u % 256, F.lit(".7"))
    return t.events.select("user_id").distinct().select("user_id", urls.blocked_address(ip).alias("blocked"))


@query("SELECT s_suppkey FROM supplier WHERE s_name LIKE '%1' OR s_name LIKE '%tx'")
def str9_term_expansion(t: Tables):
    """A state's name also searches its abbreviation."""
    terms = ["1", names.STATES["texas"].lower()]
    hit = F.lit(False)
    for term in terms:
        hit = hit | F.endswith(F.lower("s_name"), F.lit(term))
    return t.supplier.where(hit).select("s_suppkey")
