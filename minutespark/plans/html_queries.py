"""Extraction from pages. Where the given pages lack a feature it is added to them by an expression, so
that every page takes part."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from minutespark.functions.urls import platform
from minutespark.operators import elements as el
from minutespark.operators import html as h
from minutespark.plans.registry import Tables, query
from minutespark.sources import feeds


def with_extra(t: Tables, *parts):
    return t.pages.select("page_id", "url", F.concat("html", *parts).alias("html"))


def number():
    return F.col("page_id").cast("string")


@query("""
SELECT page_id, [site || '/v/' || page_id || '.mp4?a=1&b=2', 'https://cdn.example.org/' || page_id || '/live.m3u8?t=1&u=2', 'https://silicon.example.org/iconic.webm', 'https://cdn.example.org/js.mp4',
  site || '/tracks/' || page_id || '.SRT', 'https://cdn.example.org/captions/en.txt', regexp_extract(url, '^([a-z]+):', 1) || '://media.example.org/a.vtt'] AS urls
FROM (SELECT page_id, url, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS site FROM pages)""")
def htm1_media_scan(t: Tables):
    """Sources, bare addresses, escaped slashes, players' file keys and caption texts; logos and robots.txt are no media."""
    extra = F.concat(
        F.lit('<video src="/v/'), number(), F.lit('.mp4?a=1&amp;b=2"></video> see https://cdn.example.org/'), number(), F.lit("/live.m3u8?t=1&amp;u=2 <img src='/logo.mp4'>"),
        F.lit(' https://silicon.example.org/iconic.webm <script>{"u": "https:\\/\\/cdn.example.org\\/js.mp4", file: "/tracks/'), number(),
        F.lit('.SRT"}</script> https://cdn.example.org/robots.txt https://cdn.example.org/captions/en.txt <b data-src="//media.example.org/a.vtt"> https://cdn.example.org/js.mp4'),
    )
    return with_extra(t, extra).select("page_id", h.media_urls(F.col("html"), F.col("url")).alias("urls"))


@query("SELECT page_id, 'https://www.youtube.com/watch?v=abcdefg' || lpad(page_id::VARCHAR, 4, '0') AS link, 'youtube' AS platform FROM pages")
def htm2_platform_link(t: Tables):
    extra = F.concat(F.lit('<a href="https://www.youtube.com/watch?v=abcdefg'), F.lpad(number(), 4, "0"), F.lit('">watch</a>'))
    return h.first_platform_link(with_extra(t, extra), "page_id", platform(F.col("url")))


_LINKS = r"""regexp_extract_all(html, '(?i)<(?:a|iframe|video|source|script|img|link)\b[^>]*?\b(?:href|src)\s*=\s*["'']([^"'']+)["'']', 1)"""


@query(f"SELECT page_id, len({_LINKS}) AS links FROM pages")
def htm2_links(t: Tables):
    return t.pages.select("page_id", F.size(h.links(F.col("html"))).cast("long").alias("links"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'abcdefg' || lpad(page_id::VARCHAR, 4, '0') WHEN 1 THEN 'xbcdefg' || lpad(page_id::VARCHAR, 4, '0') END AS video FROM pages")
def htm3_single_video(t: Tables):
    n = F.lpad(number(), 4, "0")
    one = F.concat(F.lit('video_id="abcdefg'), n, F.lit('"'))
    extra = F.when(F.col("page_id") % 3 == 0, one).when(F.col("page_id") % 3 == 1, F.concat(one, F.lit("youtu.be/xbcdefg"), n)).otherwise(F.concat(one, F.lit(' video_id="ybcdefg'), n, F.lit('"')))
    return with_extra(t, extra).select("page_id", h.single_video_id(F.col("html")).alias("video"))


@query("""
SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://vimeo.com/' || page_id || '/ab?x=1&y=2' WHEN 1 THEN regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || '/meetings/' || page_id
  WHEN 2 THEN regexp_extract(url, '^([a-z]+):', 1) || '://player.example.com/e/' || page_id ELSE 'https://media.example.com/a&b' END AS link, page_id % 5 = 0 AS recognized
FROM pages WHERE page_id % 5 < 4""")
def htm4_video_pointer(t: Tables):
    """A known host, an anchor's visible text over nested markup, frames; every page has links that say something else."""
    n = number()
    furniture = F.lit('<iframe src="https://www.googletagmanager.com/ns.html"></iframe><iframe src="/own"></iframe><a href="#top">Video</a><a href="javascript:play()">Watch</a><a href="/v">Watch our budget</a>')
    known = F.concat(F.lit('<a href="/x">Video</a><p>https://vimeo.com/'), n, F.lit("/ab?x=1&amp;y=2</p>"))
    anchor = F.concat(F.lit('<iframe src="https://other.example.com/"></iframe><a class=x HREF=/meetings/'), n, F.lit("><b>Watch</b><script>no</script> <i>the<br>\nmeeting</a>"))
    frame = F.concat(F.lit('<iframe src="//player.example.com/e/'), n, F.lit('"></iframe><iframe src="https://other.example.com/">'))
    linked = F.lit('</div></b><a title="1" href="https://media.example.com/a&amp;b" href="/second"> Live&#32;Stream/Recording </a>')
    which = F.col("page_id") % 5
    extra = F.when(which == 0, known).when(which == 1, anchor).when(which == 2, frame).when(which == 3, linked).otherwise("<!-- <a href='/c'>Video</a> -->")
    return el.video_pointers(with_extra(t, furniture, extra), "page_id")


_ANCHOR = r"""'<a href="([^"]*)">([^<]*)</a>'"""


@query(f"SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS pos, href, said FROM (SELECT page_id, unnest(regexp_extract_all(html, {_ANCHOR}, 1)) AS href, trim(unnest(regexp_extract_all(html, {_ANCHOR}, 2))) AS said, generate_subscripts(regexp_extract_all(html, {_ANCHOR}, 1), 1) AS pos FROM pages)")
def htm12_anchor_texts(t: Tables):
    """Anchors with what they say, as elements of the page."""
    found = el.elements(t.pages, "page_id", "html", ["a"])
    pos = F.row_number().over(Window.partitionBy("page_id").orderBy("element")) - 1
    return found.select("page_id", pos.cast("long").alias("pos"), F.col("attrs")["href"].alias("href"), F.col("text").alias("said"))


@query("SELECT page_id, ['/t.vtt', '/my-captions.srt', '/o.ttml'] AS files FROM pages")
def htm5_caption_candidates(t: Tables):
    extra = F.lit('<a x="/o.ttml"><a x="/my-captions.srt"><track kind="x" src="/t.vtt"><a x="/p.vtt">')
    return with_extra(t, extra).select("page_id", h.caption_candidates(F.col("html")).alias("files"))


@query("SELECT page_id, '/docs/' || page_id AS link FROM pages")
def htm6_agenda_link(t: Tables):
    extra = F.concat(F.lit('<a href="/docs/'), number(), F.lit('">Full <b>Agenda</b></a>'))
    return el.agenda_links(with_extra(t, F.lit("<a href='/old'>Minutes <!-- agenda --></a>"), extra), "page_id")


@query("SELECT page_id, trim(replace(replace(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')) AS title FROM pages")
def htm7_metadata(t: Tables):
    return t.pages.select("page_id", h.title(F.col("html")).alias("title"))


@query("""
SELECT page_id, length(html) <= 2048 AND regexp_matches(lower(html), 'errors[.]edgesuite[.]net|access denied|just a moment') AS blocked FROM (
  SELECT page_id, CASE page_id % 3 WHEN 0 THEN html WHEN 1 THEN left(html, 900) || ' Access Denied' ELSE html || repeat(' ', 2048) || ' Just a moment, captcha' END AS html FROM pages)""")
def htm8_challenge(t: Tables):
    """The pages as they are, short bodies that say so, and long pages that do."""
    short, long_ = F.concat(F.left("html", F.lit(900)), F.lit(" Access Denied")), F.concat("html", F.repeat(F.lit(" "), F.lit(2048)), F.lit(" Just a moment, captcha"))
    body = F.when(F.col("page_id") % 3 == 0, F.col("html")).when(F.col("page_id") % 3 == 1, short).otherwise(long_)
    return t.pages.select("page_id", h.is_challenge(body).alias("blocked"))


_BARE = "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>', ' ', 'g'), '(?is)<style\\b.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
_TEXT = f"trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace({_BARE}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&#x27;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g'))"


@query(f"SELECT page_id, length({_TEXT}) <= 500 AS shell, length({_TEXT}) AS visible FROM pages")
def htm9_empty_shell(t: Tables):
    """Visible text and whether there is too little of it (htm10)."""
    text = h.visible_text(F.col("html"))
    return t.pages.select("page_id", h.is_empty_shell(F.col("html")).alias("shell"), F.length(text).cast("long").alias("visible"))


@query("SELECT page_id, [60, page_id + 60] AS seconds, 'Roll call' AS first_label FROM pages")
def htm11_chapters(t: Tables):
    extra = F.concat(F.lit('<li data-time="60"><b>Roll call</b></li><li class="x" data-seconds="'), (F.col("page_id") + 60).cast("string"), F.lit('">Budget</li>'))
    found = el.chapters(with_extra(t, extra), "page_id")
    return found.select("page_id", F.transform("chapters", lambda x: x["seconds"]).alias("seconds"), F.get("chapters", F.lit(0))["label"].alias("first_label"))


@query(f"SELECT page_id, replace(replace(unnest({_LINKS}), '&#x27;', ''''), '&amp;', '&') AS link, generate_subscripts({_LINKS}, 1) - 1 AS pos FROM pages")
def htm12_candidate_rows(t: Tables):
    rows = t.pages.select("page_id", F.posexplode(h.links(F.col("html"))).alias("pos", "link"))
    return rows.select("page_id", "link", F.col("pos").cast("long").alias("pos"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'b.m3u8' ELSE 'a.mp4' END AS best FROM pages")
def htm13_best_video(t: Tables):
    urls = F.when(F.col("page_id") % 2 == 0, F.array(F.lit("a.mp4"), F.lit("b.m3u8"))).otherwise(F.array(F.lit("x.html"), F.lit("a.mp4")))
    return t.pages.select("page_id", h.best_video(urls).alias("best"))


@query("SELECT page_id, page_id AS show FROM pages")
def src19_embedded_json(t: Tables):
    """An object inside a script, and in it the nearest object with a key (src20)."""
    extra = F.concat(F.lit('<script>settings = {not: "json"}; var settings = {"t": "a};b \\"show\\": 0", "a": [{"b": {"show": '), number(), F.lit("}}, {\"show\": -1}]};</script>"))
    return with_extra(t, extra).select("page_id", h.find_value(h.embedded_json(F.col("html"), "settings"), "show").cast("long").alias("show"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def src20_json_payload(t: Tables):
    return t.events.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT item_id, 'Title <' || item_id || '> & more' AS title, '/v/' || item_id AS link FROM benchmark WHERE item_id % 3 < 2")
def src21_feed_item(t: Tables):
    """An item of a feed found by its id; a third of the feeds are cut off, and some have prefixed names."""
    n = F.col("item_id").cast("string")
    item = F.concat(F.lit('<item><guid>x</guid><title>No</title></item><item><guid isPermaLink="false">'), n, F.lit("</guid><title>Title &lt;"), n, F.lit("&gt; &amp; more</title><link>/v/"), n, F.lit("</link></item>"))
    prefixed = F.regexp_replace(F.regexp_replace(item, "<(guid|title|link|item)", "<m:$1"), "</", "</m:")
    which = F.col("item_id") % 3
    feed = F.when(which == 0, F.concat(F.lit("<rss><channel>"), item, F.lit("</channel></rss>"))).when(which == 1, F.concat(F.lit('<rss xmlns:m="urn:m">'), prefixed, F.lit("</rss>"))).otherwise(F.concat(F.lit("<rss>"), item))
    return feeds.item_by_id(t.benchmark.select("item_id", feed.alias("feed")), "item_id", "feed", n)
