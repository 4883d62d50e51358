"""Extraction from raw pages by regular expressions."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from minutespark.functions.urls import host, platform

# Endings of media and caption files, words of addresses that are no content, and where media links stand.
MEDIA_ENDINGS = "mp4 mp3 wav webm ogg".split()
CAPTION_ENDINGS = "vtt srt ttml dfxp itt scc stl sbv sub smi sami".split()
NO_CONTENT = "placeholder logo icon".split()
_MEDIA, _ANY = "|".join(MEDIA_ENDINGS + CAPTION_ENDINGS), "|".join([*MEDIA_ENDINGS, "m3u8", *CAPTION_ENDINGS])
_IN_URL = r"""[^"'\s<>\\]"""
MEDIA = {
    "stream": rf"(https?://{_IN_URL}+\.m3u8{_IN_URL}*)",
    "file": rf"(https?://{_IN_URL}+\.(?:{_MEDIA}){_IN_URL}*)",
    "attribute": rf"""(?:data-)?src=["']([^"']+\.(?:{_ANY})(?:\?[^"']*)?)["']""",
    "player": rf"""["']?file["']?\s*:\s*["']([^"']+\.(?:{_ANY})(?:\?[^"']*)?)["']""",
    "caption text": rf"(https?://{_IN_URL}*(?:caption|subtitle|transcript|/cc[_./-]){_IN_URL}*\.(?:xml|txt){_IN_URL}*)",
}
LINK = r"""(?i)<(?:a|iframe|video|source|script|img|link)\b[^>]*?\b(?:href|src)\s*=\s*["']([^"']+)["']"""


def unescape(text: Column) -> Column:
    for entity, raw in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(raw))
    return text


@F.pandas_udf(T.ArrayType(T.StringType()))
def absolute(base: pd.Series, links: pd.Series) -> pd.Series:
    """Links resolved against their page's address."""
    from urllib.parse import urljoin

    return pd.Series([[urljoin(b or "", x) for x in (xs if xs is not None else [])] for b, xs in zip(base, links, strict=True)])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _media(pages: pd.Series, bases: pd.Series) -> pd.Series:
    """Media links by where they begin in the page, slashes of scripts' strings taken as plain ones."""
    from html import unescape as decoded
    from urllib.parse import urljoin

    kinds = [re.compile(p, re.IGNORECASE) for p in MEDIA.values()]
    blocked = re.compile(rf"(?<![^/_.-])(?:{'|'.join(NO_CONTENT)})(?![^/_.-])", re.IGNORECASE)
    out = []
    for page, base in zip(pages, bases, strict=True):
        page = (page or "").replace("\\/", "/")
        urls = {}
        for _, raw in sorted(((m.start(), m[1]) for kind in kinds for m in kind.finditer(page)), key=lambda x: x[0]):
            url = re.match(rf"{_IN_URL}*", decoded(raw))[0]
            if url and not blocked.search(url):
                urls.setdefault(urljoin(base or "", url))
        out.append(list(urls))
    return pd.Series(out)


def media_urls(html: Column, base: Column) -> Column:
    """Distinct links to media and captions in document order, absolute: bare addresses, sources, players' file keys; without logos and the like."""
    return _media(html, base)


def links(html: Column) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit(LINK), F.lit(1)), unescape)


def first_platform_link(pages: DataFrame, key: str, own: Column) -> DataFrame:
    """(key, link, platform): the first link of a page to a known platform other than its own."""
    rows = pages.select(key, own.alias("own"), F.posexplode(links(F.col("html"))).alias("pos", "link"))
    rows = rows.withColumn("platform", platform(F.col("link"))).where((F.col("platform") != "unknown") & (F.col("platform") != F.col("own")))
    best = rows.groupBy(key).agg(F.min(F.struct("pos", "link", "platform")).alias("b"))
    return best.select(key, "b.link", "b.platform")


def single_video_id(html: Column) -> Column:
    """An eleven-character id by tiers: embed, watch link, short link, structured data, bare mention; the last
    counts only if the page has exactly one."""
    tiers = [r"youtube(?:-nocookie)?\.com/embed/([A-Za-z0-9_-]{11})", r"youtube\.com/watch\?(?:[^\"'\s]*&)?v=([A-Za-z0-9_-]{11})", r"youtu\.be/([A-Za-z0-9_-]{11})", r'"videoId"\s*:\s*"([A-Za-z0-9_-]{11})"']
    found = [F.nullif(F.regexp_extract(html, p, 1), F.lit("")) for p in tiers]
    bare = F.array_distinct(F.regexp_extract_all(html, F.lit(r"\bvideo[-_]?id[=:]\s*[\"']?([A-Za-z0-9_-]{11})\b"), F.lit(1)))
    return F.coalesce(*found, F.when(F.size(bare) == 1, F.get(bare, F.lit(0))))


def visible_text(html: Column) -> Column:
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(bare, r"(?s)<[^>]*>", " ")), r"\s+", " "))


def is_empty_shell(html: Column, most: int = 500) -> Column:
    return F.length(visible_text(html)) <= most


#: What the body of a bot block says, and the most bytes of such a body (a long page may say it in prose).
CHALLENGE, CHALLENGE_BYTES = ["errors.edgesuite.net", "access denied", "just a moment"], 2048


def is_challenge(html: Column) -> Column:
    says = F.lit(False)
    for marker in CHALLENGE:
        says = says | F.contains(F.lower(html), F.lit(marker))
    return (F.length(html) <= CHALLENGE_BYTES) & says


def title(html: Column) -> Column:
    return F.trim(unescape(F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1)))


def caption_candidates(html: Column, most: int = 3) -> Column:
    """Caption files by confidence: track elements, then caption-like names, then any caption file."""
    tiers = [r"""(?i)<track\b[^>]*\bsrc=["']([^"']+)["']""", r"""(?i)["']([^"']*caption[^"']*\.(?:vtt|srt))["']""", r"""(?i)["']([^"']+\.(?:vtt|srt|ttml|dfxp))["']"""]
    return F.slice(F.array_distinct(F.concat(*(F.regexp_extract_all(html, F.lit(p), F.lit(1)) for p in tiers))), 1, most)


def best_video(urls: Column) -> Column:
    """A stream before a file; null without either."""
    pick = [F.get(F.filter(urls, lambda u: F.lower(u).rlike(p)), F.lit(0)) for p in (r"\.m3u8", r"\.mp4")]  # noqa: B023
    return F.coalesce(*pick)


def embedded_json(html: Column, variable: str) -> Column:
    """The first object assigned to a script variable, as its text; null without. Its end is found by reading it, so braces in strings, escapes
    and nested objects are no matter; what is no valid JSON is passed over."""
    start = re.compile(rf"(?<!\w){re.escape(variable)}\s*=\s*(?=\{{)")

    @F.pandas_udf(T.StringType())
    def objects(pages: pd.Series) -> pd.Series:
        reader = json.JSONDecoder()
        out = []
        for page in pages:
            found = None
            for m in start.finditer(page or ""):
                try:
                    found = page[m.end() : reader.raw_decode(page, m.end())[1]]
                    break
                except (ValueError, RecursionError):
                    continue
            out.append(found)
        return pd.Series(out, dtype=object)

    return objects(html)


def find_value(text: Column, key: str) -> Column:
    """What the first object that has a scalar under ``key`` has there, in document order at any depth (an object before those in it), as text; numbers
    as they are written. Null without one, or for no valid JSON."""

    @F.pandas_udf(T.StringType())
    def values(texts: pd.Series) -> pd.Series:
        return pd.Series([_first_value(x, key) for x in texts], dtype=object)

    return values(text)


def _first_value(text: str | None, key: str) -> str | None:
    try:
        ahead = [json.loads(text or "", parse_int=str, parse_float=str)]
    except (ValueError, RecursionError):
        return None
    while ahead:
        value = ahead.pop()
        if isinstance(value, dict):
            held = value.get(key)
            if isinstance(held, (str, bool)):
                return held if isinstance(held, str) else str(held).lower()
            ahead += reversed(value.values())
        elif isinstance(value, list):
            ahead += reversed(value)
    return None


def page_host(pages: DataFrame) -> DataFrame:
    return pages.withColumn("host", host(F.col("url")))
