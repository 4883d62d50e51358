"""URL functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordered rules of the source classifier, as (label, what, pattern).
PLATFORM_RULES = [
    ("youtube", "host", r"(^|\.)(youtube\.com|youtu\.be)$"), ("vimeo", "host", r"(^|\.)vimeo\.com$"),
    ("granicus", "host", r"\.granicus\.com$"), ("swagit", "host", r"\.swagit\.com$"), ("legistar", "host", r"\.legistar\.com$"),
    ("primegov", "host", r"\.primegov\.com$"), ("civicclerk", "host", r"\.civicclerk\.com$"), ("escribe", "host", r"escribemeetings\.com$"),
    ("civicweb", "host", r"\.civicweb\.net$"), ("iqm2", "host", r"\.iqm2\.com$"), ("telvue", "host", r"telvue\.com$"),
    ("civicplus", "path", r"(?i)^/AgendaCenter"), ("cablecast", "path", r"(?i)/CablecastPublicSite"), ("hyland", "path", r"(?i)/OnBaseAgendaOnline"),
    ("blog", "host", r"^blog\."), ("mobile", "host", r"^m\."), ("www", "host", r"^www\."), ("static", "path", r"\.html$"),
]


def host(url: Column) -> Column:
    """Lower-case host; '(none)' for null, '(unparseable)' where there is none."""
    found = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.when(url.isNull(), "(none)").otherwise(F.coalesce(found, F.lit("(unparseable)")))


def registered_domain(h: Column) -> Column:
    return F.substring_index(h, ".", -2)


def normalize(url: Column) -> Column:
    """Lower-case scheme and authority without default port, path without one closing slash, query
    pairs in order, no fragment. The case of path and parameters stays; nothing is dropped from the query."""
    whole = F.regexp_replace(F.trim(url), "#.*$", "")
    scheme = F.lower(F.regexp_extract(whole, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    authority = F.lower(F.regexp_extract(whole, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1))
    authority = F.when(scheme == "http", F.regexp_replace(authority, ":80$", "")).when(scheme == "https", F.regexp_replace(authority, ":443$", "")).otherwise(authority)
    rest = F.regexp_replace(whole, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", "")
    path = F.substring_index(rest, "?", 1)
    path = F.when((F.length(path) > 1) & F.endswith(path, F.lit("/")), F.left(path, F.length(path) - 1)).otherwise(path)
    query = F.when(F.contains(rest, F.lit("?")), F.substring(rest, F.instr(rest, "?") + 1, F.length(rest)))
    pairs = F.array_sort(F.filter(F.split(query, "&"), lambda p: p != ""))
    pairs = F.array_join(F.transform(pairs, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("=")))), "&")
    return F.concat(scheme, F.lit("://"), authority, path, F.when(F.length(pairs) > 0, F.concat(F.lit("?"), pairs)).otherwise(""))


def platform(url: Column) -> Column:
    """Label of the first rule that holds; 'unknown' without any."""
    parts = {"host": host(url), "path": F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))}
    out = F.lit("unknown")
    for label, what, pattern in reversed(PLATFORM_RULES):
        out = F.when(parts[what].rlike(pattern), label).otherwise(out)
    return out


def media_kind(url: Column) -> Column:
    path = F.lower(F.regexp_replace(url, "[?#].*$", ""))
    return F.when(path.rlike(r"\.m3u8$"), "hls").when(path.rlike(r"\.(mp4|mov|m4v|webm)$"), "video").when(path.rlike(r"\.(mp3|m4a|wav)$"), "audio").when(path.rlike(r"\.html?$"), "page").otherwise("other")


def video_id(url: Column) -> Column:
    """Eleven-character id of a YouTube link; null without."""
    found = F.regexp_extract(url, r"(?:youtube\.com/(?:watch\?(?:.*&)?v=|embed/|live/)|youtu\.be/)([A-Za-z0-9_-]{11})", 1)
    return F.when(found != "", found)


def blocked_address(ip: Column) -> Column:
    """Whether a dotted IPv4 address is private, loopback, link-local, multicast, reserved or unspecified;
    null is blocked. By numeric ranges."""
    octet = [F.split_part(ip, F.lit("."), F.lit(i + 1)).try_cast("long") for i in range(4)]
    number = ((octet[0] * 256 + octet[1]) * 256 + octet[2]) * 256 + octet[3]
    # The special-purpose ranges as (first, prefix length).
    special = [("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("224.0.0.0", 4), ("240.0.0.0", 4)]
    out = F.lit(False)
    for first, bits in special:
        a, b, c, d = map(int, first.split("."))
        low = ((a * 256 + b) * 256 + c) * 256 + d
        out = out | number.between(low, low + (1 << (32 - bits)) - 1)
    return F.coalesce(out, F.lit(True))
