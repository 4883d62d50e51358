"""Small text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display names of languages.
LANGUAGES = {"en": "English", "de": "German", "fr": "French", "es": "Spanish"}


def hmac_sha256(key: str, message: Column) -> Column:
    """Hexadecimal HMAC-SHA256, composed from SHA-256 over padded keys."""
    import hashlib

    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ x for b in raw).hex())) for x in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))
    return F.sha2(F.concat(outer, first), 256)


def sign(key: str, message: Column) -> Column:
    return F.left(hmac_sha256(key, message), F.lit(32))


def fit(text: Column, link: Column, most: int = 300) -> Column:
    """Text and link within ``most`` characters; a cut text ends in an ellipsis."""
    room = F.lit(most) - F.length(link) - 1
    return F.concat_ws(" ", F.when(F.length(text) > room, F.concat(F.rtrim(F.left(text, room - 1)), F.lit("…"))).otherwise(text), link)


def linkify(text: Column) -> Column:
    """HTML-escaped, with http links made anchors."""
    from minutespark.operators.search import escape_html

    return F.regexp_replace(escape_html(text), r"(https?://[^\s<]+)", '<a href="$1">$1</a>')


def tail(text: Column, drop: str, most: int) -> Column:
    """The last ``most`` characters without the lines that match ``drop``."""
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda s: ~s.rlike(drop)), "\n")
    return F.right(kept, F.lit(most))


def language_name(code: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.coalesce(F.try_element_at(table, code), code)


def reason_bucket(message: Column, markers: list[tuple[str, str]]) -> Column:
    """Label of the first marker found; else 'http_<code>', else 'other'."""
    low = F.lower(message)
    code = F.regexp_extract(low, r"\b([45]\d\d)\b", 1)
    out = F.when(code != "", F.concat(F.lit("http_"), code)).otherwise("other")
    for marker, label in reversed(markers):
        out = F.when(F.contains(low, F.lit(marker)), label).otherwise(out)
    return out


def zip_addresses(text: Column) -> Column:
    """All 'ST 12345' endings of addresses."""
    return F.regexp_extract_all(text, F.lit(r"\b([A-Z]{2} \d{5})\b"), F.lit(1))
