"""Timestamps, dates, durations and schedules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pad(n: Column, width: int) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def srt_time(seconds: Column) -> Column:
    """hh:mm:ss,mmm, halves rounded to even."""
    ms = F.bround(seconds * 1000, 0).cast("long")
    return F.concat(_pad(F.floor(ms / 3600000), 2), F.lit(":"), _pad(F.floor(ms / 60000) % 60, 2), F.lit(":"), _pad(F.floor(ms / 1000) % 60, 2), F.lit(","), _pad(ms % 1000, 3))


def short_time(seconds: Column) -> Column:
    """h:mm:ss or m:ss; null counts as 0."""
    s = F.floor(F.coalesce(seconds, F.lit(0))).cast("long")
    minutes = F.floor(s / 60) % 60
    tail = F.concat(F.lit(":"), _pad(s % 60, 2))
    return F.when(s >= 3600, F.concat(F.floor(s / 3600).cast("string"), F.lit(":"), _pad(minutes, 2), tail)).otherwise(F.concat(minutes.cast("string"), tail))


def parse_time(text: Column) -> Column:
    """Seconds of [h:]m:s[.,]fff; null if it is none."""
    clean = F.replace(F.trim(text), F.lit(","), F.lit("."))
    ok = clean.rlike(r"^(\d+:)?\d{1,2}:\d{1,2}(\.\d+)?$")
    parts = F.reverse(F.split(clean, ":"))
    total = F.get(parts, F.lit(0)).try_cast("double") + F.get(parts, F.lit(1)).try_cast("double") * 60 + F.coalesce(F.get(parts, F.lit(2)).try_cast("double"), F.lit(0.0)) * 3600
    return F.when(ok, total)


def meeting_date(text: Column) -> Column:
    """A date from the first ten characters: YYYY-MM-DD only, other forms are null."""
    head = F.left(text, F.lit(10))
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), head.try_cast("date"))


def date_status(date: Column, has_transcript: Column, today: Column) -> Column:
    """'upcoming', 'recent' (up to 30 days old, without transcript) or null."""
    age = F.datediff(today, date)
    return F.when(age < 0, "upcoming").when((age <= 30) & ~has_transcript, "recent")


def scan_date(text: Column) -> Column:
    """The first date in any of the forms 2026-01-31, 1/31/2026, January 31, 2026."""
    iso = F.try_to_date(F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")
    us = F.try_to_date(F.regexp_extract(text, r"(\d{1,2}/\d{1,2}/\d{4})", 1), "M/d/yyyy")
    long = F.try_to_date(F.regexp_extract(text, r"((?:January|February|March|April|May|June|July|August|September|October|November|December) \d{1,2}, \d{4})", 1), "MMMM d, yyyy")
    return F.coalesce(iso, us, long)


def plausible_upload(uploaded: Column, met: Column) -> Column:
    """Not earlier than a day before the meeting; unknown dates pass."""
    return F.coalesce(F.datediff(uploaded, met) >= -1, F.lit(True))


def thumbnail_offset(seconds: Column, chapter: Column) -> Column:
    """Twenty seconds into the chapter, in steps of 20; else 300 before the end from 600 on, else the
    middle; 600 if nothing is known."""
    stepped = F.floor((chapter + 20) / 20) * 20
    return F.coalesce(stepped, F.when(seconds >= 600, F.floor(seconds - 300)), F.floor(seconds / 2), F.lit(600)).cast("long")


def human_duration(seconds: Column) -> Column:
    s = seconds.cast("long")
    hours = F.concat(F.floor(s / 3600).cast("string"), F.lit("h "), _pad(F.floor(s / 60) % 60, 2), F.lit("m"))
    return F.when(s >= 3600, hours).when(s >= 60, F.concat(F.floor(s / 60).cast("string"), F.lit("m "), _pad(s % 60, 2), F.lit("s"))).otherwise(F.concat(s.cast("string"), F.lit("s")))


def backoff(attempt: Column, base: float, most: float) -> Column:
    """min(most, base * 2**attempt), without jitter so that plans are repeatable."""
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), attempt))
