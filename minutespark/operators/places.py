"""Whose page it is: names of places mined from a page's text, its markup and its address, each checked against a table of known places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minutespark.functions import names, urls

# What a name's bodies are called, and what may end in a full stop within a name.
BODIES = "City|County|Town"
WITHIN_NAMES = ["st", "ste", "ft", "mt", "pt", "n", "s", "e", "w"]
#: Labels of hosts that name no place, whatever the table holds.
GENERIC = ("www", "media", "video", "videos", "live", "meetings", "archive", "stream", "player", "agenda", "public")
TIERS = ("text", "markup", "host")


def _leading(words: Column, proper: Column, ends: Column, most: int) -> Column:
    """How many of the words make the name: those before the first that is not proper, up to the first that ends it."""
    other, last = F.array_position(proper, False), F.array_position(ends, True)
    return F.least(F.size(words), F.lit(most), F.when(other > 0, other - 1), F.when(last > 0, last)).cast("int")


def _named(body: Column, words: Column) -> Column:
    return F.when(F.size(words) > 0, F.struct(body.alias("body"), F.array_join(words, " ").alias("place")))


def from_text(text: Column) -> Column:
    """(body, place) of the first 'City of X' in running text: capitalised words, at most five within 120 characters, to the first comma,
    semicolon or colon, or full stop that ends no abbreviation. Null without one."""
    found = rf"(?s)\b({BODIES}) of\s+(.{{0,120}})"
    words = F.filter(F.split(F.regexp_extract(text, found, 2), r"(?U)\s+"), lambda w: w != "")
    core = lambda w: F.regexp_replace(w, "^[,;:]+|[,;:]+$", "")
    bare = lambda w: F.regexp_replace(core(w), r"\.+$", "")
    full_stop = lambda w: F.endswith(core(w), F.lit(".")) & ~F.lower(F.regexp_replace(core(w), r"\.$", "")).isin(WITHIN_NAMES) & (F.length(bare(w)) > 1)
    n = _leading(words, F.transform(words, lambda w: core(w).rlike(r"^\p{Lu}")), F.transform(words, lambda w: full_stop(w) | (core(w) != w)), 5)
    kept = F.transform(F.slice(words, 1, n), lambda w: F.when(full_stop(w), bare(w)).otherwise(core(w)))
    return _named(F.regexp_extract(text, found, 1), kept)


def from_markup(html: Column) -> Column:
    """(body, place) of the first 'city of x' in any case, outside scripts and styles, that ends at a tag, comma or full stop within 80
    characters: its capitalised words, at most four; words in capitals get one. Null without one."""
    found = rf"(?i)\b({BODIES}) of\s+([^<>]{{1,80}}?)(?=<|[,.])"
    seen = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1>", "")
    words = F.filter(F.split(F.regexp_extract(seen, found, 2), r"(?U)\s+"), lambda w: w != "")
    core = F.transform(words, lambda w: F.regexp_replace(w, "^[.,;:]+|[.,;:]+$", ""))
    n = _leading(core, F.transform(core, lambda w: w.rlike(r"^\p{Lu}")), F.transform(core, lambda w: F.lit(False)), 4)
    kept = F.transform(F.slice(core, 1, n), lambda w: F.when(F.upper(w) == w, F.initcap(F.lower(w))).otherwise(w))
    return _named(F.initcap(F.lower(F.regexp_extract(seen, found, 1))), kept)


def host_label(url: Column) -> Column:
    """The letters of a host's first label that is not 'www', without a leading 'city', 'county' or 'town' (with 'of') or digits; null if generic."""
    label = F.regexp_extract(F.lower(urls.host(url)), r"^(?:www\.)?([^.]+)\.", 1)
    letters = F.regexp_replace(F.regexp_replace(label, "[^a-z]", ""), "^(?:city|county|town)(?:of)?(?=...)", "")
    return F.when((letters != "") & ~label.isin(*GENERIC), letters)


def of_pages(pages: DataFrame, key: str, text: str, html: str, url: str, known: DataFrame, known_name: str) -> DataFrame:
    """(key, tier, body, place, confidence) for each page: the first of text, markup and host that gives a known place. ``place`` is the
    normalized known name; ``confidence`` is 'validated', or 'repaired' where words after it had to go (the longest known run of leading words
    holds); all null where no tier gives one. Where the host names a known place, a text that names another is not believed.
    ``key`` must be unique; null texts, and names the table has not got, give nothing. The table may be of any size."""
    places = known.select(names.normalize(F.col(known_name)).alias("place")).where("place <> ''").distinct()
    mined = pages.select(F.col(key).alias("_k"), F.array(from_text(F.col(text)), from_markup(F.col(html))).alias("_m"))
    mined = mined.select("_k", F.posexplode("_m").alias("tier", "m")).where("m is not null").select("_k", "tier", "m.body", names.normalize(F.col("m.place")).alias("said"))
    words = F.split("said", " ")
    cuts = mined.select("_k", "tier", "body", F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.struct(n.alias("n"), (n == F.size(words)).alias("whole"), F.array_join(F.slice(words, 1, n), " ").alias("place")))).alias("c"))
    held = cuts.select("_k", "tier", "body", "c.*").join(places, "place")
    by_text = held.groupBy("_k", "tier").agg(F.max_by(F.struct("body", "place", "whole"), "n").alias("b"))

    squeezed = places.groupBy(F.regexp_replace("place", "[^a-z]", "").alias("label")).agg(F.min("place").alias("hint"))
    hints = pages.select(F.col(key).alias("_k"), host_label(F.col(url)).alias("label")).join(squeezed, "label").select("_k", "hint")
    trusted = by_text.select("_k", "tier", "b.*").join(hints, "_k", "left").where("hint is null or hint = place")
    by_host = hints.select("_k", F.lit(2).alias("tier"), F.lit(None).cast("string").alias("body"), F.col("hint").alias("place"), F.lit(True).alias("whole"))
    every = trusted.select("_k", "tier", "body", "place", "whole").unionByName(by_host)
    first = every.groupBy("_k").agg(F.min_by(F.struct("tier", "body", "place", "whole"), "tier").alias("b"))
    tier = F.get(F.array(*map(F.lit, TIERS)), F.col("b.tier"))
    verdict = F.when(F.col("b.whole"), "validated").when(F.col("b").isNotNull(), "repaired")
    both = pages.select(key).join(first, F.col(key).eqNullSafe(F.col("_k")), "left")
    return both.select(key, tier.alias("tier"), F.col("b.body").alias("body"), F.col("b.place").alias("place"), verdict.alias("confidence"))
