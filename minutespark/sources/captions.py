"""Caption files as segments, and back. Readers take a frame with one file per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from minutespark.functions import times

CUE = r"((?:\d+:)?\d{1,2}:\d{2}[.,]\d{3})\s*-->\s*((?:\d+:)?\d{1,2}:\d{2}[.,]\d{3})"


def _cues(files: DataFrame, body: str) -> DataFrame:
    """Blocks between blank lines that hold a time line; (..., pos, start, end, text)."""
    clean = F.regexp_replace(F.regexp_replace(F.col(body), "\r\n?", "\n"), "^﻿", "")
    blocks = F.filter(F.split(clean, r"\n[ \t]*\n"), lambda b: b.rlike(CUE))
    rows = files.select(*(c for c in files.columns if c != body), F.posexplode(blocks).alias("pos", "_b"))
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace("_b", r"(?s)^.*?-->[^\n]*\n?", ""), "<[^>]*>", ""), r"^\s+|\s+$", "")
    out = rows.withColumn("start", times.parse_time(F.regexp_extract("_b", CUE, 1))).withColumn("end", times.parse_time(F.regexp_extract("_b", CUE, 2)))
    return out.withColumn("text", text).withColumn("pos", F.col("pos").cast("long")).drop("_b")


def parse_vtt(files: DataFrame, body: str) -> DataFrame:
    return _cues(files, body)


def parse_srt(files: DataFrame, body: str) -> DataFrame:
    return _cues(files, body)


def ttml_seconds(text: Column) -> Column:
    """'12.5s', '1500ms' or a clock time."""
    number = F.regexp_extract(text, r"^([\d.]+)", 1).try_cast("double")
    return F.when(text.rlike(r"^[\d.]+ms$"), number / 1000).when(text.rlike(r"^[\d.]+s$"), number).otherwise(times.parse_time(text))


def parse_ttml(files: DataFrame, body: str) -> DataFrame:
    """Paragraphs with begin and end in any namespace, in order; the text of nested elements is theirs, and line breaks become spaces. What is
    not well-formed XML, or null, has no cues; nor has a paragraph without text, or whose times are not understood."""
    read = F.from_xml(F.col(body), "bad string, none string", {"columnNameOfCorruptRecord": "bad", "mode": "PERMISSIVE"})
    bare = F.regexp_replace(F.col(body), "(?s)<!--.*?-->", "")
    marks = F.regexp_extract_all(bare, F.lit(r"(?s)<(?:[\w.-]+:)?p(?:\s[^>]*?)?(?:/>|>.*?</(?:[\w.-]+:)?p\s*>)"), F.lit(0))

    def cue(mark: Column) -> Column:
        opened = F.regexp_replace(F.regexp_extract(mark, r"^<(?:[\w.-]+:)?p((?:\s[^>]*?)?)/?>", 1), r"^", "<p ")
        times_ = F.from_xml(F.concat(opened, F.lit("/>")), "_begin string, _end string")
        spaced = F.regexp_replace(mark, r"<(?:[\w.-]+:)?br\b[^>]*>", " ")
        flat = F.regexp_replace(spaced, r"(<!\[CDATA\[(?s:.*?)\]\]>)|<[^>]*>", "$1")
        said = F.from_xml(F.concat(F.lit("<p>"), flat, F.lit("</p>")), "_VALUE string")["_VALUE"]
        return F.struct(ttml_seconds(times_["_begin"]).alias("start"), ttml_seconds(times_["_end"]).alias("end"), F.trim(F.regexp_replace(said, r"\s+", " ")).alias("text"))

    cues = F.filter(F.transform(F.when(read["bad"].isNull(), marks), cue), lambda c: c["start"].isNotNull() & c["end"].isNotNull() & (c["text"] != ""))
    rows = files.select(*(c for c in files.columns if c != body), F.posexplode(cues).alias("pos", "_c"))
    return rows.select("*", "_c.start", "_c.end", "_c.text").withColumn("pos", F.col("pos").cast("long")).drop("_c")


def plain_lines(body: Column) -> Column:
    """Non-blank lines of an unknown caption file without markup."""
    bare = F.regexp_replace(F.regexp_replace(body, "<[^>]*>", " "), "&[a-z]+;", " ")
    return F.filter(F.split(bare, "\n"), lambda s: F.trim(s) != "")


def untimed(files: DataFrame, body: str) -> DataFrame:
    """One segment at time 0 for each non-blank line."""
    lines = F.filter(F.split(F.col(body), "\n"), lambda s: F.trim(s) != "")
    rows = files.select(*(c for c in files.columns if c != body), F.posexplode(lines).alias("pos", "text"))
    return rows.withColumn("start", F.lit(0.0)).withColumn("end", F.lit(0.0))


def format_of(url: Column) -> Column:
    """Format by the extension of the path."""
    path = F.lower(F.regexp_replace(url, "[?#].*$", ""))
    ext = F.substring_index(path, ".", -1)
    return F.when(ext == "vtt", "vtt").when(ext == "srt", "srt").when(ext.isin("ttml", "dfxp", "itt", "xml"), "ttml").otherwise("unknown")


def decode_bytes(raw: Column) -> Column:
    """UTF-8, else Windows-1252 (Latin-1 but for the bytes 80 to 9F, which are translated)."""
    differ = [b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
    latin = F.decode(raw, "iso-8859-1")
    western = F.translate(latin, "".join(map(chr, differ)), bytes(differ).decode("cp1252"))
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(western)


def to_srt(files: DataFrame, segments: str, body: str) -> DataFrame:
    cue = F.transform(segments, lambda s, i: F.concat((i + 1).cast("string"), F.lit("\n"), times.srt_time(s["start"]), F.lit(" --> "), times.srt_time(s["end"]), F.lit("\n"), s["text"], F.lit("\n")))
    return files.withColumn(body, F.array_join(cue, "\n"))


def to_txt(files: DataFrame, segments: str, body: str) -> DataFrame:
    line = F.transform(segments, lambda s: F.concat(F.lit("["), times.short_time(s["start"]), F.lit("] "), s["text"]))
    return files.withColumn(body, F.array_join(line, "\n"))


def parse_lines(files: DataFrame, key: str, body: str) -> DataFrame:
    """'[h:mm:ss] text' lines; a cue ends where the next begins, the last where it starts."""
    lines = F.filter(F.split(F.col(body), "\n"), lambda s: s.rlike(r"^\[[\d:]+\] "))
    rows = files.select(key, F.posexplode(lines).alias("pos", "_l"))
    start = times.parse_time(F.regexp_extract("_l", r"^\[([\d:]+)\]", 1))
    rows = rows.select(key, F.col("pos").cast("long").alias("pos"), start.alias("start"), F.regexp_extract("_l", r"^\[[\d:]+\] (.*)$", 1).alias("text"))
    w = Window.partitionBy(key).orderBy("pos")
    return rows.withColumn("end", F.greatest(F.coalesce(F.lead("start").over(w), F.col("start")), F.col("start")))
