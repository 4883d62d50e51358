"""Pages as rows of elements, read by a tolerant tag reader with a stack of open elements, and what is found by them."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minutespark.functions.urls import host
from minutespark.operators.html import absolute

# Elements without an end tag, and those whose content is no text of the page.
VOID = "area base br col embed hr img input link meta param source track wbr".split()
UNREAD = "script style template".split()
# What a link to a recording says, the known host of recordings, and hosts of frames that are page furniture.
VIDEO_SAYS = [
    r"watch(?:\s+(?:the\s+)?(?:video|meeting|recording|live\s*stream))?",
    r"(?:view|meeting|full)?\s*video(?:\s+recording)?",
    r"live\s*stream(?:/recording)?",
    r"recording",
]
KNOWN_VIDEO = r"""(?i)https?://(?:www\.)?vimeo\.com/(?:showcase/[^\s"'<>]+|\d+(?:/[0-9a-f]+)?(?:\?[^\s"'<>]*)?)"""
FURNITURE = [
    "googletagmanager.com",
    "google-analytics.com",
    "doubleclick.net",
    "recaptcha.net",
    "google.com/recaptcha",
    "facebook.com",
    "twitter.com",
    "platform.twitter.com",
    "youtube.com",
]
#: Elements that go out together.
OUT_ELEMENTS = 2000


class _Reader(HTMLParser):
    """Elements of the asked-for tags. An end tag closes the nearest open element of its name and all in it; one that closes nothing is passed over."""

    def __init__(self, tags: set[str]):
        super().__init__(convert_charrefs=True)
        self.tags, self.count = tags, 0
        self.open: list[tuple[str, int, dict | None]] = []
        self.depth: dict[str, int] = {}
        self.pieces: list[str] = []
        self.sizes = [0]
        self.done: list[dict] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        found = None
        if tag in self.tags:
            held: dict[str, str] = {}
            for name, value in attrs:
                held.setdefault(name, value or "")
            found = {"element": self.count, "parent": self.open[-1][1] if self.open else None, "tag": tag, "attrs": list(held.items()), "first": len(self.pieces), "stop": len(self.pieces)}
            self.done.append(found)
        if tag not in VOID:
            self.open.append((tag, self.count, found))
            self.depth[tag] = self.depth.get(tag, 0) + 1
        self.count += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID or not self.depth.get(tag):
            return
        closed = None
        while closed != tag:
            closed, _, found = self.open.pop()
            self.depth[closed] -= 1
            if found:
                found["stop"] = len(self.pieces)

    def handle_data(self, data: str) -> None:
        said = data.strip()
        if said and not any(self.depth.get(tag) for tag in UNREAD):
            self.pieces.append(said)
            self.sizes.append(self.sizes[-1] + len(said) + 1)

    def rows(self, page: str, longest: int) -> Iterator[tuple]:
        """(element, parent, tag, attrs, text) in document order."""
        self.feed(page)
        self.close()
        for _, _, found in self.open:
            if found:
                found["stop"] = len(self.pieces)
        for e in self.done:
            size = self.sizes[e["stop"]] - self.sizes[e["first"]] - 1
            text = " ".join(self.pieces[e["first"] : e["stop"]]) if size <= longest else None
            yield e["element"], e["parent"], e["tag"], e["attrs"], text


def elements(pages: DataFrame, key: str, html: str, tags: list[str], longest: int = 1000) -> DataFrame:
    """(key, element, parent, tag, attrs, text) for each element of ``tags``: its place in document order among all elements, the place of the
    one it lies in (null: none), its attributes (the first of each name, entities decoded) and its visible text, pieces joined by
    one space. A text of more than ``longest`` characters is null, so that broken markup, where everything nests, stays linear.
    An element that is never closed ends with what closes around it. A null page has no elements."""
    kind = pages.schema[key].dataType.simpleString()
    asked = set(tags)
    attrs = pa.map_(pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, types = [key, "element", "parent", "tag", "attrs", "text"], [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), attrs, pa.string()]

            def packed(out: list[tuple], names=names, types=types) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

            out: list[tuple] = []
            for i in range(batch.num_rows):
                own, page = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                for row in _Reader(asked).rows(page or "", longest):
                    out.append((own, *row))
                    if len(out) >= OUT_ELEMENTS:
                        yield packed(out)
                        out = []
            if out:
                yield packed(out)

    return pages.select(key, html).mapInArrow(run, f"`{key}` {kind}, element long, parent long, tag string, attrs map<string,string>, text string")


def video_pointers(pages: DataFrame, key: str, html: str = "html", url: str = "url") -> DataFrame:
    """(key, link, recognized): where a page's recording probably is. A link to a known host of recordings anywhere in the page is recognized;
    then comes the first anchor that says it is a video, then the first frame from another host that is no page furniture.
    Pages without any have no row; ``key`` is taken as unique."""
    known = pages.select(key, F.lit(0).alias("tier"), F.lit(0).cast("long").alias("element"), F.replace(F.regexp_extract(html, KNOWN_VIDEO, 0), F.lit("&amp;"), F.lit("&")).alias("raw"), F.col(url).alias("base"))
    found = elements(pages, key, html, ["a", "iframe"])
    raw = F.trim(F.coalesce(F.col("attrs")["href"], F.lit("")))
    says = F.col("text").rlike(rf"(?i)^(?:{'|'.join(VIDEO_SAYS)})\Z") & (raw != "") & ~raw.startswith("#") & ~F.lower(raw).startswith("javascript:")
    source = F.trim(F.coalesce(F.col("attrs")["src"], F.lit("")))
    anchor, frame = (F.col("tag") == "a") & says, (F.col("tag") == "iframe") & source.rlike(r"(?i)^(?:https?:)?//")
    marked = found.select(key, "element", F.when(anchor, 1).when(frame, 2).alias("tier"), F.when(anchor, raw).otherwise(source).alias("raw")).where("tier is not null")
    marked = marked.join(pages.select(key, F.col(url).alias("base")), key)
    rows = known.where("raw <> ''").unionByName(marked).withColumn("link", F.when(F.col("tier") == 0, F.col("raw")).otherwise(F.get(absolute(F.col("base"), F.array("raw")), F.lit(0))))
    there = host(F.col("link"))
    outside = (there != "(unparseable)") & (there != host(F.col("base"))) & ~F.lower("link").rlike("|".join(f.replace(".", r"\.") for f in FURNITURE))
    best = rows.where((F.col("tier") < 2) | F.coalesce(outside, F.lit(False))).groupBy(key).agg(F.min(F.struct("tier", "element", "link")).alias("b"))
    return best.select(key, "b.link", (F.col("b.tier") == 0).alias("recognized"))


def agenda_links(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, link): the address of the first anchor whose visible text or address says agenda; pages without one have no row."""
    href = F.col("attrs")["href"]
    says = F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lit("agenda")) | F.contains(F.lower(href), F.lit("agenda"))
    anchors = elements(pages, key, html, ["a"]).where((href != "") & says)
    return anchors.groupBy(key).agg(F.min(F.struct("element", href.alias("link"))).alias("b")).select(key, "b.link")


def chapters(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, chapters): seconds and label of elements with a time attribute, in document order, labels by all the text in them; pages without any have no row."""
    at = F.coalesce(F.col("attrs")["data-time"], F.col("attrs")["data-seconds"])
    timed = elements(pages, key, html, ["li", "a", "div"]).where(at.rlike("^[0-9]{1,9}$"))
    rows = timed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("element", at.cast("long").alias("seconds"), F.col("text").alias("label")))).alias("c"))
    return rows.select(key, F.transform("c", lambda x: F.struct(x["seconds"].alias("seconds"), x["label"].alias("label"))).alias("chapters"))
