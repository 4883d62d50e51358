"""Feeds by Spark's XML functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ITEM = "array<struct<guid string, title string, link string>>"


def feed_items(xml: Column) -> Column:
    """The items (guid, title, link) of a feed in document order, whether in a channel or not. Prefixes of names do not count; an attribute
    on a guid is ignored. A feed that is no XML, or null, has none."""
    kind = f"channel struct<item {_ITEM.replace('guid string', 'guid struct<_VALUE string>')}>, item {_ITEM.replace('guid string', 'guid struct<_VALUE string>')}"
    read = F.from_xml(xml, kind, {"ignoreNamespace": "true", "mode": "PERMISSIVE"})
    none = F.array().cast(_ITEM)
    items = F.concat(*(F.coalesce(F.transform(part, lambda i: F.struct(i["guid"]["_VALUE"].alias("guid"), i["title"].alias("title"), i["link"].alias("link"))), none) for part in (read["channel"]["item"], read["item"])))
    return F.coalesce(items, none)


def item_by_id(feeds: DataFrame, key: str, xml: str, wanted: Column) -> DataFrame:
    """(key, title, link) of the first item whose guid is ``wanted``; feeds without it have no row."""
    hit = feeds.select(key, F.get(F.filter(feed_items(F.col(xml)), lambda i: i["guid"] == wanted), F.lit(0)).alias("hit"))
    return hit.where("hit is not null").select(key, "hit.title", "hit.link")
