from pyspark.sql import functions as F

from minutespark.sources import feeds


def test_feeds(spark):
    rows = [
        (1, '<rss><channel><item><guid isPermaLink="false">a</guid><title>A &amp; b</title></item><item><guid>b</guid><title><![CDATA[<B>]]></title><link>/b</link></item></channel></rss>'),
        (2, '<x:rss xmlns:x="urn:x"><x:channel><x:item><x:guid>b</x:guid><x:title>P</x:title></x:item></x:channel></x:rss>'),
        (3, "<rss><channel><item><guid>b</guid><title>cut"),
        (4, "<rss><item><guid>b</guid><title>first</title></item><item><guid>b</guid><title>second</title></item></rss>"),
        (5, None),
        (6, ""),
        (7, "<rss><channel></channel></rss>"),
    ]
    found = spark.createDataFrame(rows, "k long, xml string")
    assert {r["k"]: (r["title"], r["link"]) for r in feeds.item_by_id(found, "k", "xml", F.lit("b")).collect()} == {1: ("<B>", "/b"), 2: ("P", None), 4: ("first", None)}
    assert {r[0]: r[1] for r in found.select("k", F.size(feeds.feed_items(F.col("xml")))).collect()} == {1: 2, 2: 1, 3: 0, 4: 2, 5: 0, 6: 0, 7: 0}
