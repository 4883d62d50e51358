import json
import random

from pyspark.sql import functions as F

from minutespark.operators import html as h


def one(spark, build, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(build(*map(F.col, names))).first()[0]


def test_media_links(spark):
    page = """<a href="/x.mp4">no source</a> <img src="/img/logo.mp4"> <video data-src='v/silicon.mp4?x=1&amp;y=2'> {"file":"//h.org/b.srt"}
    https://h.org/a.m3u8?t=1&amp;u=2 https:\\/\\/h.org\\/c.itt <source src="https://h.org/a.m3u8?t=1&u=2"> https://h.org/notes.txt https://h.org/cc/en.xml HTTPS://H.ORG/UP.MP3"""
    expected = ["https://s.org/p/v/silicon.mp4?x=1&y=2", "https://h.org/b.srt", "https://h.org/a.m3u8?t=1&u=2", "https://h.org/c.itt", "https://h.org/cc/en.xml", "HTTPS://H.ORG/UP.MP3"]
    assert [u.lower() for u in one(spark, h.media_urls, page, "https://s.org/p/q.html")] == [u.lower() for u in expected]
    assert one(spark, h.media_urls, None, None) == [] and one(spark, h.media_urls, "", "https://s.org") == []


def test_embedded_objects(spark):
    def read(page, key="show"):
        return one(spark, lambda c: h.find_value(h.embedded_json(c, "ctx"), key), page)

    assert read('x ctx = {"t": "a};b", "show": 7}; y') == "7"
    assert read('ctx={"q": "\\"z\\"", "show": "q\\"z"}', "show") == 'q"z'
    assert read('ctx = {bad}; ctx = {"show": 1.50}') == "1.50"
    assert read('other_ctx = {"show": 1}') is None and read("ctx = {") is None and read("") is None and read(None) is None
    assert read('ctx = {"a": {"show": [1]}, "b": [{"show": true}], "c": {"show": 2}};') == "true"
    assert read('ctx = {"a": {"b": {"show": 1}}, "show": 2}') == "2"  # an object before those in it
    assert read("ctx = " + '{"a":' * 400 + '{"show": 3}' + "}" * 400) == "3"


def test_objects_of_any_shape(spark):
    rng = random.Random(1)

    def some(depth):
        kind = rng.randrange(5 if depth else 3)
        if kind < 3:
            return ["};{", 'a"b', rng.randrange(9)][kind]
        return {rng.choice(["a", "b{", 'c"']): some(depth - 1) for _ in range(3)} if kind == 3 else [some(depth - 1) for _ in range(2)]

    made = [json.dumps({"x": some(4)}) for _ in range(60)]
    rows = spark.createDataFrame([(f"<script>var v = {m}; more();</script>", m) for m in made], "page string, m string")
    assert all(r[0] == r[1] for r in rows.select(h.embedded_json(F.col("page"), "v"), "m").collect())


def test_empty_shells(spark):
    assert one(spark, h.is_empty_shell, "<p>" + "x" * 500 + "</p><script>" + "y" * 900 + "</script>") is True
    assert one(spark, h.is_empty_shell, "<p>" + "x" * 501 + "</p>") is False
