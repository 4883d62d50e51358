import datetime as dt
import hmac

import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from minutespark.functions import names, text, times, urls
from minutespark.sources import tables


def one(spark, build, *values):
    kinds = {str: "string", float: "double", int: "long", bool: "boolean", type(None): "string", dt.date: "date"}
    schema = ", ".join(f"c{i} {kinds[type(v)]}" for i, v in enumerate(values))
    return spark.createDataFrame([values], schema).select(build(*(F.col(f"c{i}") for i in range(len(values))))).first()[0]


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        ("HTTPS://Ex.ORG:443/A/?b=2&a=1&a=0#x", "https://ex.org/A?a=0&a=1&b=2"),
        (" http://ex.org:80/ ", "http://ex.org/"),
        ("http://ex.org:8080/a//", "http://ex.org:8080/a/"),
        ("http://ex.org/p?Q=B&blank", "http://ex.org/p?Q=B&blank="),
    ],
)
def test_normalize_url(spark, url, expected):
    assert one(spark, urls.normalize, url) == expected


def test_hosts_and_addresses(spark):
    assert one(spark, urls.host, "no address") == "(unparseable)"
    assert one(spark, lambda c: urls.host(F.lit(None).cast("string")), "x") == "(none)"
    assert one(spark, urls.platform, "https://city.granicus.com/player/1") == "granicus"
    for ip, blocked in (("10.1.2.3", True), ("172.31.0.1", True), ("172.32.0.1", False), ("8.8.8.8", False), ("224.0.0.1", True), ("bad", True), ("169.254.1.1", True)):
        assert one(spark, urls.blocked_address, ip) is blocked


@settings(max_examples=20, deadline=None)
@given(hs.lists(hs.text(max_size=30), min_size=1, max_size=20))
def test_slugs_are_idempotent(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string").select(names.slug(F.col("v")).alias("s"))
    for r in df.select("s", names.slug(F.col("s")).alias("again")).collect():
        assert r["s"] == r["again"]


def test_names(spark):
    assert one(spark, names.state_suffix, "Austin, Texas") == "TX"
    assert one(spark, names.state_suffix, "Austin, TX") == "TX"
    assert one(spark, names.state_suffix, "Austin") is None
    assert one(spark, names.display, "The City of Austin") == "Austin"
    assert one(spark, names.display, "City and County of Denver") == "City and County of Denver"
    assert one(spark, names.normalize, "St. Paul Twp.") == "saint paul township"


def test_times(spark):
    assert one(spark, times.srt_time, 3661.0005) == "01:01:01,000"
    assert one(spark, times.short_time, 3661.0) == "1:01:01"
    assert one(spark, times.short_time, 59.9) == "0:59"
    assert one(spark, times.parse_time, "1:02:03,5") == 3723.5
    assert one(spark, times.parse_time, "x") is None
    assert one(spark, times.meeting_date, "2026-01-05T10:00") == dt.date(2026, 1, 5)
    assert one(spark, times.meeting_date, "2026-1-5") is None
    assert one(spark, times.meeting_date, "2026-02-30") is None
    day = dt.date(2026, 1, 31)
    assert one(spark, lambda d: times.date_status(d, F.lit(False), F.lit(day)), dt.date(2026, 2, 1)) == "upcoming"
    assert one(spark, lambda d: times.date_status(d, F.lit(False), F.lit(day)), dt.date(2026, 1, 1)) == "recent"
    assert one(spark, lambda d: times.date_status(d, F.lit(True), F.lit(day)), dt.date(2026, 1, 1)) is None


@settings(max_examples=20, deadline=None)
@given(hs.text(min_size=0, max_size=80).filter(lambda k: "\0" not in k), hs.lists(hs.text(max_size=60), min_size=1, max_size=8))
def test_hmac_against_the_library(spark, key, messages):
    df = spark.createDataFrame([(m,) for m in messages], "m string").select("m", text.hmac_sha256(key, F.col("m")).alias("h"))
    for r in df.collect():
        assert r["h"] == hmac.new(key.encode(), r["m"].encode(), "sha256").hexdigest()


def test_line_files(spark, tmp_path):
    (tmp_path / "urls").write_text("# list\nhttps://a\n\n https://list \n")
    lists = spark.createDataFrame([("https://list", ["https://b", "https://c"])], "url string, entries array<string>")
    got = tables.expand(tables.url_list(spark, str(tmp_path / "urls")), lists)
    assert {r["url"] for r in got.collect()} == {"https://a", "https://b", "https://c"}
    (tmp_path / "ledger").write_text("2024-01-02\tx1\nx2\n")
    assert {tuple(r) for r in tables.ledger(spark, str(tmp_path / "ledger")).collect()} == {(dt.date(2024, 1, 2), "x1"), (None, "x2")}
    (tmp_path / "places").write_text("name,state\nSpring,TX\nspring ,OH\nAustin,TX\n")
    assert {(r["name"], tuple(r["states"])) for r in tables.gazetteer(spark, str(tmp_path / "places")).collect()} == {("spring", ("OH", "TX")), ("austin", ("TX",))}
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    assert tables.replace(spark.read.parquet(path).where("id > 0"), path).count() == 2
