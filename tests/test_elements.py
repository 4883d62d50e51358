from pyspark.sql import functions as F

from minutespark.operators import elements as el


def read(spark, page, tags, **more):
    rows = el.elements(spark.createDataFrame([(1, page)], "k long, page string"), "k", "page", tags, **more).orderBy("element").collect()
    return [(r["element"], r["parent"], r["tag"], dict(r["attrs"]), r["text"]) for r in rows]


def test_nested_and_broken_markup(spark):
    page = "<div id=x>one <p>two<br>three</i></div> four <P CLASS='a&amp;b' class=no>five<script>if (a<b) '</p>'</script><!-- <p>no</p> --> &lt;six"
    assert read(spark, page, ["div", "p"]) == [(0, None, "div", {"id": "x"}, "one two three"), (1, 0, "p", {}, "two three"), (3, None, "p", {"class": "a&b"}, "five <six")]
    assert read(spark, "<ul><li>a<li>b</ul>c", ["li"]) == [(1, 0, "li", {}, "a b"), (2, 1, "li", {}, "b")]
    assert read(spark, "<a href>x</a></a><a", ["a"]) == [(0, None, "a", {"href": ""}, "x")]
    assert read(spark, "<img src=1><img src=2 />", ["img"]) == [(0, None, "img", {"src": "1"}, ""), (1, None, "img", {"src": "2"}, "")]
    assert read(spark, None, ["a"]) == [] and read(spark, "", ["a"]) == [] and read(spark, "no tags", ["a"]) == []


def test_unclosed_elements_stay_linear(spark):
    found = read(spark, "<a href=x>word " * 30_000, ["a"], longest=100)
    assert len(found) == 30_000 and found[0][4] is None and found[-1][4] == "word" and found[-2][1] == 29_997


def test_pointers(spark):
    expected = [("<a href=/a>Video</a> HTTPS://www.vimeo.com/showcase/9?a=1&amp;b", ("HTTPS://www.vimeo.com/showcase/9?a=1&b", True))]
    for says in ("Watch", "watch the  video", "WATCH LIVESTREAM", "Meeting video recording", "<b>Live</b> <i>stream</i>", "recording", "viewvideo"):
        expected.append((f"<a href=' v?x=1 '>{says}</a>", ("https://town.org/m/v?x=1", False)))
    expected += [(f"<a href=/v>{says}</a>", None) for says in ("Watch out", "the video", "Videos", "")]
    expected.append(("<iframe src='https://town.org/x'></iframe><iframe src=//www.youtube.com/embed/1></iframe><iframe src=HTTPS://h.net/p></iframe>", ("https://h.net/p", False)))
    expected += [("<iframe src=//h.net/p></iframe><a href=/v>Video</a>", ("https://town.org/v", False)), (None, None), ("<iframe src=v.html>", None)]
    rows = [(i, "https://town.org/m/1", page) for i, (page, _) in enumerate(expected)] + [(-1, None, "<a href=/v>Video</a>")]
    found = {r["k"]: (r["link"], r["recognized"]) for r in el.video_pointers(spark.createDataFrame(rows, "k long, url string, html string"), "k").collect()}
    assert found == {-1: ("/v", False)} | {i: e for i, (_, e) in enumerate(expected) if e}


def test_agendas_and_chapters(spark):
    page = """<a href='/m'>Minutes</a><a name=agenda>Agenda</a><a href='/d?x=1&amp;y'><span>Full <b>AGENDA</b></span></a><a href='/agenda2'>x</a>
    <ul><li data-time=60><b>Roll</b> call<li data-time='x'>no</ul><div data-seconds="3661"><p>Budget &amp; <i>tax</i></p></div>"""
    pages = spark.createDataFrame([(1, page), (2, None), (3, "<a href=/x>y</a>")], "k long, html string")
    assert [tuple(r) for r in el.agenda_links(pages, "k").collect()] == [(1, "/d?x=1&y")]
    (row,) = el.chapters(pages, "k").collect()
    assert [tuple(c) for c in row["chapters"]] == [(60, "Roll call no"), (3661, "Budget & tax")]


def test_no_pages(spark):
    none = spark.createDataFrame([], "k string, url string, html string, element int, tier int")
    assert el.video_pointers(none, "k").count() == 0 and el.elements(none, "k", "html", ["a"]).agg(F.count("*")).first()[0] == 0
