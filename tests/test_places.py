import random

from minutespark.operators import places
from pyspark.sql import functions as F

ABBREVIATED = {"st", "ste", "ft", "mt", "pt", "n", "s", "e", "w"}


def plain_walk(after):
    """The rules of a name in running text, word by word."""
    kept = []
    for word in after[:120].split():
        core = word.strip(",;:")
        if not core[:1].isupper():
            break
        stop = core.endswith(".") and core[:-1].lower() not in ABBREVIATED and len(core.rstrip(".")) > 1
        kept.append(core.rstrip(".") if stop else core)
        if stop or word != core or len(kept) == 5:
            break
    return " ".join(kept) or None


def test_names_in_text_against_a_walk(spark):
    rng = random.Random(4)
    bits = ["Hercules", "Las", "Vegas.", "Ft.", "St.", "N.", "A.", "and", "Boston,", "Élan", "x", ";", "XIV.", "Worth:", "Long" * 8, "...", "(Old)"]
    after = [" ".join(rng.choice(bits) for _ in range(rng.randrange(0, 9))) for _ in range(600)]
    rows = spark.createDataFrame([(i, f"the Town hall. County of \n{a}") for i, a in enumerate(after)], "k long, t string")
    got = {r["k"]: r["n"] for r in rows.select("k", places.from_text(F.col("t"))["place"].alias("n")).collect()}
    assert got == {i: plain_walk(a) for i, a in enumerate(after)}


def test_names_in_markup(spark):
    cases = ["<h1>CITY OF OKLAHOMA CITY</h1>", "<script>City of Nowhere.</script><b>town of Old Lyme, CT</b>", "City of the people.", "city of " + "Word " * 30 + ".", None, ""]
    got = [(r[0], r[1]) for r in spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "k long, h string").orderBy("k").select(places.from_markup(F.col("h"))["body"], places.from_markup(F.col("h"))["place"]).collect()]
    assert got == [("City", "Oklahoma City"), ("Town", "Old Lyme"), (None, None), (None, None), (None, None), (None, None)]


def test_the_first_tier_that_holds(spark):
    known = spark.createDataFrame([("Hercules",), ("Fort Worth",), ("Burlington",), ("Grand Valley",), ("media",), (None,)], "name string")
    pages = [
        (1, "City of Hercules. XIV. PUBLIC", "", "https://example.org/"),
        (2, "City of Ft. Worth Residents met", "", "https://example.org/"),
        (3, "no name", "<h1>CITY OF HERCULES</h1>", "https://example.org/"),
        (4, "City of Burlington, VT", "", "https://hercules.example.org/1"),
        (5, "City of Hercules, CA", "", "https://cityofhercules.example.org/1"),
        (6, "County of Elsewhere", "<p>town of Nowhere.</p>", "https://www.grandvalley2.example.org/"),
        (7, "", "", "https://media.example.org/"),
        (8, None, None, None),
        (9, "City of Elsewhere", "<p>City of Hercules,</p>", "https://townhall.example.org/"),
    ]
    got = {r[0]: tuple(r)[1:] for r in places.of_pages(spark.createDataFrame(pages, "k long, t string, h string, u string"), "k", "t", "h", "u", known, "name").collect()}
    assert got == {
        1: ("text", "City", "hercules", "validated"),
        2: ("text", "City", "fort worth", "repaired"),
        3: ("markup", "City", "hercules", "validated"),
        4: ("host", None, "hercules", "validated"),
        5: ("text", "City", "hercules", "validated"),
        6: ("host", None, "grand valley", "validated"),
        7: (None, None, None, None),
        8: (None, None, None, None),
        9: ("markup", "City", "hercules", "validated"),
    }
    empty = spark.createDataFrame([], "k long, t string, h string, u string")
    assert places.of_pages(empty, "k", "t", "h", "u", known, "name").count() == 0
