import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from minutespark.operators import fulltext, search


def matched(spark, query, text, fuzzy=False):
    q = search.parse_query(query)
    test = search.matches_fuzzily if fuzzy else search.matches_exactly
    return spark.createDataFrame([(text,)], "t string").select(test(F.lower("t"), q)).first()[0]


def test_parse():
    q = search.parse_query('Budget "City Hall" -"closed session" -draft +Plan and & or + - "" x"y z')
    assert q.phrases == ["city hall"]
    assert q.not_phrases == ["closed session"]
    assert q.not_words == ["draft"]
    assert q.words == ["budget", "plan", 'x"y', "z"]


@pytest.mark.parametrize(
    ("query", "text", "fuzzy", "expected"),
    [
        ("cat", "they concatenate", False, True),
        ("budget plan", "the plan and the budget", False, True),
        ("budget plan", "the plan", False, False),
        ("budgte", "annual budget", False, False),
        ("budgte", "annual budget", True, False),
        ("budgut", "annual budget", True, True),
        ("zoning", "annual budget", True, False),
        ("cat", "the cut", True, False),
        ('"city hall"', "hall of the city", False, False),
        ('"city hall" vote', "a vote in City Hall", False, True),
        ("vote -hall", "a vote in City Hall", False, False),
        ("", "anything", False, True),
    ],
)
def test_matches(spark, query, text, fuzzy, expected):
    assert matched(spark, query, text, fuzzy) is expected


def test_snippet(spark):
    q = search.parse_query("fox")
    one = lambda t: spark.createDataFrame([(t,)], "t string").select(search.snippet(F.col("t"), q)).first()[0]
    assert one("A <b> & Fox's") == "A &lt;b&gt; &amp; <mark>Fox</mark>&#x27;s"
    assert one("x" * 60 + "fox" + "y" * 60) == "…" + "x" * 50 + "<mark>fox</mark>" + "y" * 50 + "…"
    assert one("x" * 50 + "fox" + "y" * 50) == "x" * 50 + "<mark>fox</mark>" + "y" * 50
    assert one("none") is None


def test_snippet_of_a_near_word(spark):
    rows = spark.createDataFrame([("The budget is due",), ("bud get, cat!",), ("a concat",), (None,)], "t string")

    def shown(query):
        return [r[0] for r in rows.select(search.snippet(F.col("t"), search.parse_query(query), fuzzy=True)).collect()]

    assert shown("zoning budgett") == ["The <mark>budget</mark> is due", None, None, None]
    assert shown("cat") == [None, "bud get, <mark>cat</mark>!", None, None]
    assert shown('"is due" budgett')[0] == "The budget <mark>is due</mark>"


def test_vocabulary_expansion_and_stemming(spark):
    texts = spark.createDataFrame([(1, "Budget meetings were held"), (2, "the budgets; meeting"), (3, "x" * 300)], "id int, t string")
    words = search.vocabulary(texts, "t")
    assert {r[0] for r in words.collect()} == {"budget", "meetings", "were", "held", "the", "budgets", "meeting"}
    assert search.expand(words, "budget") == ["budget", "budgets"]
    assert search.expand(words, "budget", at_most=1) is None
    q = search.parse_query("budget")
    for most in (1000, 1):  # as one expression, and by joins
        assert {r["id"] for r in search.fuzzy_by_vocabulary(texts, "id", "t", q, words, at_most=most).collect()} == {1, 2}
    index = fulltext.index(texts, "id", "t")
    for how, path in (({}, "scan"), ({"index": index}, "index"), ({"fuzzy": True}, "fuzzy_scan"), ({"fuzzy": True, "words": words}, "vocabulary")):
        taken, ids = search.find(texts, "id", "t", q, **how)
        assert taken == path and {r["id"] for r in ids.collect()} == {1, 2}
    taken, ids = search.find(texts, "id", "t", search.parse_query('"budget meetings"'), index=index)
    assert taken == "index" and {r["id"] for r in ids.collect()} == {1, 2}
    assert search.find(texts, "id", "t", search.parse_query("the of"), index=index)[1].count() == 0


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=15, deadline=None)
@given(hs.lists(hs.tuples(hs.text("ab'1", max_size=9), hs.text("ab'1", max_size=9)), min_size=1, max_size=20))
def test_bounded_edit_distance(spark, pairs):
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", F.levenshtein("a", "b", 2).alias("d"))
    for r in got.collect():
        d = plain_distance(r["a"], r["b"])
        assert r["d"] == (d if d <= 2 else -1)


def test_words_that_hold_another_need_no_search_of_their_own():
    assert search.shortest(["thatt", "that", "xthat", "hatt", "that"]) == ["hatt", "that"]
    assert search.shortest([]) == [] and search.shortest(["", "a"]) == [""]


def test_candidates_of_a_fuzzy_scan_are_all_tokens_within_the_edits(spark):
    rng = random.Random(5)
    words = ["thatt", "council", "budgets", "headquarter", "o'clock", "abcde", "x-rays", "no.12"]

    def edited(w):
        w = list(w)
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(w) + 1)
            w[i : i + rng.randrange(2)] = rng.choice(["", "x", "'", "7", "e"])
        return "".join(w)

    texts = [rng.choice(["", " ", "é", "-"]).join(edited(rng.choice(words)) for _ in range(rng.randrange(1, 4))) for _ in range(1500)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "", None])], "id long, t string")
    for w in words:
        k = search.tolerance(len(w))
        all_tokens = F.exists(search.tokens(F.col("t")), lambda t: (t == w) | (F.levenshtein(t, F.lit(w), k) >= 0))  # noqa: B023
        got = rows.select(search.matches_fuzzily(F.lower("t"), search.Query(words=[w])).alias("a"), all_tokens.alias("b")).collect()
        assert [r.a for r in got] == [r.b for r in got] and (any(r.b for r in got) or "-" in w or "." in w)
    assert re.findall(search.near_pattern("thatt", 1), "that thatt thattt hat thattxx a'zzz thxxxxx tatt") == ["that", "thatt", "thattt", "a'zzz", "tatt"]
