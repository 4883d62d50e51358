import random
import time

from pyspark.sql import functions as F

from minutespark.operators import containment, search, trigrams


def pairs(spark, texts, terms):
    t = spark.createDataFrame(texts, "id long, text string, term string")
    q = spark.createDataFrame(terms, "term_id long, term string, id long")
    return sorted((r["id"], r["term_id"]) for r in containment.containing(t, "text", q, "id").collect())


def test_terms_against_enumeration(spark, monkeypatch):
    rng = random.Random(3)
    some = lambda n: "".join(rng.choice("abÉß' 中") for _ in range(rng.randrange(0, n)))
    texts = [(i, some(40), "clash") for i in range(60)] + [(1, "ab ab", "clash"), (70, None, ""), (71, "", "")]
    terms = [(i, some(5), 0) for i in range(80)] + [(90, None, 0), (91, "  ", 0), (92, "AB", 0), (93, "ab", 0)]
    expected = sorted((i, q) for i, t, _ in texts for q, term, _ in terms if t and term and term.strip() and term.lower() in t.lower())
    assert pairs(spark, texts, terms) == expected
    monkeypatch.setattr(containment, "SHARD_BYTES", 50)  # several automata, one after the other
    assert pairs(spark, texts, terms) == expected


def test_empty_tables(spark):
    assert pairs(spark, [], [(1, "a", 0)]) == [] and pairs(spark, [(1, "a", "")], []) == []


def test_a_word_of_ten_million_characters(spark):
    texts = [(1, "ab" * 5_000_000, ""), (2, "x", "")]
    began = time.time()
    assert pairs(spark, texts, [(1, "baba", 0), (2, "b" * 3, 0), (3, "x", 0)]) == [(1, 1), (2, 3)]
    assert time.time() - began < 60


def test_similar_words_against_enumeration(spark):
    rng = random.Random(4)
    some = lambda: "".join(rng.choice("abcd'1") for _ in range(rng.randrange(1, 10)))
    words, terms = {some() for _ in range(250)} | {"''"}, {some() for _ in range(25)} | {"zzzzz", "'"}

    def grams(w):
        return {f"  {p} "[i : i + 3] for p in w.replace("'", " ").split() for i in range(len(p) + 1)}

    expected = set()
    for t in terms:
        near = [(-len(grams(t) & grams(w)) / len(grams(t) | grams(w)), w) for w in words if grams(t) & grams(w)]
        expected |= {(t, w, round(-s, 9)) for s, w in sorted(near)[:7] if -s >= 0.3}
    frames = [spark.createDataFrame([(w,) for w in x], f"{n} string") for x, n in ((words, "word"), (terms, "term"))]
    assert {(r["term"], r["word"], round(r["similarity"], 9)) for r in trigrams.candidates(*frames, best=7).collect()} == expected
    near = {(r["term"], r["word"]): r["distance"] for r in trigrams.near_terms(*frames, best=None).collect()}
    for (t, w), d in near.items():
        assert d <= search.tolerance(len(t)) and (d > 0 or t == w)


def test_texts_near_terms(spark):
    texts = spark.createDataFrame([(1, "The budget"), (2, "budgets"), (3, "scatter"), (4, None)], "id long, text string")
    terms = spark.createDataFrame([("budgte",), ("budgett",), ("cat",), ("zoning",)], "term string")
    got = trigrams.texts_near(texts, "id", "text", terms, search.vocabulary(texts, "text")).select("term", "id")
    assert {tuple(r) for r in got.collect()} == {("budgett", 1), ("budgett", 2), ("cat", 3)}
    assert texts.select(F.size(trigrams.trigrams(F.lit("don't")))).first()[0] == 6


def test_words_are_not_dealt_out_by_trigram(spark):
    """A vocabulary's trigrams stay where its words are; words given twice count once."""
    words = spark.createDataFrame([("planning",), ("planning",), ("plan",), ("zoning",)], "word string")
    found = trigrams.candidates(words, spark.createDataFrame([("planing",)], "term string"))
    assert "hashpartitioning(gram" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r["word"], round(r["similarity"], 6)) for r in found.collect()} == {("planning", 0.7), ("plan", round(4 / 9, 6))}
