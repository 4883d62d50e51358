import hashlib
import math
import re
from collections import Counter

from __spark_entry__ import queries
from minutespark.operators import languages
from minutespark.operators import segments as seg
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


def plain_grams(text):
    words = [w for w in re.split(r"[\W\d_]+", (text or "").lower()) if 0 < len(w) <= languages.LONGEST]
    return [f" {w} "[i : i + 3] for w in words for i in range(len(w))]


def plain_model(rows, most=50_000):
    counts = {}
    for text, lang in rows:
        if lang is not None:
            counts.setdefault(lang, Counter()).update(plain_grams(text))
    total = sum(counts.values(), Counter())
    kept = [g for g, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:most]]
    sums = {lang: sum(c[g] for g in kept) for lang, c in counts.items()}
    return {lang: {g: round(math.log((c[g] + 0.5) / (sums[lang] + 0.5 * len(kept))) * languages.SCALE) for g in kept} for lang, c in counts.items()}


def plain_detect(text, model):
    grams = [g for g in plain_grams(text) if any(g in m for m in model.values())]
    return max(sorted(model), key=lambda lang: sum(model[lang][g] for g in grams)) if grams else None


def test_against_plain_bayes(spark):
    rows = [("the cat and the dog", "en"), ("der hund und die katze", "de"), ("le chien et le chat", "fr"), (None, "en"), ("nothing", None), ("", "de"), ("été où", "fr")]
    asked = [*(t for t, _ in rows), "THE DOG!", "und die 12", "12 34", "ÉTÉ", "x" * 50, "zzzz qqqq", "the " * 3000]
    labelled = spark.createDataFrame(rows, "text string, lang string")
    texts = spark.createDataFrame([*enumerate(asked), (None, "der hund")], "id long, text string")
    for most in (50_000, 20):
        model = languages.train(labelled, "text", "lang", most)
        wanted = plain_model(rows, most)
        assert model.languages == ["de", "en", "fr"]
        assert {r["gram"]: (r["l0"], r["l1"], r["l2"]) for r in model.table.collect()} == {g: tuple(wanted[n][g] for n in model.languages) for g in wanted["en"]}
        got = {r["id"]: r["detected"] for r in languages.detect(texts, ["id"], "text", model).collect()}
        assert got == {**{i: plain_detect(t, wanted) for i, t in enumerate(asked)}, None: plain_detect("der hund", wanted)}


def test_a_large_language_is_sampled_by_its_texts(spark):
    rows = spark.range(4000).select(F.concat(F.lit("word "), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("text"), F.lit("en").alias("lang"))
    model = languages.train(rows, "text", "lang", sample=1000)
    every = languages.train(rows, "text", "lang")
    assert 0 < model.table.count() <= every.table.count()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, text string, lang string")
    some = spark.createDataFrame([(1, "the", "en")], "id long, text string, lang string")
    assert languages.detect(none, ["id"], "text", languages.train(some, "text", "lang")).count() == 0
    assert [r["detected"] for r in languages.detect(some, ["id"], "text", languages.train(none, "text", "lang")).collect()] == [None]


def test_held_out_accuracy(spark):
    rows = queries()["agg27_detected_language"](spark, FOLDER.replace("sf0.001", "sf0.01")).where("held_out").collect()
    right, total = sum(r["n"] for r in rows if r["lang"] == r["detected"]), sum(r["n"] for r in rows)
    assert total > 50 and right / total >= 0.95, (right, total)


def test_language_of_samples(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    model = plain_model([(d["text"], d["lang"]) for d in docs if not hashlib.md5(str(d["doc_id"]).encode()).hexdigest().endswith("0")])
    chunks = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", F.explode(seg.sample_chunks(F.col("text"))).alias("c")).collect()
    weights = {}
    for r in chunks:
        if (lang := plain_detect(r["c"], model)) is not None:
            weights.setdefault(r["doc_id"], Counter())[lang] += len(r["c"])
    expected = {d: max(w, key=lambda lang: (w[lang], lang)) for d, w in weights.items()}
    assert {r["doc_id"]: r["lang"] for r in queries()["seg15_language_samples"](spark, FOLDER).collect()} == expected


def test_a_model_that_is_sent_and_one_that_is_joined_agree(spark, monkeypatch):
    labelled = spark.createDataFrame([("the cat and the dog", "en"), ("der hund und die katze", "de")], "text string, lang string")
    texts = spark.createDataFrame([(1, "the dog", 3), (1, "der", 4), (2, None, 5), (3, "12 zzz " + "x" * 50, 6), (None, "DIE Katze été", 7), (4, "", 8)], "id long, text string, w long")
    got = []
    for cells in (languages.BROADCAST_CELLS, 0):
        monkeypatch.setattr(languages, "BROADCAST_CELLS", cells)
        model = languages.train(labelled, "text", "lang")
        found = languages.detect(texts, ["id"], "text", model, total="w")
        got.append(sorted(map(tuple, found.collect()), key=str))
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert ("Generate" in plan) == (cells == 0)  # no row for each gram where the model is sent
    assert got[0] == got[1] and (1, "en", 7) in got[0] and (2, None, 5) in got[0] and len(got[0]) == 5
