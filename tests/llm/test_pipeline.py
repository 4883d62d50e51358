import random

import corpus_pipeline
from tests.llm.data import frame
from tests.llm.test_jaccard_join import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def write(spark, folder):
    rng = random.Random(9)
    bench = [(i, " ".join(f"b{rng.randrange(5000)}" for _ in range(40))) for i in range(5)]
    docs = []
    for i in range(150):
        text = " ".join(f"w{rng.randrange(9000)}" for _ in range(rng.randrange(60, 300)))
        if i % 10 == 3:
            text = docs[-1][1] + " tail"
        if i % 10 == 5:
            text += " " + bench[i % 5][1]
        if i % 10 == 7:
            text += " password: abcdefghijklmnop"
        if i % 50 == 9:
            text = "### " * 300
        docs.append((i, text, "en", "s", len(text)))
    docs.append((500, None, None, None, None))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, bench


def test_stages_take_effect_in_order(spark, tmp_path):
    docs, bench = write(spark, tmp_path)
    frames = [spark.read.parquet(f"{tmp_path}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], str(tmp_path)))
    assert all(f.columns == COLUMNS for f in frames[:5])
    texts = [{r["doc_id"]: r["text"] for r in f.collect()} for f in frames[:5]]
    good = {i for i, t, *_ in docs if t and not t.startswith("###")}
    assert set(texts[1]) == good
    component = {i: c for i, _, c in brute([(i, texts[1][i]) for i in sorted(good)], 5, 80, 100)}
    assert set(texts[2]) == {i for i in good if component[i] == i} < good
    assert set(texts[3]) == {i for i, t in texts[2].items() if not any(b in t for _, b in bench)} < set(texts[2])
    assert set(texts[4]) == set(texts[3])
    assert {i for i in texts[4] if texts[4][i] != texts[3][i]} == {i for i, t in texts[3].items() if "password" in t}
    assert all(texts[4][i] == texts[3][i].replace("password: abcdefghijklmnop", "[SECRET]") for i in texts[4])
    packed = frames[5].collect()
    assert {r["doc_id"] for r in packed} == set(texts[4])
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = lambda r: (r["doc_id"], r["piece"])
    assert sorted(((*key(r), r["ids_crc32"]) for r in whole)) == sorted((*key(r), r["ids_crc32"]) for r in packed)


def test_stages_on_awkward_rows(spark, tmp_path):
    _, _ = write(spark, tmp_path)
    docs = frame(spark).select(*COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.count() > 0


def test_stages_keep_clashing_columns(spark, tmp_path):
    """Columns named like those that the operators add come through unharmed."""
    write(spark, tmp_path)
    extra = ["kept", "base_failed", "distance2", "stat_n_words", "x0", "_key", "_gone", "_id", "_th", "_spans", "id", "n", "rep", "sig", "component", "row", "c0", "group"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("*", *(f"'{e}' as `{e}`" for e in extra))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == COLUMNS + extra
    assert docs.select(*extra).distinct().collect() == [tuple(extra)]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() > 0
