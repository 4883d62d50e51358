import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from minutespark.llm import decontaminate as dc
from tests.llm.data import SCHEMA, empty, frame


@pytest.mark.parametrize("n_words", [20, 40])
def test_blocks_find_every_fingerprint_within_the_radius(n_words):
    rng = np.random.default_rng(4)
    index = dc.Index([7], [" ".join(f"w{i}" for i in range(n_words))], 5)
    size, entry = max(index.classes.items())
    target = entry["prints"][0]
    for flips in range(dc.radius(size) + 1):
        for _ in range(200):
            bits = rng.choice(64, flips, replace=False)
            other = target ^ np.bitwise_or.reduce(np.uint64(1) << bits.astype(np.uint64)) if flips else target
            hit = False
            for (block, _), (held, count, start, items) in zip(dc._blocks(np.array([other]), size), entry["tables"], strict=True):
                hit |= 0 in items[start[block[0]] : start[block[0]] + count[block[0]]]
            assert hit, flips


def plain_similarity(item, text, k=5):
    """The greatest weighted Jaccard similarity of the item and any window of its length, by enumeration."""

    def bag(words):
        return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else Counter([tuple(words)])

    a, n, best = bag(item), len(item), 0.0
    for i in range(max(1, len(text) - n + 1)):
        b = bag(text[i : i + n])
        best = max(best, (a & b).total() / (a | b).total())
    return best


@pytest.mark.parametrize("n", [15, 17, 21, 28, 32, 44, 59, 120])
def test_recall_against_enumeration(n):
    """Items cut or edited, inside other text: at least 95 of 100 that are similar enough are found, and nothing else."""
    rng = random.Random(n)
    word = lambda: f"v{min(2999, int(rng.paretovariate(0.6)))}"
    items = [[word() for _ in range(n)] for _ in range(12)]
    index = dc.Index(list(range(12)), [" ".join(i) for i in items], 5)
    found = similar = 0
    for _ in range(150):
        which = rng.randrange(12)
        near = list(items[which])
        for _ in range(rng.randrange(1, max(2, n // 12) + 1)):
            at = rng.choice([0, len(near) - 1, rng.randrange(len(near))])
            near[at : at + rng.choice([0, 1, 1])] = [word()] * rng.choice([0, 0, 1])
        text = [word() for _ in range(30)] + near + [word() for _ in range(30)]
        hits = {item for _, item, *_ in index.scan(pa.array([" ".join(text)]), 0.8)}
        expected = {i for i in range(12) if plain_similarity(items[i], text) >= 0.8}
        assert hits <= expected
        found += len(hits)
        similar += len(expected)
    assert similar >= 20 and found >= 0.95 * similar


def test_ties_give_the_first_window_and_very_long_texts():
    index = dc.Index([3], ["a b c d e f g h i j"], 5)
    text = "x y " + "a b c d e f g h i j " * 2 + "z " * 300_000 + "a b c d e f g h i j"
    assert list(index.scan(pa.array([text, None, ""]), 0.8)) == [(0, 0, 1.0, 2, 10)]


def test_rows_are_judged_by_their_own_text(spark):
    items = spark.createDataFrame([(1, "some benchmark text with a few more words")], "item_id long, text string")
    texts = ["some benchmark text with a few more words", "clean", None, "clean too"]
    docs = spark.createDataFrame([(None if i < 3 else 5, t, None, None, 0, 0, 0, "", 0) for i, t in enumerate([*texts, texts[0]])], SCHEMA)
    kept = sorted((str(r["doc_id"]), str(r["text"])) for r in dc.drop_contaminated(docs, items).collect())
    assert kept == [("5", "clean too"), ("None", "None"), ("None", "clean")]


def test_finds_copies_and_near_copies_and_leaves_clean_texts(spark):
    rng = random.Random(1)
    word = lambda: f"v{rng.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((3, 5, 9, 14, 30, 52, 75, 300))]
    items += [(90, None), (91, ""), (92, "  ")]
    docs, expected = [], set()
    for d in range(60):
        text = [word() for _ in range(rng.randrange(0, 400))]
        if d % 2:
            i, item = items[d % 8]
            near = item.split()
            if i >= 6:
                near[0] = "changed"
            at = rng.randrange(0, len(text) + 1)
            text[at:at] = [w.upper() for w in near]
            expected.add((d, i))
        docs.append((d, " ".join(text), None, None, 0, 0, 0, "", 0))
    docs += [(70, None, None, None, 0, 0, 0, "", 0), (71, "", None, None, 0, 0, 0, "", 0), (1, docs[1][1], None, None, 0, 0, 0, "", 0)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = dc.contaminated(spark.createDataFrame(docs, SCHEMA), bench)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == expected
    assert found.count() == len(expected)
    kept = dc.drop_contaminated(spark.createDataFrame(docs, SCHEMA), bench)
    assert kept.columns == frame(spark).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [*range(0, 60, 2), 70, 71]


def test_items_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(dc, "ITEM_BYTES", 150)
    items = spark.createDataFrame([(i, f"some benchmark text number {i} with a few more words than {i}") for i in range(5)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"x y z some benchmark text number {i} with a few more words than {i} and on", None, None, 0, 0, 0, "", 0) for i in range(5)], SCHEMA)
    best = dc.contaminated(docs, items).where("similarity = 1")
    assert {(r["doc_id"], r["item_id"], r["first_word"]) for r in best.collect()} == {(i, i, 3) for i in range(5)}


def test_long_windows_and_exact_similarity():
    a, b = np.array([1, 1, 2, 3], np.uint64), np.array([1, 2, 2, 4], np.uint64)
    assert dc.weighted_similarity(a, b) == 2 / 6
    words = np.random.default_rng(0).integers(1, 2**63, 700).astype(np.uint64)
    for size, prints in dc.window_prints(words, [5, 40, 300]):
        bits = np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1)
        plain = np.array([np.packbits((bits[i : i + size].sum(0) > size // 2)) for i in range(len(words) - size + 1)]).view(np.uint64).ravel()
        assert (prints == plain).all()


def test_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.contaminated(empty(spark), none).count() == 0
    assert dc.drop_contaminated(frame(spark), none).count() == frame(spark).count()


def test_texts_shorter_than_the_items_class(spark):
    """Documents that are an item without its last words, at the edges of the classes."""
    rng = random.Random(8)
    items = [(n, " ".join(f"v{rng.randrange(3000)}" for _ in range(n))) for n in (16, 18, 21, 50, 58)]
    docs, expected = [], {}
    for n, text in items:
        for gone in range(n):
            if (n - gone - 4) / (n - 4) < 0.8:
                break
            docs.append((len(docs), " ".join(text.split()[: n - gone]), None, None, 0, 0, 0, "", 0))
            expected[docs[-1][0]] = (n, (n - gone - 4) / (n - 4))
    found = dc.contaminated(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"]: (r["item_id"], r["similarity"]) for r in found.collect()} == expected
