import random

import pytest

from minutespark.llm import scratch
from minutespark.llm import suffix_dedup as sd
from tests.llm.data import SCHEMA, empty, frame


def run(spark, texts, length):
    rows = [(i, t, None, None, 0, 0, 0, "", 0) for i, t in enumerate(texts)]
    found = sd.with_digest(sd.remove_repeats(spark.createDataFrame(rows, SCHEMA), length=length)).collect()
    return [tuple(r)[1:] for r in sorted(found, key=lambda r: r["doc_id"])]


def corpus(seed):
    rng = random.Random(seed)
    fresh = lambda n: "".join(rng.choice("abcdefgh ij\né") for _ in range(n))
    common = [fresh(n) for n in (390, 400, 401, 450, 700, 1500)]
    texts = [fresh(rng.randrange(0, 900)) + rng.choice(common) + fresh(rng.randrange(0, 500)) + rng.choice(common)[: rng.randrange(300, 1500)] for _ in range(30)]
    return [*texts, "a" * 1200, "a" * 399, "a" * 400, "ab" * 500, "der " * 300, None, "", common[1], common[1][1:] + "z", fresh(6000), texts[0], texts[0]]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_the_definition(spark, seed):
    texts = corpus(seed)
    assert run(spark, texts, 400) == sd.brute_force([(t or "").encode() for t in texts], 400)


@pytest.mark.parametrize("part", [None, 700])
def test_runs_and_periods(spark, monkeypatch, part):
    if part:
        monkeypatch.setattr(sd, "PART", part)
    rng = random.Random(5)
    fresh = lambda n: "".join(rng.choice("abcdefgh ij") for _ in range(n))
    texts = []
    for period in (1, 2, 3, 5, 8, 13, 21, 24, 32, 33, 63, 64, 65, 100, 401):
        unit = fresh(period)
        for size in (399, 400, 400 + period - 1, 400 + period, 401 + period, 400 + 2 * period, 1500):
            texts.append(fresh(rng.choice([0, 7, 300])) + (unit * (size // period + 1))[:size] + fresh(rng.choice([0, 9, 300])))
    one, two = fresh(6), fresh(4)
    texts += ["ab" * 300 + "abc" * 300 + "a" * 900, one * 120 + two * 150, one * 67, two * 100, two * 101, two * 99]
    rng.shuffle(texts)
    assert run(spark, texts, 400) == sd.brute_force([t.encode() for t in texts], 400)


def test_repetitive_text_makes_few_blocks():
    import numpy as np

    rng = np.random.default_rng(1)
    for period in [*range(1, 70), 100, 224]:
        unit = rng.integers(97, 123, period).astype(np.uint8)
        buf = np.concatenate([np.tile(unit, 60_000 // period), rng.integers(97, 123, 1000).astype(np.uint8)])
        assert len(sd.blocks(buf, np.array([0, 30_000, len(buf)]), 400)["doc"]) <= 0.04 * len(buf)


def test_hot_cores_take_the_shuffled_way(spark, monkeypatch):
    monkeypatch.setattr(sd, "LOCAL_BLOCKS", 2)
    texts = corpus(3)
    assert run(spark, texts, 400) == sd.brute_force([(t or "").encode() for t in texts], 400)


def test_long_texts_are_parsed_in_parts(spark, monkeypatch):
    monkeypatch.setattr(sd, "PART", 500)
    monkeypatch.setattr(scratch, "BROADCAST_BYTES", -1)
    texts = corpus(4)
    assert run(spark, texts, 400) == sd.brute_force([(t or "").encode() for t in texts], 400)


def test_awkward_rows(spark):
    found = sd.remove_repeats(frame(spark))
    rows = found.collect()
    assert len(rows) == frame(spark).count()
    twice = [r for r in rows if r["doc_id"] == 207]
    assert len(twice) == 2 and twice[0] == twice[1] and twice[0]["n_removed"] == twice[0]["n_bytes"]
    assert sd.remove_repeats(empty(spark)).count() == 0
    with pytest.raises(ValueError, match="at least"):
        sd.remove_repeats(frame(spark), length=100)


def test_suffix_array_is_lexicographic():
    import numpy as np

    rng = np.random.default_rng(1)
    for length in (256, 400, 511):
        for letters in (2, 250):
            part = rng.integers(0, letters, 900).astype(np.uint8)
            buf = np.concatenate([part, part[100:800], part])
            start = rng.permutation(len(buf) - length + 1)[:700]
            order, same = sd.suffix_array(buf, start, length)
            strings = [buf[s : s + length].tobytes() for s in start[order]]
            assert strings == sorted(strings)
            assert same.tolist() == [False] + [a == b for a, b in zip(strings, strings[1:])]


def test_strings_that_collide_under_polynomials_stay(spark):
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    texts = [word[:1200], word.translate(str.maketrans("ab", "ba"))[:1200], "x" + word[:700]]
    assert run(spark, texts, 400) == sd.brute_force([t.encode() for t in texts], 400)
