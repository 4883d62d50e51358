import random

import numpy as np
import pandas as pd
import pytest

from minutespark.llm import quality as q
from tests.llm.data import SCHEMA, empty, frame


def plain(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = {}
    for i in range(len(words) - 7):
        grams.setdefault(tuple(words[i : i + 8]), []).append(i)
    repeated = {p for at in grams.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(repeated)


def test_statistics():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["a ", "b ", "é\n", "#", "\t", "c c ", "\n", "dd\x0b", " ", "|x "]) for _ in range(rng.randrange(0, 90)))
        assert q.text_statistics(text.encode()) == plain(text), repr(text)


def test_rejects_outliers_of_their_group_only(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        odd = i % 60 == 7
        n = rng.randrange(80, 400)
        text = " ".join(("###$$$|||%%%" if odd else "w") + str(rng.randrange(9999)) for _ in range(n))
        rows.append((i, text, "en", f"s{i % 2}", 0, 0, 0, "", 0))
    rows += [(1000, None, None, None, 0, 0, 0, "", 0), (1001, "", "en", "s0", 0, 0, 0, "", 0), (1002, "few words", None, "s0", 0, 0, 0, "", 0)]
    got = {r["doc_id"]: r for r in q.quality_verdicts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {i for i in range(600) if not got[i]["kept"]} == {i for i in range(600) if i % 60 == 7}
    assert all(got[i]["base_failed"] and not got[i]["kept"] for i in (1000, 1001, 1002))
    kept = q.keep_good(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert {r["doc_id"] for r in kept.collect()} == {i for i in range(600) if i % 60 != 7}


def test_concentration_steps_against_plain_numpy(spark):
    """The robust location stays with the bulk although a fifth of the rows lie elsewhere."""
    rng = np.random.default_rng(0)
    n = 2000
    stats = pd.DataFrame({"stat_n_words": rng.integers(90, 400, n), "lang": "en", "source": "a"})
    stats["stat_word_chars"] = stats.stat_n_words * 5 + rng.integers(0, 50, n)
    stats["stat_n_symbols"] = np.where(np.arange(n) < n // 5, stats.stat_n_words, 0)
    stats["stat_n_dup_lines"] = 0
    stats["stat_n_repeat_words"] = 0
    groups, params = q.fit(spark.createDataFrame(stats), "lang", "source")
    mean = np.array(params.first()["mean"])
    bulk = stats[stats.stat_n_symbols == 0]
    assert abs(mean[0] - np.log(bulk.stat_n_words).mean() / 2) < 0.1
    assert mean[2] == 0
    assert groups.count() == 1


def test_awkward_rows(spark):
    assert q.quality_verdicts(frame(spark)).count() == frame(spark).count()
    assert q.quality_verdicts(empty(spark)).count() == 0
    assert q.keep_good(empty(spark)).count() == 0


def table(n_words, chars, symbols, dups, repeats):
    return pd.DataFrame({"stat_n_words": n_words, "stat_word_chars": chars, "stat_n_symbols": symbols, "stat_n_dup_lines": dups, "stat_n_repeat_words": repeats, "lang": "en", "source": "a"})


def plain_mcd(x, starts=40):
    """Random subsets of six rows, concentration steps until they stand, the least determinant of all."""
    best = None
    for seed in range(starts):
        near = np.random.default_rng(seed).permutation(len(x))[:6]
        for _ in range(60):
            mean, cov = x[near].mean(0), q.CONSISTENCY * np.cov(x[near].T, bias=True) + np.diag(q.FLOOR**2)
            d2 = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            again = np.argsort(d2, kind="stable")[: int(np.ceil(q.SUPPORT * len(x)))]
            if len(again) == len(near) and (again == near).all():
                break
            near = again
        logdet = np.linalg.slogdet(cov)[1]
        if best is None or logdet < best[0]:
            best = logdet, mean, cov
    return best


def test_against_a_plain_mcd(spark):
    """Correlated statistics; a fifth of the rows form a cluster of their own, others lie about."""
    rng = np.random.default_rng(5)
    n = 3000
    words = np.exp(rng.normal(5.5, 0.7, n)).astype(int) + 30
    length = np.exp(rng.normal(1.6, 0.05, n) + 0.05 * (np.log(words) - 5.5))
    bad = np.arange(n) < n // 5
    words[bad], length[bad] = 3000 + rng.integers(0, 200, bad.sum()), 9.0
    symbols = np.where(rng.random(n) < 0.1, words // 9, 0)
    stats = table(words, (words * length).astype(int), symbols, rng.integers(0, 2, n), np.where(rng.random(n) < 0.05, words // 8, 0))
    frame_ = spark.createDataFrame(stats)
    _, params = q.fit(frame_, "lang", "source")
    found = params.first()
    x = np.array(frame_.select(*q.features()).toPandas(), float)
    logdet, mean, cov = plain_mcd(x)
    assert found["logdet"] <= logdet + 0.05  # buckets of two percent in place of an exact order
    assert np.allclose(found["mean"], mean, atol=0.02)
    d2 = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
    off = x - np.array(found["mean"])
    own = np.einsum("ij,jk,ik->i", off, np.array(found["inverse"]).reshape(5, 5), off)
    assert np.median(abs(own / d2 - 1)) < 0.05 and ((own > q.CHI2_CUT) == (d2 > q.CHI2_CUT)).mean() > 0.995
    assert (own[bad] > q.CHI2_CUT).all()


@pytest.mark.parametrize("which", range(5))
def test_an_outlier_in_each_single_statistic(spark, which):
    rng = np.random.default_rng(which)
    n = 400
    words = rng.integers(90, 400, n)
    stats = table(words, words * 5 + rng.integers(-40, 40, n), 0 * words, 0 * words, 0 * words)
    odd = [(60_000, 300_000, 0, 0, 0), (200, 2000, 0, 0, 0), (200, 1000, 100, 0, 0), (200, 1000, 0, 100, 0), (200, 1000, 0, 0, 59)][which]
    stats = pd.concat([stats, table(*([v] for v in odd))])
    frame_ = spark.createDataFrame(stats)
    got = q.judge(frame_, *q.fit(frame_, "lang", "source"), "lang", "source").where("not kept").collect()
    assert [(r["stat_n_words"], r["base_failed"]) for r in got] == [(odd[0], False)]


def test_least_group_is_a_parameter(spark):
    words = np.arange(100, 130)
    stats = pd.concat([table(words, words * 5, 0 * words, 0 * words, 0 * words), table([110], [550], [110], [0], [0])])
    frame_ = spark.createDataFrame(stats)
    for least, rejected in ((100, 0), (20, 1)):
        assert q.judge(frame_, *q.fit(frame_, "lang", "source", least), "lang", "source", least).where("not kept").count() == rejected


def test_each_row_is_judged_by_its_own_text_and_group(spark):
    """Rows without ids, an odd text that is common in another group, and repeated rows."""
    rng = random.Random(7)
    plain = lambda: " ".join("w" + str(rng.randrange(9999)) for _ in range(rng.randrange(80, 300)))
    odd = " ".join("###$$$|||%%%" + str(rng.randrange(9999)) for _ in range(150))
    rows = [(None, plain(), "en", "a", 0, 0, 0, "", 0) for _ in range(200)] + [(None, odd, "en", "a", 0, 0, 0, "", 0)] * 3
    rows += [(None, odd.replace("w", str(i)), None, "b", 0, 0, 0, "", 0) for i in range(200)] + [(None, odd, None, "b", 0, 0, 0, "", 0), (None, None, "en", "a", 0, 0, 0, "", 0)]
    kept = q.keep_good(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sum(r["lang"] == "en" for r in kept) == 200 and sum(r["lang"] is None for r in kept) == 201
