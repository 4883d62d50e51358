import itertools
import random
import re

import numpy as np
import pytest

from minutespark.llm import jaccard_join as jj
from tests.llm.data import documents, empty, frame


def shingle_set(text, k):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = re.findall(rb"[^\x20\x09-\x0D]+", low)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or frozenset([tuple(w)])


def brute(rows, k, num, den):
    rows = [(i, shingle_set(t, k)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations(rows, 2):
        if x and y and den * len(x & y) >= num * len(x | y):
            p, q = sorted((find(a), find(b)))
            parent[q] = p
    return sorted((i, len(s), find(i)) for i, s in rows)


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 80, 100)])
def test_components_against_brute_force(spark, k, num, den):
    rows = [(r[0], r[1]) for r in documents() if r[0] is not None and r[0] != 207]
    got = jj.jaccard_components(frame(spark), k=k, num=num, den=den).where("id is not null and id <> 207")
    assert sorted((r["id"], r["n"], r["component"]) for r in got.collect()) == brute(rows, k, num, den)


def test_many_near_copies_of_all_sizes(spark):
    rng = random.Random(5)
    rows = []
    for group, size in enumerate((3, 8, 13, 19, 25, 40, 90)):
        base = [f"g{group}w{i}" for i in range(size)]
        for c in range(14):
            text = list(base)
            for _ in range(rng.randrange(0, max(2, size // 16))):
                text[rng.choice([0, len(text) - 1, rng.randrange(len(text))])] = f"e{c}"
            rows.append((group * 100 + c, " ".join(text), None, None, 0, 0, 0, "", 0))
    got = jj.jaccard_components(frame(spark, rows), k=1, num=85, den=100)
    assert sorted((r["id"], r["n"], r["component"]) for r in got.collect()) == brute([(r[0], r[1]) for r in rows], 1, 85, 100)


@pytest.mark.parametrize("size", [1, 2, 5, 9, 14, 20, 33, 60, 150, 700])
def test_linked_sets_share_a_signature(size):
    """The pigeonhole guarantee, on random pairs right at the threshold."""
    rng = np.random.default_rng(size)
    for _ in range(40):
        a = rng.integers(1, 2**63, size).astype(np.uint64)
        b = a.copy()
        cut = int(rng.integers(0, size // 6 + 1))
        b = b[cut:]
        both = len(np.intersect1d(a, b))
        if both * 100 < 85 * (len(a) + len(b) - both) or not len(b) or np.array_equal(a, b):
            continue
        h = np.concatenate([np.sort(a), np.sort(b)])
        doc = np.repeat([0, 1], [len(a), len(b)])
        found = jj.signatures(h, doc, 2, 85, 100)
        keys = [set(found.key[found.owner == i]) for i in (0, 1)]
        assert keys[0] & keys[1]
        # However a text's surplus of units is left out, what it looks up finds the other.
        for i in (0, 1):
            mine = found.owner == i
            reached = 0
            for scheme in (0, 1):
                units = {(u, w, s) for u, w, s in zip(found.unit[mine], found.weight[mine], found.spare[mine], strict=True) if u % 2 == scheme and w}
                spare = max((s for *_, s in units), default=-2)
                dropped, weight = set(), 0
                for u, w, _ in sorted(units, key=lambda x: -sum((found.unit == x[0]) & np.isin(found.key, list(keys[0] & keys[1])))):
                    if weight + w <= spare:
                        dropped.add(u)
                        weight += w
                asks = set(found.key[mine & (found.unit % 2 == scheme) & (found.weight > 0) & ~np.isin(found.unit, list(dropped))])
                reached += bool(asks & keys[1 - i])
            over = (found.spare[mine] < 0).any()
            assert reached or over


def test_drop_keeps_one_of_each_group_and_all_columns(spark):
    kept = jj.drop_near_duplicates(frame(spark))
    assert kept.columns == frame(spark).columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert {203}.issubset(ids) and 204 not in ids and 102 not in ids and 200 in ids


def test_empty(spark):
    assert jj.jaccard_components(empty(spark)).count() == 0


def rows_of(texts, ids=None):
    return [(i if ids is None else ids[i], t, None, None, 0, 0, 0, "", 0) for i, t in enumerate(texts)]


def test_shared_passages_of_every_share_against_brute_force(spark):
    """Texts that share a passage of a twentieth to nearly all of their words, with a large group of near copies among them."""
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(120)]
    texts = []
    for i in range(160):
        share = rng.choice([0.05, 0.3, 0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95])
        own = [f"o{i}w{j}" for j in range(int(120 * (1 - share) / share))][:600]
        cut = rng.randrange(0, len(own) + 1)
        texts.append(" ".join(own[:cut] + passage + own[cut:]))
    for _ in range(60):
        copy = list(passage)
        copy[rng.randrange(120)] = f"c{rng.randrange(9)}"
        texts.append(" ".join(copy))
    for k, num, den in ((1, 80, 100), (4, 85, 100)):
        got = jj.jaccard_components(frame(spark, rows_of(texts)), k=k, num=num, den=den)
        assert sorted((r["id"], r["n"], r["component"]) for r in got.collect()) == brute(list(enumerate(texts)), k, num, den)


def test_links_through_rows_without_or_with_repeated_ids(spark):
    base = [f"w{i}" for i in range(100)]
    chain = [" ".join(f"x{j}" for j in range(s)) + " " + " ".join(base[s:]) for s in (0, 9, 18)]
    assert brute(list(enumerate(chain)), 1, 80, 100) == [(0, 100, 0), (1, 100, 0), (2, 100, 0)]
    got = jj.jaccard_components(frame(spark, rows_of(chain, [1, None, 2])), k=1, num=80, den=100).collect()
    assert sorted(map(tuple, got), key=str) == [(1, 100, 1), (2, 100, 1), (None, 100, 1)]
    got = jj.jaccard_components(frame(spark, rows_of([*chain, "other text"], [5, 7, 5, 5])), k=1, num=80, den=100).collect()
    assert sorted(map(tuple, got)) == [(5, 2, 5), (5, 100, 5), (5, 100, 5), (7, 100, 5)]
    kept = jj.drop_near_duplicates(frame(spark, rows_of([*chain, "other text"], [None, 7, None, None])), k=1, num=80, den=100).collect()
    assert sorted(r["text"] for r in kept) == sorted([chain[1], "other text"])


def test_words_that_collide_under_polynomials_are_not_linked(spark):
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    got = jj.jaccard_components(frame(spark, rows_of([word, word.translate(str.maketrans("ab", "ba"))])), k=4, num=85, den=100)
    assert sorted(map(tuple, got.collect())) == [(0, 1, 0), (1, 1, 1)]


def test_all_joins_shuffled(spark, monkeypatch):
    from minutespark.llm import scratch

    monkeypatch.setattr(scratch, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(jj, "CHUNK", 3)
    rows = [(r[0], r[1]) for r in documents() if r[0] is not None and r[0] != 207]
    got = jj.jaccard_components(frame(spark), k=4, num=85, den=100).where("id is not null and id <> 207")
    assert sorted((r["id"], r["n"], r["component"]) for r in got.collect()) == brute(rows, 4, 85, 100)


def test_texts_that_share_a_passage_make_no_pairs(spark, monkeypatch):
    """Thirty texts of 1,000 words, 860 of them a shared passage (three quarters of all shingles of a pair), and a near copy of one: the buckets
    that they share are looked up once each, and only the link comes through."""
    made = {}
    write = jj.materialize

    def counted(df, name):
        made[name] = write(df, name)
        return made[name]

    monkeypatch.setattr(jj, "materialize", counted)
    monkeypatch.setattr(jj, "discard", lambda *tables: None)
    passage = " ".join(f"p{i}" for i in range(860))
    texts = [passage + " " + " ".join(f"t{t}w{i}" for i in range(140)) for t in range(30)]
    rows = [*enumerate(texts), (30, texts[3] + " more words")]
    found = jj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k=4, num=85, den=100)
    assert {r["id"]: r["component"] for r in found.collect()} == {i: 3 if i == 30 else i for i in range(31)}
    assert made["jaccard-pairs"].count() + made["jaccard-hubs"].count() <= 1
    asked = made["jaccard-asking"]
    assert asked.select("sig", "a").distinct().count() == asked.count()
