import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from minutespark.llm import ctw
from tests.llm.data import SCHEMA, documents, empty, frame


def node_counts(texts):
    """(context bytes, bit prefix) -> [zeros, ones] for contexts of 0, 1 and 2 bytes."""
    counts = {}
    for t in texts:
        line = b"\0\0" + t + b"\xff"
        for i in range(2, len(line)):
            bits = format(line[i], "08b")
            for d in range(3):
                for k in range(8):
                    counts.setdefault((line[i - d : i], bits[:k]), [0, 0])[int(bits[k])] += 1
    return counts


def kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)


def brute_scores(train, texts):
    counts = node_counts(train)
    kids = {}
    for context, prefix in counts:
        if context:
            kids.setdefault((context[1:], prefix), set()).add((context, prefix))

    weights: dict = {}

    def weighted(node):
        if node not in weights:
            own = kt(*counts[node])
            if len(node[0]) == 2:
                weights[node] = (own, 0.0)
            else:
                mine, below = own + math.log(0.5), sum(weighted(c) for c in sorted(kids[node])) + math.log(0.5)
                whole = max(mine, below) + math.log1p(math.exp(-abs(mine - below)))
                weights[node] = (whole, math.exp(mine - whole))
        return weights[node][0]

    def predict(context, prefix, d=0):
        node = (context[len(context) - d :], prefix)
        a, b = counts.get(node, (0, 0))
        own = (b + 0.5) / (a + b + 1)
        deeper = (context[len(context) - d - 1 :], prefix)
        if d == 2 or deeper not in counts:
            return own
        weighted(node)
        beta = weights[node][1]
        return beta * own + (1 - beta) * predict(context, prefix, d + 1)

    out = []
    for t in texts:
        line, total = b"\0\0" + t + b"\xff", 0.0
        for i in range(2, len(line)):
            bits = format(line[i], "08b")
            for k in range(8):
                p = predict(line[i - 2 : i], bits[:k])
                total += math.log10(p if bits[k] == "1" else 1 - p)
        out.append(total)
    return out


def test_code_lengths_against_the_recursive_definition(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abac é") for _ in range(rng.randrange(0, 40))) for _ in range(40)]
    rows = [(i, t, None, None, 0, 0, 0, "", 0) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in ctw.score_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    train = [t.encode() for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10]
    expected = brute_scores(train, [t.encode() for t in texts])
    for i, e in enumerate(expected):
        assert got[i]["score"] == pytest.approx(e, rel=1e-4)
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 10 == 0)


@pytest.mark.parametrize("frequent", [0, 50, 500_000])
def test_base_is_the_same_however_many_words_are_sent(spark, frequent):
    rows = [r for r in documents() if r[0] is not None]
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    tokens = [(i, [*(t or "").encode().translate(low).split(), None]) for i, t, *_ in rows]
    count = Counter(w for i, ws in tokens if zlib.crc32(str(i).encode()) % 10 for w in ws)
    total, distinct = sum(count.values()), len(count)
    got = {r["doc_id"]: r for r in ctw.score_texts(frame(spark, rows), frequent=frequent).collect()}
    for i, ws in tokens:
        base = sum(math.log10((count[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in ws)
        assert got[i]["base_score"] == pytest.approx(base, rel=1e-9)
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(ws), sum(count[w] > 0 for w in ws), total)


def test_symbol_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 24, 3000))
    index, table = ctw.solve(keys, rng.integers(1, 9, len(keys)))
    assert np.allclose((10.0 ** table.astype(np.float64)).sum(1), 1, atol=1e-4)
    assert index.max() < len(table)


def test_text_like_the_corpus_costs_less_than_noise(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["the", "other", "thing", "and"]) for _ in range(60)), None, None, 0, 0, 0, "", 0) for i in range(80)]
    rows.append((1000, "".join(rng.choice("qzxjkvw0987") for _ in range(300)), None, None, 0, 0, 0, "", 0))
    got = {r["doc_id"]: r["bits_per_byte"] for r in ctw.score_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1000] > 2 * max(v for k, v in got.items() if k != 1000)


def test_awkward_rows(spark):
    assert ctw.score_texts(frame(spark)).count() == frame(spark).count()
    assert ctw.score_texts(empty(spark)).count() == 0


def deep_scores(train, texts, depth):
    """The recursive definition, for contexts of up to ``depth`` bytes."""
    counts, kids, weights = {}, {}, {}
    pad = b"\0" * depth
    for t in train:
        line = pad + t + b"\xff"
        for i in range(depth, len(line)):
            bits = format(line[i], "08b")
            for d in range(depth + 1):
                for k in range(8):
                    counts.setdefault((line[i - d : i], bits[:k]), [0, 0])[int(bits[k])] += 1
    for context, prefix in counts:
        if context:
            kids.setdefault((context[1:], prefix), []).append((context, prefix))

    def weighted(node):
        if node not in weights:
            own = kt(*counts[node])
            if len(node[0]) == depth:
                weights[node] = (own, 1.0)
            else:
                mine, below = own + math.log(0.5), sum(weighted(c) for c in kids[node]) + math.log(0.5)
                whole = max(mine, below) + math.log1p(math.exp(-abs(mine - below)))
                weights[node] = (whole, math.exp(mine - whole))
        return weights[node][0]

    def predict(context, prefix, d=0):
        node = (context[len(context) - d :], prefix)
        a, b = counts.get(node, (0, 0))
        own = (b + 0.5) / (a + b + 1)
        if d == depth or (context[len(context) - d - 1 :], prefix) not in counts:
            return own
        weighted(node)
        return weights[node][1] * own + (1 - weights[node][1]) * predict(context, prefix, d + 1)

    out = []
    for t in texts:
        line, total = pad + t + b"\xff", 0.0
        for i in range(depth, len(line)):
            bits = format(line[i], "08b")
            for k in range(8):
                p = predict(line[i - depth : i], bits[:k])
                total += math.log10(p if bits[k] == "1" else 1 - p)
        out.append(total)
    return out


def test_deep_tree_against_the_recursive_definition(spark, monkeypatch):
    """Several blocks and buckets, contexts of five bytes; held-out texts have grams of their own."""
    monkeypatch.setattr(ctw, "BLOCKS", 3)
    rng = random.Random(5)
    texts = ["".join(rng.choice(["ab", "abc", " é", "d"]) for _ in range(rng.randrange(0, 25))) + ("xyz" if zlib.crc32(str(i).encode()) % 10 == 0 else "") for i in range(50)]
    rows = [(i, t, None, None, 0, 0, 0, "", 0) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["score"] for r in ctw.score_texts(spark.createDataFrame(rows, SCHEMA), depth=ctw.DEPTH).collect()}
    train = [t.encode() for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10]
    for i, e in enumerate(deep_scores(train, [t.encode() for t in texts], ctw.DEPTH)):
        assert got[i] == pytest.approx(e, rel=1e-5)
