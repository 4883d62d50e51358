import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np

from minutespark.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, n_convs long, name string, depth int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sequences(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(turns)] for c, turns in convs.items()}


def rebuilt(convs):
    out = {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + convs[c][h:]
    return out


def brute(convs):
    nodes = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(q[: len(p)] == p and len(q) > len(p) for q in below)]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in below if p)
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(path))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


def collected(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def deep_rows(seed, n, depth, words=2):
    """Conversations that branch at any depth: copies of others' beginnings go on in their own way."""
    rng = random.Random(seed)
    convs = []
    for _ in range(n):
        start = rng.choice(convs)[: rng.randrange(0, depth)] if convs and rng.random() < 0.8 else []
        convs.append(start + [(rng.choice("ua"), "w" * rng.randrange(1, words + 2)) for _ in range(rng.randrange(0, depth - len(start) + 1))])
    convs += convs[:5]
    return [(c * 7, t, role, text) for c, turns in enumerate(convs) for t, (role, text) in enumerate(turns)]


def test_deep_tries_against_enumeration(spark):
    for seed, depth in ((1, 7), (2, 8), (3, 33)):
        rows = deep_rows(seed, 40, depth)
        assert collected(pt.prefix_trie(pt.conversations(frame(spark, rows)))) == brute(sequences(rows))


def test_shared_starts_against_enumeration(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None, "é😀"])) for c in [*range(0, 12), *range(100, 107), *range(203, 215), 100_000] for t in range(rng.randrange(1, 9))]
    rows += [(300, 0, "user", "only one"), (301, 0, "user", "x"), (302, None, "user", "null turn"), (302, 0, "user", "x"), (None, 0, "user", "no conversation"), (3, 1, "user", "tie"), (3, 1, "user", "tie"), (3, 1, None, None)]
    convs = rebuilt(sequences(rows))
    assert any(not turns for turns in convs.values())  # turnless ones end at the root
    assert collected(pt.prefix_trie(*pt.shared_starts(frame(spark, rows)))) == brute(convs)


def test_one_hot_conversation(spark):
    """A thousand copies end at one node, over several runs of ids."""
    rows = [(c * 50, t, "user", "hello" * t) for c in range(1000) for t in range(3)] + [(7, 0, "user", "")]
    assert collected(pt.prefix_trie(pt.conversations(frame(spark, rows)))) == brute(sequences(rows))


def test_no_conversations_and_only_nulls(spark):
    assert pt.prefix_trie(*pt.shared_starts(frame(spark, []))).count() == 0
    assert pt.prefix_trie(pt.conversations(frame(spark, [(None, 1, "user", "x")]))).count() == 0


def test_names_are_those_of_prefixes():
    """Equal prefixes have equal names whatever follows, different ones different names."""
    rng = np.random.default_rng(1)
    known = {}
    for _ in range(300):
        turns = rng.integers(0, 2, rng.integers(1, 20))
        prints = np.stack([turns, turns], 1).astype(np.uint64)
        names = pt.prefix_names(np.concatenate([prints, prints[:3]]), np.array([len(prints), len(prints[:3])]))
        for d in range(len(turns)):
            assert known.setdefault(tuple(turns[: d + 1]), tuple(names[d])) == tuple(names[d])
        assert np.array_equal(names[len(prints) :], names[: len(prints[:3])])
    assert len(set(known.values())) == len(known)


def test_a_very_long_conversation(spark):
    rows = [(c, t, "user", str(t)) for c in (1, 2) for t in range(3000)] + [(2, 3000, "user", "end")]
    got = {r["depth"]: r for r in pt.prefix_trie(pt.conversations(frame(spark, rows))).collect()}
    assert len(got) == 3002 and got[0]["saved_tokens"] == sum(len(str(t)) for t in range(3000)) and got[2000]["n_leaves"] == 1
