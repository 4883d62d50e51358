import bisect
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from minutespark.llm import token_align as ta
from minutespark.llm.queries import tokenizer_path
from tests.llm.data import SCHEMA, empty, frame

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def one(plain, text):
    """(ids of A, ids of B, groups), or None; whole texts, token by token."""
    if not text:
        return None
    a, b = plain[0].encode(" " + text, add_special_tokens=False).ids, plain[1].encode(text)
    known = ta.Tokenizers.of(A, B).bytes_a
    pieces = [plain[1].id_to_piece(i) for i in b]
    own = [known[i] for i in a], [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in pieces]
    if any(b"".join(x) != (" " + text).encode() for x in own):
        return None
    ends = [np.cumsum([len(x) for x in side]).tolist() for side in own]
    cuts = sorted(set(ends[0]) & set(ends[1]))
    groups = [([], []) for _ in cuts]
    for side, ids in enumerate((a, b)):
        for i, end in zip(ids, ends[side], strict=True):
            groups[bisect.bisect_left(cuts, end)][side].append(i)
    return a, b, groups


def brute(plain, rows):
    found = [one(plain, t) for _, t in rows]
    counts, highest = Counter(), defaultdict(int)
    for f in found:
        counts.update({(x, y) for ga, gb in f[2] for x in ga for y in gb} if f else ())
    for (x, _), n in counts.items():
        highest[x] = max(highest[x], n)
    out = []
    for (i, _), f in zip(rows, found, strict=True):
        if not f:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(x, y) for ga, gb in f[2] for x in ga for y in gb]
        groups = ";".join("|".join(",".join(map(str, side)) for side in g) for g in f[2])
        out.append((i, len(f[0]), len(f[1]), len(f[2]), len(links), sum(counts[x] == highest[x[0]] for x in links), sum(counts[x] for x in links), hashlib.sha256(groups.encode()).hexdigest()))
    return sorted(out, key=str)


def random_rows(seed, n):
    rng = random.Random(seed)
    pieces = ["a", "the", "  ", " ", "\n", "\t", "é", "▁", "<s>", "</s>", "<|endoftext|>", "'s", "😀", "\xa0", "　", " ", "0x", "123", "4567", "क्", "ß", "\x1c", "\x00", "don't", "http://x.y", "zzzz", "́", "ﬁ", "\x85", "中文", "한국", "...", "internationalization"]
    return [(i, "".join(rng.choice(pieces) + rng.choice(["", " ", ""]) for _ in range(rng.randrange(0, 30)))) for i in range(n)]


def test_against_whole_texts(spark, plain):
    rows = [*random_rows(5, 1500), (9000, None), (9001, ""), (9001, " "), (9002, "x" * 5000), (9003, " " * 5000), (9004, "ab " * 3000), (None, "no id"), (None, "no id")]
    docs = spark.createDataFrame([(i, t, None, None, 0, 0, 0, "", 0) for i, t in rows], SCHEMA).repartition(5)
    assert sorted(map(tuple, ta.with_digest(ta.align(docs, A, B)).collect()), key=str) == brute(plain, rows)


def test_pair_counts(spark, plain):
    rows = random_rows(6, 200)
    counts = Counter()
    for _, t in rows:
        f = one(plain, t)
        counts.update({(x, y) for ga, gb in f[2] for x in ga for y in gb} if f else ())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["a_id"], r["b_id"]): r["n_docs"] for r in ta.pair_counts(docs, A, B).collect()} == dict(counts)


def test_groups_in_full(spark, plain):
    docs = spark.createDataFrame([(1, "Étude of tokens")], "doc_id long, text string")
    f = one(plain, "Étude of tokens")
    assert ta.align(docs, A, B, with_groups=True).first()["groups"] == ";".join("|".join(",".join(map(str, side)) for side in g) for g in f[2])


def test_jumping_finds_groups_of_any_length():
    """Long chains of overlaps: boundaries of tokens of 2 and 3 bytes meet every 6 bytes, offset ones only at the end."""
    a, b = np.arange(2, 601, 2), np.arange(3, 601, 3)
    last = ta.farthest(a, b)
    assert np.array_equal(last[: len(a)], len(a) + np.repeat(np.arange(1, 201, 2), 3)) and len(set(last.tolist())) == 100
    b = np.append(np.arange(1, 600, 2), 600)
    assert set(ta.farthest(a, b).tolist()) == {len(a) + len(b) - 1}
    assert len(ta.farthest(np.zeros(0, int), np.zeros(0, int))) == 0


def test_chunks_encode_like_whole_texts(plain):
    known = ta.Tokenizers.of(A, B)
    assert known.fast is not None
    for _, text in random_rows(7, 300):
        if text:
            assert list(known.fast.encode_ordinary(" " + text)) == plain[0].encode(" " + text, add_special_tokens=False).ids


def test_awkward_rows(spark):
    assert ta.align(frame(spark), A, B).count() == frame(spark).count()
    assert ta.align(empty(spark), A, B).count() == 0
