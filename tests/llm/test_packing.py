import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as hs

from minutespark.llm import packing
from minutespark.llm.queries import tokenizer_path
from tests.llm.data import documents, empty, frame


@given(hs.lists(hs.integers(1, 64), max_size=200), hs.integers(1, 9))
def test_bins_never_overflow_and_have_no_gaps(sizes, most):
    bins, used = packing.OpenBins(64, most, 0), {}
    for size in sizes:
        sequence, offset = bins.place(size)
        assert offset == used.get(sequence, 0)
        used[sequence] = offset + size
        assert used[sequence] <= 64
        assert bins.count <= most
        assert sum(map(len, bins.bins.values())) == bins.count
        assert all(bins.free >> f & 1 for f in bins.bins) and bin(bins.free).count("1") == len(bins.bins)


def test_best_fit_and_fullest_closes_first():
    bins = packing.OpenBins(10, 2, 0)
    assert bins.place(6) == (0, 0)
    assert bins.place(5) == (1, 0)
    assert bins.place(4) == (0, 6)  # the tighter of the two
    assert bins.place(8) == (2, 0)
    assert bins.place(9) == (3, 0)  # closes sequence 2, the fullest
    assert bins.place(5) == (1, 5)


@pytest.mark.parametrize("length", [64, 4096])
def test_pieces_hold_the_tokenizers_ids(spark, length):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    rows = packing.pack_documents(frame(spark), tokenizer_path(), length=length, with_ids=True).collect()
    expected = []
    for i, text, *_ in documents():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        expected += [(i, p, at, ids[at : at + length].tobytes()) for p, at in enumerate(range(0, len(ids), length))]
    key = lambda r: tuple(map(str, r))
    assert sorted(((r["doc_id"], r["piece"], r["start"], bytes(r["ids"])) for r in rows), key=key) == sorted(expected, key=key)
    assert all(r["ids_crc32"] == zlib.crc32(r["ids"]) and r["length"] * 4 == len(r["ids"]) for r in rows)
    filled = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= length


def test_empty(spark):
    assert packing.pack_documents(empty(spark), tokenizer_path()).count() == 0


def plain_best_fit(sizes, length, most):
    """The rule as stated: the open sequence with the least sufficient room; if none, the fullest closes."""
    out, bins, made = [], [], 0
    for size in sizes:
        fitting = [b for b in bins if b[1] >= size]
        if fitting:
            b = min(fitting, key=lambda b: b[1])
        else:
            if len(bins) >= most:
                bins.remove(min(bins, key=lambda b: b[1]))
            b = [made, length]
            bins.append(b)
            made += 1
        out.append(b[1])
        b[1] -= size
        if not b[1]:
            bins.remove(b)
    return out, made


@given(hs.lists(hs.integers(1, 50), max_size=300), hs.integers(1, 12))
def test_placement_against_plain_best_fit(sizes, most):
    """Room found for each piece, and sequences in all; ties between equally full ones change neither."""
    bins = packing.OpenBins(50, most, 0)
    got = [50 - bins.place(s)[1] for s in sizes]
    assert (got, bins.next) == plain_best_fit(sizes, 50, most)


def test_rows_with_a_null_id_are_dealt_to_several_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 50)
    rows = [(None, "same text", None, None, 0, 0, 0, "", 0)] * 400
    got = packing.pack_documents(frame(spark, rows), tokenizer_path(), length=64).collect()
    assert len(got) == 400 and len({r["sequence_id"] >> 36 for r in got}) > 4


def test_table_is_emptied_when_full(monkeypatch):
    from minutespark.llm import textkit as tk

    monkeypatch.setattr(packing, "TABLE_TOKENS", 10)
    tokenizer = packing.WordTokenizer(tokenizer_path())
    for text in ("one two three four five six seven", "one two eight", "", " é ü x y z " * 9):
        data = np.frombuffer(text.encode(), np.uint8)
        ids, cut = tokenizer.ids(data, np.array([0, len(data)]), 1)
        assert ids.tolist() == [*tokenizer.tokenizer.encode(text, add_special_tokens=False).ids, 1] and cut.tolist() == [0, len(ids)]


def test_thue_morse_words_differ():
    """Strings that collide under every polynomial modulo 2**64."""
    from minutespark.llm import textkit as tk

    for n in (3, 7, 8, 11):
        word = "a"
        for _ in range(n):
            word += word.translate(str.maketrans("ab", "ba"))
        other = word.translate(str.maketrans("ab", "ba"))
        buf = np.frombuffer(f"{word} {other} {word}".encode(), np.uint8)
        h, _ = tk.word_hashes(buf, np.array([0, len(buf)]))
        assert h[0] == h[2] != h[1]
