import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from minutespark.llm import line_dedup as ld
from minutespark.llm import textkit as tk
from tests.llm.data import SCHEMA, empty, frame

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows, min_docs, min_chars=1, keep_first=False):
    """(text, lines, dropped) of each (id, text)."""
    docs = defaultdict(set)
    for r, (_, text) in enumerate(rows):
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                docs[key(line)].add(r)
    hot = {k for k, found in docs.items() if len(found) >= min_docs}
    first = {}
    if keep_first:
        order = sorted(range(len(rows)), key=lambda r: (rows[r][0] is not None, rows[r][0] or 0, hashlib.md5(f"{'' if rows[r][0] is None else rows[r][0]}\n{rows[r][1] or ''}".encode()).digest()))
        for r in order:
            for i, line in enumerate((rows[r][1] or "").split("\n")):
                first.setdefault(key(line), (rows[r], i))
    out = []
    for row in rows:
        lines = (row[1] or "").split("\n")
        kept = [line for i, line in enumerate(lines) if key(line) not in hot or (keep_first and first[key(line)] == (row, i))]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def run(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, None, None, 0, 0, 0, "", 0) for i, t in rows], SCHEMA)
    return sorted(((r["doc_id"], r["text"] or "", r["n_lines"], r["n_dropped"]) for r in ld.drop_repeated_lines(docs, **options).collect()), key=str)


def expected(rows, *args):
    return sorted(((i, *x) for (i, _), x in zip(rows, brute(rows, *args), strict=True)), key=str)


def random_rows(seed, n):
    rng = random.Random(seed)
    pieces = ["a", "A ", "\tB\r", "é", "É", "  ", "", "\x0b\x0c", "a b", "x" * 300, "X" * 300 + " ", "one line", "One Line\x0c", "\x00", "　z", "😀", "\x1c"]
    rows = [(i, "\n".join(rng.choice(pieces + [f"own {i} {j}"]) for j in range(rng.randrange(0, 9)))) for i in range(n)]
    return rows + [(500, None), (501, ""), (502, "\n"), (502, "\n"), (None, "a\na"), (None, "a\na"), (503, " " * 100_000 + "a"), (504, "\n" * 5000)]


@pytest.mark.parametrize("min_docs,min_chars,keep_first", [(2, 1, False), (10, 1, False), (1, 1, False), (3, 4, True), (2, 1, True)])
def test_against_brute_force(spark, min_docs, min_chars, keep_first):
    rows = random_rows(min_docs, 60)
    assert run(spark, rows, min_docs=min_docs, min_chars=min_chars, keep_first=keep_first) == expected(rows, min_docs, min_chars, keep_first)


def test_small_packs_give_the_same(spark, monkeypatch):
    """Hashes of many packs meet in the filters. (The tasks' own constants stay; the pack is cut by the number of batches.)"""
    rows = random_rows(9, 200)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(13)
    found = {(r["key"], r["n_docs"]) for r in ld.repeated_keys(docs, 4).collect()}
    counts = defaultdict(int)
    for _, text in rows:
        for k in {key(x) for x in (text or "").split("\n")} - {""}:
            counts[k] += 1
    assert found == {(k, n) for k, n in counts.items() if n >= 4}


def test_filters_miss_nothing_and_suspect_few():
    h = tk.mix(np.arange(1, 100_001, dtype=np.uint64))
    bloom = ld.Bloom(len(h))
    bloom.add(h)
    assert bloom.has(h).all()
    assert bloom.has(tk.mix(np.arange(200_000, 300_000, dtype=np.uint64))).mean() < 0.01


def test_packs_are_cut_and_marked():
    import pyarrow as pa

    texts = [f"own {i}\nshared\nshared" for i in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    packs = list(ld._packs(4, 1)(iter([batch])))
    assert sum(len(x) // 8 for p in packs for x in p.column("hashes").to_pylist()) == 51
    found = [h for p in packs for i in range(p.num_rows) for h in ld._suspects(pa.Table.from_batches([p.slice(i, 1)])).column("h").to_pylist()]
    low = np.frombuffer(b"shared", np.uint8)
    assert tk.signed(tk.span_hash(low, np.array([0]), np.array([6])))[0] in found and len(found) < 10


def test_awkward_rows(spark):
    got = ld.with_digest(ld.drop_repeated_lines(frame(spark), 2)).collect()
    assert len(got) == frame(spark).count()
    assert {r["kept_sha256"] for r in got if r["doc_id"] in (200, 201)} == {hashlib.sha256(b"").hexdigest()}
    assert ld.drop_repeated_lines(empty(spark)).count() == 0
    assert ld.repeated_keys(empty(spark)).count() == 0


def test_a_very_long_text():
    data = np.frombuffer(b" Some line of words \n" * 300_000, np.uint8)
    lines = ld.Lines(data, np.array([0, len(data)]))
    h, at = lines.keys(True)
    assert len(lines.doc) == 300_001 and len(at) == 1 and [k.to_pylist() for _, k in lines.text(at)] == [["some line of words"]]
