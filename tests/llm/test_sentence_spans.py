import random
import re

import numpy as np

from minutespark.llm import sentence_spans as ss
from tests.llm.data import SCHEMA, empty, frame


def split(text):
    """(start, end, words) of the sentences, by a splitter of its own: word by word."""
    out, words, at = [], [], None
    for m in re.finditer(r"[^\x20\x09-\x0D。！？]*[。！？]|[^\x20\x09-\x0D]+|\n", text):
        if m[0] == "\n":
            done = bool(words)
        else:
            at = m.start() if not words else at
            words.append("".join(c.lower() if c.isascii() else c for c in m[0]))
            end = m.end()
            done = re.search(r"[.!?。！？؟۔।॥][\"')\]}]{0,3}$", m[0]) is not None
        if done:
            out.append((at, end, tuple(words)))
            words = []
    return [*out, (at, end, tuple(words))] if words else out


def brute(texts, run_length=3, pair=20):
    seen, out = {}, []
    for i, t in enumerate(texts):
        t = t or ""
        found = split(t)
        gone = set()
        for p in range(len(found)):
            for n in {2, run_length}:
                run = tuple(s[2] for s in found[p : p + n])
                if len(run) < n or (n < run_length and sum(map(len, run)) < pair):
                    continue
                if seen.setdefault(run, (i, p)) != (i, p):
                    gone |= set(range(p, p + n))
        kept, at = "", 0
        for n, s in enumerate(found):
            kept += t[at : s[0]] if n == 0 else ""
            after = found[n + 1][0] if n + 1 < len(found) else len(t)
            kept += "" if n in gone else t[s[0] : after]
        out.append((len(found), len(gone), kept if gone else t))
    return out


def run(spark, texts, **options):
    rows = [(i, t, None, None, 0, 0, 0, "", 0) for i, t in enumerate(texts)]
    return ss.remove_repeated_runs(spark.createDataFrame(rows, SCHEMA), **options).orderBy("doc_id").collect()


def test_against_brute_force(spark):
    a = "The first sentence has six words. The second one has several more words in it! And a third? "
    b = "Other text begins here and goes on. It stops after a few words more.\nA line alone stands here. "
    long_pair = " ".join(f"w{i}" for i in range(20)) + '." ' + " ".join(f"v{i}" for i in range(15)) + ".) "
    texts = [a + b, "Something new comes first. " + a, b.upper(), a + a, "Yes. No. Yes. No. Yes. No. ", None, "", "é" * 9, b.replace(" ", "  ") + "tail", long_pair, "New. " + long_pair + "End."]
    got = run(spark, texts)
    assert [(r["n_sentences"], r["n_removed"], r["text"] or "") for r in got] == brute(texts)
    assert got[2]["spans"][0]["first_docs"] == [0] and got[10]["n_removed"] == 2
    assert {r["doc_id"] for r in run(spark, texts, only_changed=True)} == {i for i, x in enumerate(brute(texts)) if x[1]}


def test_random_texts_against_brute_force(spark):
    rng = random.Random(3)
    pieces = ["Yes.", "No!", "a b c?", "line\n", "\n\n\n", "x y。z！", "说了。", "He said \"no.\"", "ok", "é😀 tail.", "  ", "क ख।", "A. B. C."]
    texts = [rng.choice(["", " "]).join(rng.choice(pieces) + rng.choice([" ", "\n", "\t"]) for _ in range(rng.randrange(0, 14))) for _ in range(150)]
    got = run(spark, texts)
    assert [(r["n_sentences"], r["n_removed"], r["text"] or "") for r in got] == brute(texts)
    for r, t in zip(got, texts, strict=True):
        found = split(t)
        assert all(s["start"] == found[s["first"]][0] and s["end"] == found[s["last"]][1] for s in r["spans"])


def test_kept_text_is_the_input_without_the_spans(spark):
    given = "One two three. Four five six. Seven eight nine.\n"
    texts = [given, "Before it.\n\n\n" + given + "\nKeep this.\n\n\nAnd this."]
    assert run(spark, texts)[1]["text"] == "Before it.\n\n\nKeep this.\n\n\nAnd this."


def test_short_sentences_count(spark):
    """Lines of one word, and of a script without spaces."""
    texts = [x for x in ("a\nb\nc\nd\n", "x\nb\nc\nd\ny\n", "一二。三四。五六。", "七。一二。三四。五六。八。", "a\nb\n", "a\nb\n")]
    assert [r["n_removed"] for r in run(spark, texts)] == [0, 3, 0, 3, 0, 0]


def test_awkward_rows(spark):
    got = ss.remove_repeated_runs(frame(spark)).collect()
    assert len(got) == frame(spark).count()
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[101]["n_removed"] > 0 and by_id[102]["n_removed"] > 0
    assert ss.remove_repeated_runs(empty(spark)).count() == 0


def test_rows_without_ids_keep_one_copy(spark):
    rows = [(None, "One two. Three four. Five six.", None, None, 0, 0, 0, "", 0)] * 20
    got = ss.remove_repeated_runs(frame(spark, rows)).collect()
    assert sorted(r["n_removed"] for r in got) == [0] + [3] * 19


def test_a_very_long_text():
    data = b"Word one. Word two. Word three. " * 200_000
    found = ss.Sentences(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert len(found.start) == 600_000
