"""Queries that SQL cannot state, over the smallest tables, against plain Python over the same rows."""

import hashlib
import hmac
import os
import re
from collections import Counter
from difflib import SequenceMatcher

import pyarrow.parquet as pq
import pytest

from minutespark.operators import search, state
from minutespark.operators import segments as seg
from minutespark.plans import catalog
from tests.test_segments import plain_dedupe

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def table(name):
    return pq.read_table(f"{FOLDER}/{name}.parquet").to_pylist()


def found(spark, name, *columns):
    return [tuple(r[c] for c in columns) for r in catalog.QUERIES[name](spark, FOLDER).collect()]


def conversations():
    out = {}
    for r in sorted(table("conversations"), key=lambda r: (r["conv_id"], r["turn"])):
        out.setdefault(r["conv_id"], []).append((r["turn"], r["text"]))
    return out


def micros(t):
    return (t - t.__class__(1970, 1, 1)).total_seconds()


def test_seg9_rollup_dedupe(spark):
    expected = []
    for r in table("documents"):
        words = re.sub(r"\s+", " ", r["text"] or "").split(" ")
        cues = [(float(i), i + 1.0, " ".join(words[i * 6 : i * 6 + 12])) for i in range(len(words) // 6 + 1)]
        expected += [(r["doc_id"], i, *s) for i, s in enumerate(plain_dedupe(cues))]
    assert sorted(found(spark, "seg9_rollup_dedupe", "doc_id", "pos", "start", "end", "text")) == sorted(expected)


def test_win11_word_groups_and_stm11_throttle(spark):
    events = sorted(table("events"), key=lambda r: (r["user_id"], r["event_id"]))
    groups, current = [], None
    for r in events:
        if r["event_type"] == "error":
            s = micros(r["ts"])
            if current is None or current[0] != r["user_id"] or s - current[2] > 86_400:
                number = current[1] + 1 if current is not None and current[0] == r["user_id"] else 0
                current = [r["user_id"], number, s, []]
                groups.append(current)
            current[3].append(str(r["event_id"]))
    assert sorted(found(spark, "win11_word_groups", "user_id", "group", "start", "text")) == sorted((u, n, s, " ".join(w)) for u, n, s, w in groups)
    passed, last = [], {}
    for r in sorted(events, key=lambda r: (micros(r["ts"]), r["event_id"])):
        if r["user_id"] not in last or micros(r["ts"]) - last[r["user_id"]] >= 3 * 3600:
            last[r["user_id"]] = micros(r["ts"])
            passed.append((r["user_id"], r["event_id"]))
    assert sorted(found(spark, "stm11_throttle", "user_id", "event_id")) == sorted(passed)


def test_stm2_result_transitions(spark):
    jobs = {}
    for r in sorted(table("events"), key=lambda r: (micros(r["ts"]), r["event_id"])):
        s = jobs.setdefault(r["user_id"], {"total": 300, "done": 0, "consecutive": 0, "retries": 0, "priority": r["user_id"] % 20, "status": "queued", "next": None})
        jobs[r["user_id"]] = state.transition(s, r["value"] < 15, micros(r["ts"]))
    assert sorted(found(spark, "stm2_result_transitions", "job", "done", "consecutive", "retries", "status")) == sorted((j, s["done"], s["consecutive"], s["retries"], s["status"]) for j, s in jobs.items())


def test_seg12_shouting(spark):
    expected = []
    for conv, turns in conversations().items():
        texts = [t.upper() if conv % 2 == 0 else t for _, t in turns]
        letters = [c for t in texts for c in t if c.isalpha()]
        if len(letters) >= 40 and sum(c.islower() for c in letters) <= 0.02 * len(letters):
            texts = [re.sub(r"\bi\b", "I", re.sub(r"(^|\n|[.!?]\s+)(\w)", lambda m: m[1] + m[2].upper(), t.lower())) for t in texts]
        expected += [(conv, n, hashlib.md5(t.encode()).hexdigest()) for (n, _), t in zip(turns, texts, strict=True)]
    assert sorted(found(spark, "seg12_shouting", "conv_id", "turn", "text_md5")) == sorted(expected)


def test_seg13_garbled(spark):
    common = set(seg.COMMON_SHORT)

    def garbled(text):
        sample = " ".join(text[len(text) * q // 4 :][:1000] for q in range(4))
        words = [w for w in re.findall("[A-Za-z0-9']+", sample) if re.search("[A-Za-z]", w)]
        return len(words) >= 40 and sum(len(w) <= 2 and w.lower() not in common for w in words) / len(words) > 0.06

    assert sorted(found(spark, "seg13_garbled", "doc_id", "garbled")) == sorted((r["doc_id"], garbled(r["text"] or "")) for r in table("documents"))


def test_repetition_runs_and_ratio(spark):
    runs, ratios = [], {}
    for conv, turns in conversations().items():
        texts = [re.sub(r"\s+", " ", t).strip(" ").lower() for _, t in turns]
        last = None
        for (n, _), text, before in zip(turns, texts, [None, *texts], strict=False):
            same = bool(before) and bool(text) and SequenceMatcher(None, before, text).ratio() >= seg.SIMILAR
            if not same:
                last = [conv, 0, n * 10.0]
                runs.append(last)
            last[1] += 1
        words = [t.split(" ") for t in texts]
        laps = [any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b), 40) + 1)) for a, b in zip(words, words[1:])]
        if laps:
            ratios[conv] = round(sum(laps) / len(laps), 4)
    assert Counter(found(spark, "win9_repetition_runs", "conv_id", "n", "start")) == Counter(map(tuple, runs))
    assert dict(found(spark, "win8_rollup_ratio", "conv_id", "ratio")) == ratios


def test_str30_signed_token(spark):
    expected = {(c, hmac.new(b"key", str(c).encode(), "sha256").hexdigest()[:32]) for c in conversations()}
    assert set(found(spark, "str30_signed_token", "conv_id", "token")) == expected


def test_seg4_merge_chunks(spark):
    """Chunks of four turns that begin with the last turn of the one before: what a seam repeats is dropped before it."""
    expected = []
    for conv, turns in conversations().items():
        chunks = {}
        for n, text in turns:
            chunks.setdefault(n // 4, []).append((n, text))
            if n % 4 == 3:
                chunks.setdefault(n // 4 + 1, []).append((n, text))
        kept = []
        for c in sorted(chunks):
            rows = sorted(chunks[c])
            if kept:
                n = seg.overlapping_segments([t for _, t in kept[-1]], [t for _, t in rows])
                kept[-1] = kept[-1][: len(kept[-1]) - n]
            kept.append(rows)
        expected += [(conv, n) for rows in kept for n, _ in rows]
    assert Counter(found(spark, "seg4_merge_chunks", "conv_id", "turn")) == Counter(expected)


def test_seg8_audit_pages_what_is_not_flagged(spark):
    flags = dict(found(spark, "seg5_hallucination", "conv_id", "flagged"))
    labelled = {r["doc_id"] for r in table("labels")}
    clean = sorted(c for c, f in flags.items() if not f)[20:40]
    expected = {(c, flags[c], "transcription" if c in labelled else "import") for c in [*clean, *(c for c, f in flags.items() if f)]}
    assert set(found(spark, "seg8_audit", "conv_id", "flagged", "produced_by")) == expected
