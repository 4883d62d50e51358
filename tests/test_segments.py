import random
import re

from pyspark.sql import functions as F

from minutespark.operators import segments as seg
from minutespark.sources import captions

ROW = "conv_id long, turn long, start double, end double, text string"


def rows(spark, texts, key=1, step=10.0, length=8.0):
    return spark.createDataFrame([(key, i, i * step, i * step + length, t) for i, t in enumerate(texts)], ROW)


def flags(spark, texts, **how):
    return seg.hallucination_flags(rows(spark, texts, **how), "conv_id", "turn").first()


def test_hallucination_rules(spark):
    rng = random.Random(1)
    talk = [" ".join("".join(rng.choice("abcdefghijklmno") for _ in range(6)) for _ in range(8)) for _ in range(30)]
    assert not flags(spark, talk)["flagged"]
    assert flags(spark, talk + ["thank you for watching"] * 12)["run_rule"]
    assert flags(spark, talk[:5] + ["thank you for watching"] * 6 + talk[5:], step=2.0, length=2.0)["run_rule"]
    assert not flags(spark, talk + ["thank you for watching"] * 6, length=1.0)["run_rule"]
    assert flags(spark, ["a b c", "thanks all", "thanks all", "thanks all", "d e f"])["share_rule"]
    assert flags(spark, [*talk, "no" + "o" * 10])["char_rule"]
    assert flags(spark, ["Привет всем участникам собрания", "и добрый вечер нашим гостям"])["script_rule"]
    assert not flags(spark, ["yes", "yes"])["flagged"]


def test_runs_have_the_length_of_the_input(spark):
    rng = random.Random(0)
    texts = [rng.choice(["aaaa bbbb", "aaaa bbbc", "zzz", ""]) for _ in range(60)]
    runs = seg.repetition_runs(rows(spark, texts), "conv_id", "turn").orderBy("run").collect()
    assert sum(r["n"] for r in runs) == 60


def test_seams(spark):
    words = "one two three four five six seven eight nine ten".split()
    assert seg.overlapping_segments(["before this", " ".join(words)], [" ".join(words)]) == 1
    assert seg.overlapping_segments(["nothing here at all that would match"], ["a different text of other words"]) == 0
    data = [(1, 0, 0, 0.0, 1.0, "opening words of the very long evening session."), (1, 0, 1, 1.0, 2.0, " ".join(words)), (1, 1, 0, 1.0, 2.0, " ".join(words)), (1, 1, 1, 2.0, 3.0, "then")]
    # The largest overlap above the ratio reaches into the segment before, which goes too.
    merged = seg.merge_chunks(spark.createDataFrame(data, "job long, chunk long, pos long, start double, end double, text string"), "job", "chunk", "pos")
    assert [r["text"] for r in merged.orderBy("chunk", "pos").collect()] == [" ".join(words), "then"]


CUE = "conv_id long, turn long, start double, end double, text string"


def deduped(spark, cues, track=1):
    data = [(track, i, *c) for i, c in enumerate(cues)]
    return [(r["start"], r["end"], r["text"]) for r in seg.dedupe_rollup_tracks(spark.createDataFrame(data, CUE), "conv_id", "turn").orderBy("pos").collect()]


def plain_lap(tail, head):
    return max((k for k in range(1, min(len(tail), len(head)) + 1) if tail[-k:] == head[:k]), default=0)


def test_lap_is_the_longest_common_end_and_head():
    rng = random.Random(2)
    for _ in range(3000):
        tail, head = ([rng.choice("ab") for _ in range(rng.randrange(0, 9))] for _ in range(2))
        assert seg.lap(tail, head) == plain_lap(tail, head), (tail, head)


def plain_dedupe(cues):
    """The rules as SURVEY A15 has them, over a whole track at once."""
    strip = lambda ws: [w.casefold().replace("»", ">>").rstrip(".,;:!?\"')]") for w in ws]
    texts = [re.sub("<[^>]*>", "", t or "") for _, _, t in cues]
    lines = [(s, e, x.split(), i == n - 1) for (s, e, _), t in zip(cues, texts) for n in [len([x for x in t.split("\n") if x.strip()])] for i, x in enumerate(x for x in t.split("\n") if x.strip())]
    pairs = [(strip(a[2]), strip(b[2])) for a, b in zip(lines, lines[1:])]
    hits = sum(len(" ".join(b[: plain_lap(a, b)])) >= 4 for a, b in pairs)
    if len(pairs) < 2 or hits / len(pairs) < 0.2:
        return [(s, e, t) for (s, e, _), t in zip(cues, texts)]
    segments, context, is_open = [], [], False
    for s, e, words, last in lines:
        k = plain_lap(strip(context), strip(words))
        context = (context + words[k:])[-40:]
        if k == len(words):
            if segments:
                own = segments[-1]
                own[1] = max(own[1], e) if last else own[1]
                if strip(own[2][-k:]) == strip(words) and len(" ".join(words)) > len(" ".join(own[2][-k:])):
                    own[2][-k:] = words
                is_open = is_open and not re.search(r"[.!?][\"')\]]*$", " ".join(own[2]))
            continue
        if k == 0 or not is_open:
            segments.append([s, e, []])
        segments[-1][2] += words[k:]
        segments[-1][1] = max(segments[-1][1], e)
        text = " ".join(segments[-1][2])
        is_open = not re.search(r"[.!?][\"')\]]*$", text) and len(text) < 240
    return [(s, max(s, e), " ".join(w)) for s, e, w in segments]


def test_rollup_captions(spark):
    words = [f"word{i}" for i in range(60)]
    words[19] += "."
    rolling = [(float(i), i + 1.0, " ".join(words[i * 4 : i * 4 + 8])) for i in range(14)]
    out = deduped(spark, rolling)
    assert " ".join(t for _, _, t in out).split() == words
    assert out[0][2].endswith("word19.") and all(e >= s for s, e, _ in out)
    plain = [(0.0, 1.0, "<i>a</i> line"), (1.0, 2.0, "another thing"), (2.0, 3.0, "a third one")]
    assert deduped(spark, plain) == [(0.0, 1.0, "a line"), (1.0, 2.0, "another thing"), (2.0, 3.0, "a third one")]


def test_a_resettled_line_completes_the_last_word(spark):
    """A stub, then the same with its full stop, which also ends the segment."""
    cues = [(0.0, 1.0, "PLEASE STAND FOR"), (1.0, 2.0, "STAND FOR A MOMENT OF"), (2.0, 3.0, "MOMENT OF REFLECTION"), (3.0, 4.0, "REFLECTION."), (4.0, 5.0, "REFLECTION. Thank you"), (5.0, 4.5, "Thank you all")]
    assert deduped(spark, cues) == [(0.0, 4.0, "PLEASE STAND FOR A MOMENT OF REFLECTION."), (4.0, 5.0, "Thank you all")] == plain_dedupe(cues)


def test_random_rollups_against_the_rules(spark):
    rng = random.Random(6)
    tracks, expected = [], {}
    for track in range(60):
        said = [rng.choice(["a", "bb.", "ccc", "»", "dd,", "E!", "ff"]) + rng.choice(["", "", str(rng.randrange(3))]) for _ in range(80)]
        step, width = rng.choice([(2, 4), (3, 3), (4, 8), (1, 3)])
        cues = [(float(i), i + rng.choice([-0.5, 1.0]), rng.choice(["", "\n", "<b>"]).join([" ".join(said[i * step : i * step + width]), rng.choice(["", "", " x\ny"])])) for i in range(12)]
        tracks += [(track, i, *c) for i, c in enumerate(cues)]
        expected[track] = plain_dedupe(cues)
    got = {}
    for r in seg.dedupe_rollup_tracks(spark.createDataFrame(tracks, CUE), "conv_id", "turn").orderBy("conv_id", "pos").collect():
        got.setdefault(r["conv_id"], []).append((r["start"], r["end"], r["text"]))
    assert got == {k: v for k, v in expected.items() if v}


def test_next_larger_start_against_brute_force(spark):
    rng = random.Random(1)
    data = [(k, i, float(rng.randrange(6)) if rng.random() < 0.9 else None) for k in (1, 2, None) for i in range(60)]
    got = {(r["k"], r["o"]): r["f"] for r in seg.next_larger_start(spark.createDataFrame(data, "k long, o long, s double"), "k", "o", "s", "f").collect()}
    for k, o, s in data:
        later = [x for kk, oo, x in data if kk == k and oo > o and x is not None and s is not None and x > s]
        assert got[k, o] == (later[0] if later else None)


def test_labels_are_split_into_the_fewest_words(spark):
    vocabulary = spark.createDataFrame([(w,) for w in ("a", "ab", "abc", "c", "cd", "d", "b")], "w string")
    labels = spark.createDataFrame([(1, "abcd"), (2, "abx"), (3, ""), (4, None), (5, "aab")], "id long, label string")
    assert {r["id"]: r["parts"] for r in seg.segment_words(labels, vocabulary, "label", "w").collect()} == {1: ["ab", "cd"], 2: None, 3: None, 4: None, 5: ["a", "ab"]}


def test_seam_words_against_the_rule():
    from difflib import SequenceMatcher

    rng = random.Random(8)
    for _ in range(60):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randrange(0, 40))] for _ in range(2))
        b[: rng.randrange(0, 12)] = a[-rng.randrange(1, 14) :]
        rule = next((n for n in range(min(len(a), len(b), 160), 5, -1) if SequenceMatcher(None, a[-n:], b[:n], autojunk=False).ratio() >= 0.7), 0)
        assert seg.seam_words(a, b) == rule


def test_groups_from_the_first_word(spark):
    times = [0.0, 1.0, 2.5, 3.1, 9.0]
    data = [(1, i, t, str(i)) for i, t in enumerate(times)]
    got = seg.group_by_elapsed(spark.createDataFrame(data, "k long, o long, s double, t string"), "k", "o", "s", "t", 3.0)
    assert [(r["start"], r["text"]) for r in got.orderBy("group").collect()] == [(0.0, "0 1 2"), (3.1, "3"), (9.0, "4")]


def test_text_clean_up(spark):
    loud = rows(spark, ["THIS IS LOUD. I SAID SO! AND ON", "MORE TEXT OF THE SAME KIND"])
    assert [r["text"] for r in seg.shouting_fixed(loud, "conv_id").orderBy("turn").collect()] == ["This is loud. I said so! And on", "More text of the same kind"]
    one = lambda c, t: spark.createDataFrame([(t,)], "t string").select(c(F.col("t"))).first()[0]
    assert one(seg.garbled, "xq zv kj wb " * 30) is True
    assert one(seg.garbled, "these are proper words in it " * 30) is False
    assert one(seg.speaker_marks, "&gt;&gt; Mayor &amp; council") == "» Mayor & council"


def test_caption_files(spark):
    body = "﻿WEBVTT\r\n\r\nNOTE x\r\n\r\n1\r\n00:01.000 --> 00:02.500 align:start\r\n<v Bob>Hi\r\nthere\r\n\r\n1:00:00.000 --> 1:00:01.000\r\nend\r\n"
    got = captions.parse_vtt(spark.createDataFrame([(1, body)], "id long, body string"), "body").orderBy("pos").collect()
    assert [(r["start"], r["end"], r["text"]) for r in got] == [(1.0, 2.5, "Hi\nthere"), (3600.0, 3601.0, "end")]
    assert captions.parse_vtt(spark.createDataFrame([(1, "WEBVTT\n"), (2, None)], "id long, body string"), "body").count() == 0
    ttml = '<tt xmlns="x" xmlns:ns="y"><p begin="1500ms" end="00:00:02.000">a<br/>b</p><ns:p begin="3s" end="4s">c</ns:p></tt>'
    got = captions.parse_ttml(spark.createDataFrame([(ttml,)], "body string"), "body").orderBy("pos").collect()
    assert [(r["start"], r["end"], r["text"]) for r in got] == [(1.5, 2.0, "a b"), (3.0, 4.0, "c")]
    raw = spark.createDataFrame([(bytearray("é", "utf-8"),), (bytearray("é—", "cp1252"),)], "b binary").select(captions.decode_bytes(F.col("b")))
    assert [r[0] for r in raw.collect()] == ["é", "é—"]


def test_ttml(spark):
    cue = lambda inner, times='begin="1s" end="2s"': f"<tt:p {times}>{inner}</tt:p>"
    wrap = lambda inner: f'<?xml version="1.0"?>\n<tt:tt xmlns:tt="u" xmlns:z="v"><tt:head><tt:param/></tt:head><tt:body><tt:div>{inner}</tt:div></tt:body></tt:tt>'
    files = {
        1: wrap(cue("a <tt:span z:k='1'>b <tt:span>c</tt:span></tt:span> &amp; d &#233; &lt;e&gt;") + cue("<![CDATA[<f>]]> g", "z:id='n' end='3.5s'\n begin='2500ms'")),
        2: wrap(cue("late", 'begin="soon" end="2s"') + cue(" <tt:span/> ") + '<tt:p begin="1s" end="2s"/>' + cue("no end", 'begin="1s"') + "<!-- " + cue("old") + " -->" + cue("x", 'begin="01:00:01" end="01:00:02.250"')),
        3: wrap(cue("cut"))[:-9],
        4: wrap("<tt:p begin='1s' end='2s'>a & b</tt:p>"),
        5: wrap(cue("a<tt:span>b") + "</tt:span>"),
        6: None,
        7: "",
        8: wrap(""),
        9: wrap(cue("<tt:span>long</tt:span> " * 20000)),
    }
    got = {}
    for r in captions.parse_ttml(spark.createDataFrame(list(files.items()), "k long, body string"), "body").orderBy("k", "pos").collect():
        got.setdefault(r["k"], []).append((r["pos"], r["start"], r["end"], r["text"]))
    long = got.pop(9)
    assert got == {1: [(0, 1.0, 2.0, "a b c & d é <e>"), (1, 2.5, 3.5, "<f> g")], 2: [(0, 3601.0, 3602.25, "x")]}
    assert long == [(0, 1.0, 2.0, " ".join(["long"] * 20000))]


def test_rollup_tasks_grow_with_the_texts(spark, monkeypatch):
    """A task gets so many bytes of text, not a share of all."""
    from minutespark.operators import folds

    monkeypatch.setattr(folds, "PART_BYTES", 1000)
    rows = spark.range(40).select("id", F.lit(0).alias("o"), F.lit(0.0).alias("start"), F.lit(1.0).alias("end"), F.repeat(F.lit("word "), 100).alias("text"))
    found = seg.dedupe_rollup_tracks(rows, "id", "o")
    assert found.rdd.getNumPartitions() == 20 and found.count() == 40
