import hashlib
import random
import re

import regex

from minutespark.llm import pii, secret_scan
from tests.llm.data import SCHEMA, documents, empty, frame

PIECES = [
    "password: abcdefghijklmnop", "Token = 'short'", "api_key=secret=abcdefghijkl", "password: secret: abcdefghijklmnop", "AKIA" + "A1" * 8, "AKIAAKIA" + "Z" * 13, "deadbeef" * 3, "abc123",
    "a.b+c@mail.example.com", "x@y", "a@b.c_d@e.f", "%%@q-r.s.t", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "0001.02.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111  1111", "+1 (555) 123-4567", "+49", "+1--------2", "+123456789012345678",
    "é", "😀", " ", "\n", "word ", "username=bob", "user: alice", "passwd=abc123x", "https://host.example.org/x", "server: db1", "GB29NWBK60161331926819", "123-45-6789",
]


def texts(seed=1, n=120):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) + rng.choice(["", " ", "\n"]) for _ in range(rng.randrange(0, 25))) for _ in range(n)]


def rows_of(found):
    return [(i, t, None, None, 0, 0, 0, "", 0) for i, t in enumerate(found)]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def either(word):
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


def secrets(t):
    names = "|".join(either(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(rf"({names})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t) if len(m[2]) >= 12]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(out)]


def personal(t):
    digits = lambda x: re.sub("[^0-9]", "", x)
    out = [f"email:{m.start()}:{m.end()}" for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [f"ip:{m.start()}:{m.end()}" for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [f"card:{m.start()}:{m.end()}" for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [f"phone:{m.start()}:{m.end()}" for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
    return out


def check(found, given, base, kinds):
    got = {r["doc_id"]: r for r in found.collect()}
    for i, t in enumerate(given):
        expected = base(t)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(expected).encode()).hexdigest(), repr(t)
        assert set(expected) <= set(got[i]["spans"].split(",")) | {""}
        for k in kinds:
            assert got[i][f"n_{k}"] == sum(x.startswith(k + ":") for x in expected)
    return got


def test_secrets_against_plain_expressions(spark):
    given = texts(1)
    check(secret_scan.with_digest(secret_scan.find_secrets(spark.createDataFrame(rows_of(given), SCHEMA))), given, secrets, ["assign", "access", "hex"])


def test_personal_data_against_plain_expressions(spark):
    given = texts(2)
    check(pii.with_digest(pii.find_personal_data(spark.createDataFrame(rows_of(given), SCHEMA))), given, personal, ["email", "ip", "card", "phone"])


def test_weak_parts_only_with_complements(spark):
    given = ["username=bob and passwd=abc123x", "username=bob", "passwd=abc123x", "passwd=abc123x " + "filler " * 60 + "username=bob", "passwd=abc123x at https://host.example.org"]
    found = secret_scan.with_digest(secret_scan.find_secrets(spark.createDataFrame(rows_of(given), SCHEMA))).collect()
    spans = [r["spans"] for r in sorted(found, key=lambda r: r["doc_id"])]
    assert spans == ["id:0:12,weak:17:31", "", "", "", "weak:0:14"]


def test_redaction_masks_the_spans_and_nothing_else(spark):
    given = ["é password: abcdefghijklmnop. " + "deadbeef" * 3 + " end", "clean", None, "token=" + "a" * 20 + "😀"]
    kept = secret_scan.redact_secrets(spark.createDataFrame(rows_of(given), SCHEMA), mask="#")
    assert kept.columns == frame(spark).columns
    assert {r["doc_id"]: r["text"] for r in kept.collect()} == {0: "é # # end", 1: "clean", 2: None, 3: "#😀"}
    mail = pii.redact_personal_data(spark.createDataFrame(rows_of(["to a@b.org!"]), SCHEMA)).first()["text"]
    assert mail == "to [PII]!"


def test_reliabilities_are_learned_and_ranked():
    """Simulated votes: EM recovers which labelers are good, the classifier follows the posterior."""
    rng = random.Random(0)
    counts: dict = {}
    for _ in range(20000):
        y = rng.random() < 0.6
        votes = tuple((1 if y else -1) * (1 if rng.random() < p else -1) if rng.random() < 0.8 else 0 for p in (0.95, 0.9, 0.8, 0.6, 0.5))
        counts["a", votes] = counts.get(("a", votes), 0) + 1
    listed = [(k, v, n) for (k, v), n in counts.items()]
    rates, tables, post = pii.estimate(listed)
    assert abs(rates["a"] - 0.6) < 0.05
    power = [t[1, 1] / t[1, 0] for t in tables]
    assert power[0] > power[1] > power[2] > power[3]
    # The classifier learns the posterior from other features that go with it.
    seen = {}
    for k, v, n in listed:
        f = (min(7, 4 + v[0]), 0, 1, 1, 0, int(v[1] > 0), 0, int(v[1] < 0))
        held = seen.setdefault(f, [0, 0.0])
        held[0] += n
        held[1] += n * post[k, v]
    bias, weights = pii.train([(0, f, n, label) for f, (n, label) in seen.items()])
    agree = sum(n for f, (n, label) in seen.items() if (bias[0] + sum(w[x] for w, x in zip(weights, f, strict=True)) >= 0) == (label / n >= 0.5))
    assert agree / 20000 > 0.9


def test_weak_spans_against_planted_truth(spark):
    """Numbers that are led to by cues in four languages, and ones of the same shape that are told against."""
    rng = random.Random(4)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    local = lambda first: f"{rng.choice(first)}{digits(2)}-{rng.randrange(200, 999)}-{digits(4)}"
    ssn = lambda ok: f"{rng.randrange(100, 600)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}" if ok else f"{rng.choice(['000', '666', '9' + digits(2)])}-{digits(2)}-{digits(4)}"
    given, truth = [], []
    for i in range(400):
        real = rng.random() < 0.6
        cue = rng.choice(["Phone: ", "Bitte rufen Sie an: ", "appelez le mobile: ", "llame al tel: "]) if i % 2 else rng.choice(["SSN: ", "social security: "])
        number = local("23456789") if real and i % 2 else local("01") if i % 2 else ssn(real)
        lead = cue if real else rng.choice(["order ", "invoice x", "Rechnung ", "version ", "factura ", "pedido "])
        before = "words " * rng.randrange(1, 9)
        given.append(f"{before}{lead}{number} and more")
        truth.append((len(before + lead), len(before + lead + number), "local" if i % 2 else "ssn", real))
    found = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(frame(spark, rows_of(given))).collect()}
    right = sum(any((s["start"], s["end"], s["kind"]) == t[:3] for s in found[i]) == t[3] for i, t in enumerate(truth))
    assert right >= 0.95 * len(truth)


def test_weak_candidates_against_brute_force(spark):
    patterns = {p.kind: regex.compile(p.pattern) for p in pii.PATTERNS[4:]}  # it knows possessive forms and long look-behind
    given = texts(9)
    for r in pii.find_personal_data(frame(spark, rows_of(given))).collect():
        weak = [s for s in r["spans"] if s["kind"] not in pii.BASE]
        for s in weak:
            assert (s["start"], s["end"]) in {m.span() for m in patterns[s["kind"]].finditer(given[r["doc_id"]])}
            assert s["score"] >= 0.5


def test_awkward_rows(spark):
    for find in (secret_scan.find_secrets, pii.find_personal_data):
        assert find(frame(spark)).count() == len(documents())
        assert find(empty(spark)).count() == 0


def test_redaction_of_long_texts_with_many_spans(spark):
    """Many overlapping and touching spans, beyond chunk borders, in wide code points; null ids; other texts of an id."""
    part = "é😀 password: abcdefghijklmnop user: bob x " + "deadbeef" * 3 + "AKIA" + "A1" * 8 + "\n"
    given = [part * 3000, "x" * 5000 + part, part + "y" * 9000, "clean", None, ""]
    rows = [(None if i % 2 else 1, t, None, None, 0, 0, 0, "", 0) for i, t in enumerate(given)]
    docs = frame(spark, rows)
    found = secret_scan.find_secrets(docs).collect()
    got = [r["text"] for r in secret_scan.redact_secrets(docs.coalesce(1)).collect()]

    def plain(text, spans):
        out, at = [], 0
        for s in sorted(spans, key=lambda s: (s["start"], s["end"])):
            if s["end"] > at:
                if s["start"] >= at:
                    out += [text[at : s["start"]], "[SECRET]"]
                at = s["end"]
            elif s["start"] >= at:
                out.append("[SECRET]")
        return "".join(out) + text[at:]

    from minutespark.llm.native_spans import text_hash

    hashes = {r["h"]: r["text"] for r in docs.select("text", text_hash(docs["text"]).alias("h")).collect() if r["text"]}
    expected = {hashes[r["text_hash"]]: plain(hashes[r["text_hash"]], r["spans"]) for r in found if r["text_hash"] in hashes}
    assert sorted(got, key=str) == sorted((expected.get(t, t) for t in given), key=str)
    assert any("[SECRET]" in (t or "") and len(t) > 100_000 for t in got)


def test_weak_parts_name_what_completes_them(spark):
    """Against all pairs of parts; a part alone, or one that its complement is too far from, is not reported."""
    rng = random.Random(12)
    pieces = ["user: bob ", "token=abc123x ", "AKIA" + "A1" * 8 + " ", "deadbeef" * 3 + " ", "https://host.example.org/x ", "w " * 60, "word "]
    given = ["".join(rng.choice(pieces) for _ in range(rng.randrange(0, 9))) for _ in range(150)] + ["user: bob", "token=abc123x"]
    forms = {"id": r"user: (bob)", "weak": r"token=abc123x", "access": r"AKIA[A1]{16}", "hex": r"[0-9a-f]{16,}", "endpoint": r"https?://\S+"}
    got = {r["doc_id"]: r["spans"] for r in secret_scan.find_secrets(frame(spark, rows_of(given))).collect()}
    for i, t in enumerate(given):
        parts = [(m.start(), m.end(), k) for k, p in forms.items() for m in re.finditer(p, t)]
        expected = {}
        for start, end, kind in parts:
            wanted = {"weak": ("id", "access", "endpoint"), "id": ("hex", "weak")}.get(kind, ())
            gaps = sorted((start - e if e <= start else s - end, e > start, k, s, e) for s, e, k in parts if k in wanted)
            if gaps and gaps[0][0] <= secret_scan.SCOPE:
                expected[kind, start, end] = gaps[0][2:]
        assert {(s["kind"], s["start"], s["end"]): tuple(s["linked"]) for s in got[i] if s["linked"]} == expected
    assert not got[150] and not got[151]


def test_personal_data_in_a_very_long_text(spark):
    found = pii.with_digest(pii.find_personal_data(frame(spark, rows_of(["mail a@b.org, +1 555 123 4567; " * 10_000])))).first()
    assert (found["n_email"], found["n_phone"]) == (10_000, 10_000)
    assert found["spans"].startswith("email:5:12,email:36:43,")
