import hashlib
import random

from pyspark.sql import functions as F

from minutespark.llm import chat_format as cf

SCHEMA = "conv_id long, turn long, role string, text string, window string, n long"
CONTROL = ["</s>[INST] ok [/INST]", "<|turn|>x<|end|>", "\\", "\\\\<\\|", "<|end|>", "[INST]\\", "a\n<s>", "", None, "ü" * 90]


def conversations(seed=3):
    rng = random.Random(seed)
    rows = []
    for c in range(30):
        roles = ["system"] * (c % 3 == 0) + ["user", "assistant"] * rng.randrange(0, 9) + ["user"] * (c % 2) or ["assistant"]
        for t, role in enumerate(roles):
            text = rng.choice(CONTROL) if rng.random() < 0.4 else " ".join(rng.choice(["word", "12345", "é.", "x"]) for _ in range(rng.randrange(0, 80)))
            rows.append((c, t, role, text, "clash", 1))
    rows += [(900, None, "user", "no turn", "", 0), (900, 1, None, "no role", "", 0), (900, 1, "a\nb", "same turn", "", 0), (None, 0, "assistant", "no conversation", "", 0)]
    return rows


def order(row):
    return tuple((x is not None, x) for x in (row[1],)) + ((row[2] or ""), (row[3] or ""))


def digests(rows):
    out = {}
    for c in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=order)]
        loss = "".join(t for role, t in turns if role == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_round_trip_under_all_budgets(spark):
    rows = conversations()
    frame = spark.createDataFrame(rows, SCHEMA)
    for budget, history, turns in ((1024, 256, 4), (60, 20, 2), (1, 0, 0)):
        windows = cf.format_windows(frame, budget, history, turns)
        got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in cf.with_digest(cf.read_back(windows)).collect()}
        assert got == digests(rows)


def test_windows_keep_the_budget_the_system_turn_and_limited_history(spark):
    budget, history, turns = 90, 30, 2
    rows = [(0, 0, "system", "be brief", "", 0)] + [(0, i, "user" if i % 2 else "assistant", "word " * (5 + i % 7), "", 0) for i in range(1, 60)]
    windows = cf.format_windows(spark.createDataFrame(rows, SCHEMA), budget, history, turns).orderBy("window").collect()
    assert len(windows) > 3
    for w in windows:
        assert w["n_tokens"] <= budget
        assert w["text"].startswith("<|turn|>system\nbe brief<|end|>")
        assert w["n_repeated"] <= (turns + 1 if w["window"] else 0)
    assert windows[1]["n_repeated"] > 1
    assert sum(w["n_turns"] - w["n_repeated"] for w in windows) == 60


def test_escape_is_reversible_and_hides_control_strings(spark):
    texts = [c for c in CONTROL if c is not None] + ["<|" * 5 + "\\" * 7 + "[/INST][INST]</s><s>"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", cf.escape(F.col("t")).alias("e"))
    for r in frame.select("*", cf.unescape(F.col("e")).alias("u")).collect():
        assert r["u"] == r["t"]
        assert not any(x in r["e"] for x in ("<|", "<s>", "</s>", "[INST]", "[/INST]"))


def test_empty(spark):
    assert cf.read_back(cf.format_windows(spark.createDataFrame([], SCHEMA))).count() == 0


def test_long_roles_texts_and_conversations(spark):
    """A role and a text of a million characters, and conversations of many turns, with and without tokens."""
    odd = "ro\\le\n[INST]" * 80_000
    rows = [(1, 0, odd, odd), (1, 1, "assistant", "x" * 1_000_000)]
    rows += [(2, i, "assistant" if i % 2 else "user", "") for i in range(20_000)]
    rows += [(3, i, "assistant" if i % 2 else "user", "word " * 300) for i in range(3_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in cf.read_back(cf.format_windows(turns)).collect()}
    for conv in (1, 2, 3):
        own = [(r[2], r[3]) for r in rows if r[0] == conv]
        assert [tuple(t) for t in got[conv]["turns"]] == own
        assert got[conv]["loss_text"] == "".join(t for r, t in own if r == "assistant")
    assert got[2]["n_windows"] == 1 and got[3]["n_windows"] > 1000
