"""Chat formatting in token-budgeted windows, by DataFrame functions only.

A conversation's turns, in order of (turn, role, text), become windows of at most ``budget`` tokens. Prefix
sums of the turns' tokens choose the windows' spans, which begin and end at turns: a window's new turns
go on while their sum stays within the budget less the system turn and the room for history. Each window
starts with the system turn (if the conversation opens with one), then repeats up to
``history_turns`` turns before its span with at most ``history_tokens`` tokens in all. A turn
alone over the room has a window of its own, uncut. The loss mask holds the assistant texts of a window's
new turns, so that each assistant text is a target exactly once and repeated ones are masked.

Template: ``<|turn|>role`` newline ``text<|end|>``. In roles and texts a backslash is doubled and control strings
(``<|``, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``; in roles line breaks too) get a backslash after their
first character, so they cannot be taken for the template's; removing one backslash of each
restores them.

A token is a run of up to 4 letters, up to 3 digits, or one other visible character; pass
``tokens`` for another measure. The one shuffle is by conversation: a conversation is one row
of the result of ``read_back`` (its digest needs its turns in order), so the longest one
bounds a task.

Nulls: a null text or role is empty, a null turn sorts first, rows with a null conversation form one.
Repeated rows are turns each. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUDGET, HISTORY_TOKENS, HISTORY_TURNS = 1024, 256, 4
OPEN, CLOSE = "<|turn|>", "<|end|>"


def count_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\p{L}{1,4}|\p{N}{1,3}|[^\s\p{L}\p{N}]"))


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, r"<(?=\||/?s>)|\[(?=/?INST\])", r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_windows(
    turns: DataFrame,
    budget: int = BUDGET,
    history_tokens: int = HISTORY_TOKENS,
    history_turns: int = HISTORY_TURNS,
    tokens: Callable[[Column], Column] = count_tokens,
) -> DataFrame:
    """One row per window of ``turns`` (conv_id, turn, role, text): conv_id, window (from 0), n_turns,
    n_repeated (leading turns that an earlier window had), n_tokens, text and loss (array of start,
    end in code points of text)."""
    rows = turns.select(
        "conv_id",
        F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    role = F.replace(escape(F.col("t.role")), F.lit("\n"), F.lit("\\\n"))
    head = F.concat(F.lit(OPEN), role, F.lit("\n"))
    body = escape(F.col("t.text"))
    rows = rows.select("conv_id", "t", F.length(head).alias("head"), F.length(body).alias("body"), F.concat(head, body, F.lit(CLOSE)).alias("full"), tokens(F.col("t.text")).cast("long").alias("n"))
    line = Window.partitionBy("conv_id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    size = F.col("head") + F.col("body") + len(CLOSE)
    rows = rows.withColumns({"sum": F.sum("n").over(line), "chars": F.sum(size).over(line), "at": F.row_number().over(line)})
    turn = F.struct("at", "sum", "chars", "n", "head", "body", "full", (F.col("t.role") == "system").alias("system"), (F.col("t.role") == "assistant").alias("target"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    first = F.get("turns", F.lit(0))
    convs = convs.withColumn("lead", first["system"].cast("int")).withColumn("lead_tokens", F.when(first["system"], first["n"]).otherwise(F.lit(0).cast("long")))
    room = F.greatest(F.lit(budget - history_tokens) - F.col("lead_tokens"), F.lit(1))
    # Ends of the spans: a turn that would take the sum since the span's start over the room opens one.
    start = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).cast("long").alias("base"))
    body_turns = F.when(F.size("turns") > F.col("lead"), F.slice("turns", F.col("lead") + 1, F.size("turns"))).otherwise(F.slice("turns", 1, 1))

    def step(acc: Column, t: Column) -> Column:
        opens = (F.size(acc["starts"]) == 0) | (t["sum"] - acc["base"] > room)
        return F.when(opens, F.struct(F.concat(acc["starts"], F.array(t["at"])).alias("starts"), (t["sum"] - t["n"]).alias("base"))).otherwise(acc)

    convs = convs.withColumn("starts", F.aggregate(body_turns, start, step, lambda acc: acc["starts"]))
    nothing = F.slice("turns", 1, 0)

    def window(begin: Column, i: Column) -> Column:
        end = F.coalesce(F.get("starts", i + 1) - 1, F.size("turns"))
        before = F.get("turns", begin - 2)["sum"]
        recent_from = F.greatest(F.col("lead") + 1, begin - history_turns)
        recent = F.when(begin > recent_from, F.slice("turns", recent_from, begin - recent_from)).otherwise(nothing)
        history = F.filter(recent, lambda t: before - t["sum"] + t["n"] <= history_tokens)
        has_lead = (F.col("lead") == 1) & (begin > 1)
        lead_turns = F.when(has_lead, F.slice("turns", 1, 1)).otherwise(nothing)
        return F.struct(i.alias("window"), F.concat(lead_turns, history).alias("old"), F.slice("turns", begin, end - begin + 1).alias("new"), has_lead.alias("has_lead"))

    # Each window takes its own turns along, so that a conversation of many windows is not repeated for each.
    spans = convs.select("conv_id", F.explode(F.transform("starts", window)).alias("w")).select("conv_id", "w.*")
    # The system turn is new in the first window, where it comes before the span.
    repeated = F.when(F.col("window") == 0, F.size("old") - F.col("has_lead").cast("int")).otherwise(F.size("old"))
    begin_of = lambda t: t["chars"] - t["head"] - t["body"] - len(CLOSE)
    old_length = F.aggregate("old", F.lit(0).cast("long"), lambda a, t: a + t["head"] + t["body"] + len(CLOSE))
    shift = old_length - begin_of(F.get("new", F.lit(0)))

    def masked(t: Column) -> Column:
        at = (begin_of(t) + shift + t["head"]).cast("int")
        return F.struct(at.alias("start"), (at + t["body"]).alias("end"))

    loss = F.transform(F.filter("new", lambda t: t["target"]), masked)
    every = F.concat("old", "new")
    return spans.select(
        "conv_id",
        "window",
        F.size(every).cast("long").alias("n_turns"),
        repeated.cast("long").alias("n_repeated"),
        F.aggregate(every, F.lit(0).cast("long"), lambda a, t: a + t["n"]).alias("n_tokens"),
        F.array_join(F.transform(every, lambda t: t["full"]), "").alias("text"),
        loss.alias("loss"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """From windows' texts, masks and counts of repeated turns alone: conv_id, turns (array of role, text),
    loss_text, formatted_chars and n_windows of each conversation."""
    marked = F.slice(F.split("text", F.lit(r"<\|end\|>"), -1), F.col("n_repeated").cast("int") + 1, (F.col("n_turns") - F.col("n_repeated")).cast("int"))
    header = r"(?s)^<\|turn\|>((?:[^\\\n]++|\\.)*+)\n(.*)$"  # possessive: no recursion for each character
    turns = F.transform(marked, lambda t: F.struct(unescape(F.regexp_extract(t, header, 1)).alias("role"), unescape(F.regexp_extract(t, header, 2)).alias("text")))
    loss = F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])))
    read = windows.select("conv_id", F.struct("window", turns.alias("turns"), F.array_join(loss, "").alias("loss"), F.length("text").cast("long").alias("chars")).alias("w"))
    whole = read.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"))
    return whole.select(
        "conv_id",
        F.flatten(F.transform("w", lambda w: w["turns"])).alias("turns"),
        F.array_join(F.transform("w", lambda w: w["loss"]), "").alias("loss_text"),
        F.aggregate("w", F.lit(0).cast("long"), lambda a, w: a + w["chars"]).alias("formatted_chars"),
        F.size("w").cast("long").alias("n_windows"),
    )


def with_digest(read: DataFrame) -> DataFrame:
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_windows",
    )


def control_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -7: two turns whose text is made of control strings."""
    return spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
