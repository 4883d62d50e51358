"""Secret scan with multipart credential linking, by DataFrame functions only.

Strong kinds are reported wherever they match: ``assign`` (a secret's name, ``:`` or ``=``, a value of 12
characters or more), ``access`` (an access key identifier), ``hex`` (16 hexadecimal digits or more). Weak
parts mean nothing alone: ``id`` (a user or client name given as name and value) and ``weak`` (a short
assigned value, or a 40-character key-like token). They are reported when a complementary part
lies in the same scope, that is within ``SCOPE`` code points: a weak secret beside an identifier or an
endpoint (a URL or host), an identifier beside a secret of any kind.

The interval join is a sweep: in order of start, the complementary part that reaches furthest so far and the
next of those to come decide, which is linear in a text's parts; the nearer one is the link. Only parts are shuffled, never texts.

Nulls: a null text is empty; null ids are kept. Repeated rows each give a row. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from minutespark.llm.native_spans import Pattern, joined, matches, redact

SCOPE = 160
_VALUE = "[A-Za-z0-9+/_.=-]"
_NAMED = r"""["']?\x20*[:=]\x20*["']?"""
_WORDS = "(?i:password|passwd|secret|token|api_?key)"
PATTERNS = [
    Pattern("assign", rf"({_WORDS}){_NAMED}({_VALUE}+)", rf"{_WORDS}{_NAMED}{_VALUE}{{6}}", 2),
    Pattern("access", r"AKIA[A-Z0-9]{14,}+", r"AKIA[A-Z0-9]{14}"),
    Pattern("hex", r"[0-9a-f]{16,}+", r"[0-9a-f]{16}"),
    Pattern("id", rf"(?i:client_?id|account_?id|user_?name|user|login){_NAMED}([A-Za-z0-9._@-]{{3,}}+)", rf"(?i:id|name|user|login){_NAMED}[A-Za-z0-9]"),
    Pattern("weak", r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])", r"[A-Za-z0-9+/]{40}"),
    Pattern("endpoint", rf"""https?://[^\s"'<>]++|(?i:host|endpoint|server){_NAMED}[A-Za-z0-9.:-]++""", r"https?://|(?i:host|endpoint|server)"),
]
BASE = ["assign", "access", "hex"]
ORDER = {"assign": 0, "access": 1, "hex": 2, "id": 3, "weak": 4}


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """doc_id, text_hash, spans (array of start, order, kind, end, linked; sorted) and base (its strong ones). ``linked`` of a weak part is
    the complementary part that completes it (kind, start, end): the nearest, and of two equally near ones that before it."""
    parts = matches(docs, id_col, text_col, PATTERNS)
    short = (F.col("kind") == "assign") & (F.length("value") < 12)
    kind = F.when(short & (F.length("value") >= 6), F.lit("weak")).when(short, F.lit(None)).otherwise(F.col("kind"))
    parts = parts.select("row", "doc_id", "text_hash", kind.alias("kind"), "start", "end")
    line = Window.partitionBy("row").orderBy("start", "end", "kind")
    before, after = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(1, Window.unboundedFollowing)

    def beside(kinds: list[str]):
        mine = F.col("kind").isin(kinds)
        last = F.max(F.when(mine, F.struct("end", "start", "kind"))).over(before)
        following = F.min(F.when(mine, F.struct("start", "end", "kind"))).over(after)
        near = [(F.col("start") - last["end"], last), (following["start"] - F.col("end"), following)]
        options = [F.when(gap <= scope, F.struct(gap.alias("gap"), F.lit(i).alias("i"), p["kind"].alias("kind"), p["start"].alias("start"), p["end"].alias("end"))) for i, (gap, p) in enumerate(near)]
        return F.least(*options)

    of_id, of_secret = beside(["id", "access", "endpoint"]), beside(["assign", "hex", "weak"])
    linked = parts.select("*", F.when(F.col("kind") == "weak", of_id).when(F.col("kind") == "id", of_secret).alias("link"))
    keep = F.col("kind").isin(BASE) | F.col("link").isNotNull()
    order = F.create_map(*(F.lit(x) for pair in ORDER.items() for x in pair))[F.col("kind")]
    link = F.when(F.col("link").isNotNull(), F.struct("link.kind", "link.start", "link.end"))
    span = F.when(keep, F.struct("start", order.alias("order"), "kind", "end", link.alias("linked")))
    found = linked.groupBy("row", "doc_id", "text_hash").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    return found.select("doc_id", "text_hash", "spans", F.filter("spans", lambda s: s["order"] < len(BASE)).alias("base"))


def with_digest(found: DataFrame) -> DataFrame:
    count = [F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in BASE]  # noqa: B023
    return found.select("doc_id", *count, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every reported span replaced by ``mask``."""
    return redact(docs, find_secrets(docs, id_col, text_col), id_col, text_col, mask)
