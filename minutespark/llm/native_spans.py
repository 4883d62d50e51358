"""Regular-expression matches with their positions, by built-in functions only.

Spark has no function for match positions. ``split`` gives the pieces between the matches of a
pattern and ``regexp_extract_all`` the matches themselves; both are leftmost and non-overlapping, so
running sums of their lengths (in code points) are the positions. The sums are a window over the
exploded matches of a row, thus linear in their number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from minutespark.llm.scratch import materialize, neutral, sized

#: Code points kept on either side of a match.
CONTEXT = 40
#: Code points of a chunk from which pieces of a text are cut.
CHUNK = 4096


@dataclass(frozen=True)
class Pattern:
    """``guard`` is a cheaper pattern that a text with a match of interest must contain. Only
    matches of ``group`` 0 have positions; ``group`` names what is kept as ``value``."""

    kind: str
    pattern: str
    guard: str
    group: int = 0


def text_hash(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def _found(number: int, p: Pattern) -> Column:
    """The matches of one pattern in column text, as an array; null without any."""
    pieces = F.split(F.col("text"), p.pattern, -1)
    whole = F.regexp_extract_all("text", F.lit(p.pattern), F.lit(0))
    value = F.regexp_extract_all("text", F.lit(p.pattern), F.lit(p.group)) if p.group else whole
    zipped = F.arrays_zip(pieces.alias("gap"), F.slice(pieces, 2, F.size(pieces)).alias("after"), whole.alias("found"), value.alias("value"))
    rows = F.transform(
        zipped,
        lambda x, i: F.struct(
            F.lit(number).alias("order"),
            i.alias("at"),
            F.length(x["gap"]).alias("gap"),
            x["found"].alias("found"),
            x["value"].alias("value"),
            F.right(x["gap"], F.lit(CONTEXT)).alias("before"),
            F.left(x["after"], F.lit(CONTEXT)).alias("after"),
        ),
    )
    return F.when(F.col("text").rlike(p.guard), F.filter(rows, lambda x: x["found"].isNotNull()))


def matches(docs: DataFrame, id_col: str, text_col: str, patterns: list[Pattern]) -> DataFrame:
    """One row per match, and one with null kind for a row of ``docs`` without any: row (unique
    per row of docs), doc_id, text_hash, order (of the kind), kind, start, end, value, found, before, after."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts = [_found(number, p) for number, p in enumerate(patterns)]
    empty = F.filter(F.transform(F.array(F.lit(0)), lambda x: F.struct(x.alias("order"), x.alias("at"), x.alias("gap"), F.lit("").alias("found"), F.lit("").alias("value"), F.lit("").alias("before"), F.lit("").alias("after"))), lambda x: F.lit(False))
    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), text_hash(F.col(text_col)).alias("text_hash"), text.alias("text"))
    flat = slim.select("row", "doc_id", "text_hash", F.explode_outer(F.concat(*(F.coalesce(p, empty) for p in parts))).alias("m")).select("row", "doc_id", "text_hash", "m.*")
    line = Window.partitionBy("row", "order").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("found")).over(line)
    kinds = F.array(*(F.lit(p.kind) for p in patterns))
    return flat.select("row", "doc_id", "text_hash", "order", F.get(kinds, F.col("order")).alias("kind"), (end - F.length("found")).cast("long").alias("start"), end.cast("long").alias("end"), "value", "found", "before", "after")


def joined(spans: Column) -> Column:
    """``kind:start:end`` of an array of structs, comma-joined in its order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, mask: str) -> DataFrame:
    """``docs`` with every span of ``found`` (text_hash, spans) replaced; overlapping and touching ones are one. What a
    text's spans are depends on the text alone, so they are looked up by its 128-bit hash."""
    some = found.where(F.size("spans") > 0).groupBy("text_hash").agg(F.first("spans").alias("spans")).select("text_hash", F.explode("spans").alias("s"))
    line = Window.partitionBy("text_hash").orderBy("s.start", "s.end").rowsBetween(Window.unboundedPreceding, -1)
    some = some.select("text_hash", F.col("s.start").alias("to"), F.col("s.end").alias("end"), F.coalesce(F.max("s.end").over(line), F.lit(0).cast("long")).alias("from"))
    # What is kept lies between the furthest end so far and a span that starts at or after it.
    gap = F.when(F.col("to") >= F.col("from"), F.struct("from", "to"))
    some = some.groupBy("text_hash").agg(F.array_sort(F.collect_list(gap)).alias("_gaps"), F.max("end").alias("_rest"))
    some = materialize(some.select(F.col("text_hash").alias("_hash"), "_gaps", "_rest"), "redactions")
    rows, (text_name,) = neutral(docs, text_col)
    both = rows.join(sized(some, "_hash", "_gaps"), text_hash(F.col(text_name)) == F.col("_hash"), "left")
    # Pieces are cut from chunks, as a substring of a long text walks there from its start.
    chunks = F.when(F.col("_gaps").isNotNull(), F.regexp_extract_all(F.col(text_name), F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)))
    both = both.withColumn("_chunks", chunks)

    def cut(start: Column, end: Column) -> Column:
        first = F.floor(start / CHUNK)
        part = F.slice("_chunks", (first + 1).cast("int"), (F.floor(end / CHUNK) - first + 1).cast("int"))
        return F.substring(F.array_join(part, ""), (start - first * CHUNK + 1).cast("int"), (end - start).cast("int"))

    kept = F.transform("_gaps", lambda g: F.concat(cut(g["from"], g["to"]), F.lit(mask)))
    masked = F.concat(F.array_join(kept, ""), cut(F.col("_rest"), F.length(text_name)))
    return both.withColumn(text_name, F.when(F.col("_gaps").isNull(), F.col(text_name)).otherwise(masked)).select(*rows.columns).toDF(*docs.columns)
