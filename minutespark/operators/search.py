"""Keyword search over texts: query parsing, exact and typo-tolerant match, excerpts, vocabulary."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minutespark.operators import fulltext
from minutespark.operators.containment import texts_containing

TOKEN = "[a-z0-9']+"
IGNORED = {"and", "&", "or", "+", "-"}
AROUND = 50


@dataclass
class Query:
    phrases: list[str] = field(default_factory=list)
    words: list[str] = field(default_factory=list)
    not_phrases: list[str] = field(default_factory=list)
    not_words: list[str] = field(default_factory=list)
    text: str = ""


def parse_query(text: str) -> Query:
    """``"quoted phrases"``, words, and either of them excluded by a leading ``-``."""
    found = Query(text=text)

    def quoted(m: re.Match) -> str:
        phrase = m[2].strip().lower()
        if phrase:
            (found.not_phrases if m[1] else found.phrases).append(phrase)
        return " "

    for word in re.sub(r'(-?)"([^"]*)"', quoted, text).lower().split():
        if word in IGNORED:
            continue
        if word[0] == "-":
            found.not_words.append(word[1:])
        else:
            found.words.append(word[1:] if word[0] == "+" else word)
    return found


def corpus(*parts: Column) -> Column:
    """The lower-cased text that is searched: all non-empty parts, joined by spaces."""
    return F.lower(F.concat_ws(" ", *(F.when(F.length(p) > 0, p) for p in parts)))


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)))


def tolerance(length: int) -> int:
    """Edits allowed in a word of this length."""
    return 0 if length <= 4 else 1 if length <= 7 else 2


def near_pattern(word: str, edits: int) -> str:
    """Matches the tokens whose length allows for at most ``edits`` between them and ``word``."""
    c = TOKEN[:-1]
    return f"(?<!{c}){c}{{{max(1, len(word) - edits)},{max(1, len(word) + edits)}}}+(?!{c})"


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def excluded(text: Column, q: Query) -> list[Column]:
    return [~F.contains(text, F.lit(x)) for x in q.not_phrases + q.not_words]


def matches_exactly(text: Column, q: Query) -> Column:
    """All terms are substrings and no excluded one is; ``text`` is lower-cased."""
    return _all([F.contains(text, F.lit(x)) for x in q.phrases + q.words] + excluded(text, q))


def matches_fuzzily(text: Column, q: Query) -> Column:
    """Like the exact match, but a word may differ from some token by its tolerated edits."""
    words = []
    for w in q.words:
        k = tolerance(len(w))
        held = F.regexp_extract_all(F.lower(text), F.lit(near_pattern(w, k)), F.lit(0))
        words.append(F.exists(held, lambda t: (t == w) | ((F.levenshtein(t, F.lit(w), k) >= 0) if k else F.lit(False))))  # noqa: B023
    return _all([F.contains(text, F.lit(x)) for x in q.phrases] + words + excluded(text, q))


def vocabulary(texts: DataFrame, text_col: str, longest: int = 255) -> DataFrame:
    """Distinct tokens (column word). Tokens are made distinct in each row before the shuffle."""
    return texts.select(F.explode(tokens(F.col(text_col))).alias("word")).where(F.length("word") <= longest).distinct()


def near_words(words: DataFrame, term: str) -> DataFrame:
    """Vocabulary words (column word) within the tolerance of ``term``, with their distance."""
    k = tolerance(len(term))
    return words.withColumn("distance", F.levenshtein("word", F.lit(term), k)).where("distance >= 0")


def expand(words: DataFrame, term: str, at_most: int = 1000) -> list[str] | None:
    """The near words, nearest first; null if there are more than ``at_most`` (``fuzzy_by_vocabulary`` goes another way then)."""
    found = [r["word"] for r in near_words(words, term).orderBy("distance", "word").limit(at_most + 1).collect()]
    return found if len(found) <= at_most else None


def fuzzy_by_vocabulary(texts: DataFrame, id_col: str, text_col: str, q: Query, words: DataFrame, at_most: int = 1000) -> DataFrame:
    """(id) of the texts that match in two stages: longer words by any near word of the vocabulary ``words``, as substrings. The near
    words become one expression if they are few, and otherwise are joined to the texts that contain them."""
    near = {w: expand(words, w, at_most) for w in q.words if tolerance(len(w))}
    rest = {w: found for w, found in near.items() if found is not None}
    many = [w for w, found in near.items() if found is None]
    low = F.lower(text_col)
    found = texts.where(matches_expanded(low, q, rest)).select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    for w in many:
        terms = near_words(words, w).select(F.col("word").alias("term_id"), F.col("word").alias("term"))
        hits = texts_containing(found, "id", "_text", terms).select(F.col("id").alias("_hit")).distinct()
        found = found.join(hits, F.col("id").eqNullSafe(F.col("_hit")), "left_semi")
    return found.select("id")


def find(texts: DataFrame, id_col: str, text_col: str, q: Query, fuzzy: bool = False, index: DataFrame | None = None, words: DataFrame | None = None) -> tuple[str, DataFrame]:
    """(path, ids of the hits) by the best path that is at hand: the full-text index (``fulltext.index``), the vocabulary for a fuzzy
    query, and otherwise a scan of the texts, fuzzy or literal."""
    if fuzzy:
        if words is not None:
            return "vocabulary", fuzzy_by_vocabulary(texts, id_col, text_col, q, words)
        return "fuzzy_scan", texts.where(matches_fuzzily(F.lower(text_col), q)).select(F.col(id_col).alias("id"))
    if index is not None:
        return "index", fulltext.search(index, q.text)
    return "scan", texts.where(matches_exactly(F.lower(text_col), q)).select(F.col(id_col).alias("id"))


def shortest(words: list[str]) -> list[str]:
    """The words that contain no other one of them: a text that contains any of ``words`` contains one of these."""
    kept: list[str] = []
    for w in sorted(set(words), key=lambda w: (len(w), w)):
        if not any(k in w for k in kept):
            kept.append(w)
    return kept


def matches_expanded(text: Column, q: Query, near: dict[str, list[str]]) -> Column:
    """Two-stage form: short words are substrings, longer ones any of their vocabulary words; a longer word that is not in ``near``
    is left to the caller."""
    words = []
    for w in q.words:
        if tolerance(len(w)) and w not in near:
            continue
        options = [w] if tolerance(len(w)) == 0 else shortest(near[w])
        any_of = F.lit(False)
        for o in options:
            any_of = any_of | F.contains(text, F.lit(o))
        words.append(any_of)
    return _all([F.contains(text, F.lit(x)) for x in q.phrases] + words + excluded(text, q))


def escape_html(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def first_hit(text: Column, q: Query, fuzzy: bool = False) -> tuple[Column, Column]:
    """(position from 1 or null, length) of the first positive term in query order that occurs; ``fuzzy``: of the first token within a word's
    tolerated edits. Phrases are literal."""
    place, length = F.lit(None).cast("int"), F.lit(None).cast("int")
    low = F.lower(text)
    for term in reversed(q.words):
        k = tolerance(len(term))
        if fuzzy and k:
            near = F.get(F.filter(tokens(text), lambda t: F.levenshtein(t, F.lit(term), k) >= 0), F.lit(0))  # noqa: B023
            at, n = F.regexp_instr(low, F.concat(F.lit("(?<![a-z0-9'])"), near, F.lit("(?![a-z0-9'])"))), F.length(near)
        elif fuzzy:
            at, n = F.regexp_instr(low, F.lit(rf"(?<![a-z0-9']){re.escape(term)}(?![a-z0-9'])")), F.lit(len(term))
        else:
            at, n = F.instr(low, F.lit(term)), F.lit(len(term))
        place, length = F.when(at > 0, at).otherwise(place), F.when(at > 0, n).otherwise(length)
    for term in reversed(q.phrases):
        at = F.instr(low, F.lit(term))
        place, length = F.when(at > 0, at).otherwise(place), F.when(at > 0, F.lit(len(term))).otherwise(length)
    return place, length


def snippet(text: Column, q: Query, around: int = AROUND, fuzzy: bool = False) -> Column:
    """An excerpt around the first hit, HTML-escaped, the hit in <mark>; null without a hit."""
    at, n = first_hit(text, q, fuzzy)
    begin = F.greatest(at - around, F.lit(1))
    before = F.substring(text, begin, at - begin)
    hit = F.substring(text, at, n)
    after = F.substring(text, at + n, F.lit(around))
    cut_left = F.when(at - around > 1, "…").otherwise("")
    cut_right = F.when(at + n + around <= F.length(text), "…").otherwise("")
    out = F.concat(cut_left, escape_html(before), F.lit("<mark>"), escape_html(hit), F.lit("</mark>"), escape_html(after), cut_right)
    return F.when(at.isNotNull(), out)


def relevance(text: Column, q: Query) -> Column:
    """Occurrences of all positive terms per 1000 characters."""
    hits = F.lit(0)
    for term in q.phrases + q.words:
        hits = hits + (F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)
    return F.round(hits * 1000.0 / F.greatest(F.length(text), F.lit(1)), 4)


def count_occurrences(text: Column, term: str) -> Column:
    """Non-overlapping, case-insensitive occurrences of a literal."""
    low = F.lower(text)
    return ((F.length(low) - F.length(F.replace(low, F.lit(term), F.lit("")))) / len(term)).cast("long")
