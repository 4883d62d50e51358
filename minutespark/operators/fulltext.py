"""Full-text search by a positional inverted index: stems, phrases, OR, exclusion, cover-density rank.

The index has one row per stem and block of texts (some ``OUT`` words): (stem, ids, positions), a list of positions for each text that
has the stem, the positions of all words counted from 1, those of stop words too. It is made and written in one pass without a shuffle,
each file sorted by stem, so that a query reads the postings of its own stems and never a text. A query is alternatives (``or``) of terms that must all hold; a term is a word or a quoted phrase (its stop
words keep their places), a leading ``-`` excludes it. Stop words alone match nothing.

Rank: the sum over all minimal covers (spans of positions in which the query holds and no smaller span within does) of
0.1 / (1 + words of the span that are none of the query's). Texts without a cover (matched by exclusions alone) rank 0.

A null text has no words; texts with a null id are found as such. Words are runs of letters and digits; there are no special tokens for
addresses or hyphenated words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minutespark.functions.stemming import STOP_WORDS, stem

_PY_WORD = re.compile(r"[^\W_]+")
#: Words of texts that are taken together in a task.
OUT = 500_000
#: Weight of a word of plain text.
WEIGHT = 0.1


@dataclass(frozen=True)
class Term:
    """Stems with their distance from the first one; one for a word."""

    stems: tuple[tuple[str, int], ...]
    excluded: bool = False


def parse(text: str) -> list[list[Term]]:
    """Alternatives of terms; empty if the query has none but stop words."""
    alternatives: list[list[Term]] = [[]]
    for m in re.finditer(r'(-?)"([^"]*)"|(\S+)', text.lower()):
        if m[3] == "or":
            alternatives.append([])
            continue
        words = _PY_WORD.findall(m[2] if m[3] is None else m[3])
        kept = [(stem(w), i) for i, w in enumerate(words) if w not in STOP_WORDS]
        if kept:
            first = kept[0][1]
            excluded = bool(m[1]) if m[3] is None else m[3].startswith("-")
            alternatives[-1].append(Term(tuple((s, i - first) for s, i in kept), excluded))
    return [a for a in alternatives if a]


def _block(ids: pa.Array, words: list[str], counts: list[int]) -> Iterator[pa.RecordBatch]:
    """The postings of some texts, whose words stand in ``words`` one text after the other. Each distinct word is stemmed once, and places
    are grouped by one stable sort of (stem, text)."""
    codes = dict.fromkeys(words)
    stems = pa.array([None if w in STOP_WORDS else stem(w) for w in codes], pa.string()).dictionary_encode()
    codes = dict(zip(codes, stems.indices.fill_null(-1).to_pylist(), strict=True))
    held = np.fromiter(map(codes.__getitem__, words), np.int64, len(words))
    sizes = np.array(counts, np.int64)
    which = np.repeat(np.arange(len(sizes)), sizes)
    places = np.arange(1, len(words) + 1) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    key = (held * len(sizes) + which)[held >= 0]
    order = np.argsort(key, kind="stable")
    key, flat = key[order], places[held >= 0][order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    code, text = np.divmod(key[first], max(1, len(sizes)))
    begins = np.flatnonzero(np.diff(code, prepend=-1))

    def rows(stems: pa.Array, begins: np.ndarray, ids: pa.Array, first: np.ndarray, flat: np.ndarray) -> pa.RecordBatch:
        lists = pa.array(np.append(begins, len(ids)), pa.int32())
        positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(flat)), pa.int32()), pa.array(flat, pa.int32()))
        return pa.RecordBatch.from_arrays([stems, pa.ListArray.from_arrays(lists, ids), pa.ListArray.from_arrays(lists, positions)], names=["stem", "ids", "positions"])

    yield rows(stems.dictionary.take(pa.array(code[begins])), begins, ids.take(pa.array(text)), first, flat)
    yield rows(pa.nulls(1, pa.string()), np.zeros(1), ids, np.zeros(len(ids)), flat[:0])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, lower-case text) to (stem, ids, positions) of some texts each, and their ids once more by a null stem."""
    for batch in batches:
        words, counts, done = [], [], 0
        for row, text in enumerate(batch.column(1), 1):
            found = _PY_WORD.findall(text.as_py() or "")
            words += found
            counts.append(len(found))
            if len(words) >= OUT or row == batch.num_rows:
                yield from _block(batch.column(0).slice(done, row - done), words, counts)
                words, counts, done = [], [], row


def index(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(stem, ids, positions) of all texts, and all ids by a null stem, by which exclusions find the others."""
    rows = texts.select(F.col(id_col).alias("id"), F.lower(text_col).alias("text"))
    return rows.mapInArrow(_postings, f"stem string, ids array<{rows.schema['id'].dataType.simpleString()}>, positions array<array<int>>")


def write_index(texts: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """The index as Parquet. Each file is ordered by stem, so that a query's filters skip most row groups; postings are not moved between tasks,
    and a hot stem has its rows in all files."""
    index(texts, id_col, text_col).sortWithinPartitions("stem").write.parquet(path)
    return texts.sparkSession.read.parquet(path)


def _rows(postings: DataFrame, query: list[list[Term]]) -> tuple[DataFrame, dict[str, str]]:
    """One row per text that has any stem of the query (all texts if an alternative is of exclusions alone): id, and the positions of each stem."""
    stems = sorted({s for terms in query for t in terms for s, _ in t.stems})
    wanted = F.col("stem").isin(stems)
    if any(all(t.excluded for t in terms) for terms in query):
        wanted = wanted | F.col("stem").isNull()
    names = {s: f"p{i}" for i, s in enumerate(stems)}
    texts = postings.where(wanted).select("stem", F.explode(F.arrays_zip("ids", "positions")).alias("t")).select("stem", F.col("t.ids").alias("id"), "t.positions")
    found = texts.groupBy("id").agg(F.count("*").alias("n"), *(F.max(F.when(F.col("stem") == s, F.col("positions"))).alias(n) for s, n in names.items()))
    return found, names


def _holds(term: Term, names: dict[str, str]) -> Column:
    """Whether a text has the term: its stems' positions, moved to where the term begins, have one in common."""
    starts = None
    for s, offset in term.stems:
        at = F.coalesce(F.col(names[s]), F.array().cast("array<int>"))
        at = F.transform(at, lambda x: x - F.lit(offset)) if offset else at  # noqa: B023
        starts = at if starts is None else F.array_intersect(starts, at)
    there = F.size(starts) > 0
    return ~there if term.excluded else there


def _matched(postings: DataFrame, query: list[list[Term]]) -> tuple[DataFrame, dict[str, str]]:
    found, names = _rows(postings, query)
    test = F.lit(False)
    for terms in query:
        all_of = F.lit(True)
        for t in terms:
            all_of = all_of & _holds(t, names)
        test = test | all_of
    return found.where(test), names


def search(postings: DataFrame, query: str) -> DataFrame:
    """(id) of the texts that match; ids are taken to be unique."""
    return _matched(postings, parse(query))[0].select("id")


def covers(query: list[list[Term]], positions: dict[str, np.ndarray]) -> list[tuple[int, int]]:
    """All minimal spans in which an alternative holds, in order. For each place where a term may begin, the nearest end of all
    terms is found by binary search; a span is minimal if the next one ends later."""
    none = np.zeros(0, np.int64)
    spans = []
    for terms in query:
        starts, lengths = [], []
        for t in terms:
            if not t.excluded:
                at = positions.get(t.stems[0][0], none)
                for s, offset in t.stems[1:]:
                    at = np.intersect1d(at, positions.get(s, none) - offset)
                starts.append(at)
                lengths.append(t.stems[-1][1])
        if starts and all(map(len, starts)):
            begin = np.unique(np.concatenate(starts))
            begin = begin[begin <= min(x[-1] for x in starts)]
            spans += zip(begin.tolist(), np.max([x[np.searchsorted(x, begin)] + n for x, n in zip(starts, lengths, strict=True)], axis=0).tolist(), strict=True)
    out: list[tuple[int, int]] = []
    for p, q in sorted(spans, key=lambda s: (-s[0], s[1])):  # from the last: a span is minimal if it ends before all that begin later or there
        if not out or q < out[-1][1]:
            out.append((p, q))
    return out[::-1]


def density(query: list[list[Term]], positions: dict[str, np.ndarray]) -> float:
    """The sum over the covers."""
    held = np.unique(np.concatenate([np.zeros(0, np.int64), *positions.values()]))
    spans = np.array(covers(query, positions), np.int64).reshape(-1, 2)
    own = np.searchsorted(held, spans[:, 1], "right") - np.searchsorted(held, spans[:, 0])
    return float((WEIGHT / (2 + spans[:, 1] - spans[:, 0] - own)).sum())


def ranked(postings: DataFrame, query: str) -> DataFrame:
    """(id, rank) of the texts that match; order by rank and limit for a page of results."""
    parsed = parse(query)
    found, names = _matched(postings, parsed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = {s: batch.column(n).to_pylist() for s, n in names.items()}
            ranks = [density(parsed, {s: np.array(x[i] or (), np.int64) for s, x in lists.items()}) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ranks, pa.float64())], names=["id", "rank"])

    kind = postings.schema["ids"].dataType.elementType.simpleString()
    return found.mapInArrow(run, f"id {kind}, rank double")
