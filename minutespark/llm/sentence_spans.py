"""Removal of repeated runs of consecutive sentences.

Every run of ``run_length`` consecutive sentences is hashed (128 bits) and joined over the whole corpus; so is every run
of two that has ``pair_words`` words or more, since such a pair is no more ordinary than three short ones. Of equal runs
the first occurrence, by (id, position), stays; the sentences that any later occurrence covers are removed. Runs are judged
on the input, not on what is left.

Words lie between ASCII white space. A sentence ends with a word that ends in ``.``, ``!``, ``?`` or their Arabic and
Indic forms (closing quotes and brackets may follow), at a full-width full stop, exclamation or question
mark wherever it stands, and at a line break. Sentences are compared by their words, with A-Z in lower case.

Nulls: a null text has no sentences; null ids sort first and are kept. Rows that repeat count as separate occurrences, in
the order they are read. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minutespark.llm import textkit as tk
from minutespark.llm.scratch import discard, materialize, numbered

U = np.uint64
RUN_LENGTH, PAIR_WORDS = 3, 20
# UTF-8 forms of sentence ends besides . ! ? (those of _WIDE need no white space after them), and what may follow.
_WIDE = ("。", "！", "？")
_OTHER = ("؟", "۔", "।", "॥")
_STOP, _CLOSING = np.zeros(256, bool), np.zeros(256, bool)
_STOP[list(b".!?")] = True
_CLOSING[list(b"\"')]}")] = True


def _ends_of(buf: np.ndarray, mark: str) -> np.ndarray:
    """Places right behind a mark."""
    code = mark.encode()
    at = np.flatnonzero(buf == code[-1]) + 1
    at = at[at >= len(code)]
    for i, byte in enumerate(code[:-1]):
        at = at[buf[at - len(code) + i] == byte]
    return at


def words_of(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (bytes) and text index of all words; a full-width sentence end ends a word, too."""
    start, end, doc = tk.word_spans(buf, offs)
    wide = np.concatenate([_ends_of(buf, m) for m in _WIDE])
    if len(wide):
        edge = np.zeros(len(buf) + 1, bool)
        edge[wide] = True
        inside = np.zeros(len(buf) + 2, np.int32)
        np.add.at(inside, start + 1, 1)
        np.add.at(inside, end, -1)
        cut = np.flatnonzero(edge & (np.cumsum(inside)[:-1] > 0))
        start = np.sort(np.concatenate([start, cut]))
        end = np.sort(np.concatenate([end, cut]))
        doc = np.searchsorted(offs, start, "right") - 1
    return start, end, doc


def sentence_ends(buf: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each word is the last of its sentence."""
    if not len(start):
        return np.zeros(0, bool)
    at = end.copy()
    for _ in range(3):
        at -= (at - start > 1) & _CLOSING[buf[at - 1]]
    last = _STOP[buf[at - 1]]
    marked = np.zeros(len(buf) + 1, bool)
    for m in (*_WIDE, *_OTHER):
        marked[_ends_of(buf, m)] = True
    last |= marked[at]
    lines = np.concatenate([[0], np.cumsum(buf == 10)])
    last[:-1] |= (lines[start[1:]] > lines[end[:-1]]) | (doc[1:] != doc[:-1])
    last[-1] = True
    return last


class Sentences:
    """Sentences of the texts of a slice: first word's start, last word's end, text and number of words."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        self.buf = buf
        self.word_start, self.word_end, word_doc = words_of(buf, offs)
        last = np.flatnonzero(sentence_ends(buf, self.word_start, self.word_end, word_doc))
        self.first_word = np.concatenate([[0], last[:-1] + 1]).astype(np.int64) if len(last) else last
        self.n_words = last - self.first_word + 1
        self.start, self.end, self.doc = self.word_start[self.first_word], self.word_end[last], word_doc[last]

    def hashes(self) -> list[np.ndarray]:
        """Two 64-bit hashes of every sentence."""
        if not len(self.start):
            return [np.zeros(0, np.uint64)] * 2
        word = tk.span_hash(self.buf, self.word_start, self.word_end, lower=True)
        inner = (np.arange(len(word)) - np.repeat(self.first_word, self.n_words)).astype(np.uint64)
        out = []
        for salt in (U(0x243F6A8885A308D3), U(0x13198A2E03707344)):
            mixed = tk.mix(word ^ tk.mix(inner + salt))
            out.append(tk.mix(np.add.reduceat(mixed, self.first_word) + self.n_words.astype(np.uint64)))
        return out

    def runs(self, run_length: int, pair_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First sentence, number of sentences and both hashes of every run."""
        n, hashes = len(self.start), self.hashes()
        at, many = [], []
        for length in {run_length, min(2, run_length)}:
            first = np.arange(max(0, n - length + 1))
            ok = self.doc[first] == self.doc[first + length - 1]
            if length < run_length:
                ok &= self.n_words[first] + self.n_words[first + 1] >= pair_words
            at.append(first[ok])
            many.append(np.full(int(ok.sum()), length))
        at, many = np.concatenate(at), np.concatenate(many)
        out = []
        for h in hashes:
            acc = many.astype(np.uint64)
            for k in range(run_length):
                on = many > k
                acc[on] = tk.mix(acc[on] * U(3) ^ h[at[on] + k])
            out.append(acc)
        return at, many, *out


def _hash(run_length: int, pair_words: int, with_id: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in tk.slices(batch.column("text")):
                found = Sentences(buf, offs)
                at, many, one, two = found.runs(run_length, pair_words)
                columns, names = [pa.array(tk.signed(one)), pa.array(tk.signed(two))], ["h1", "h2"]
                if with_id:
                    doc = found.doc[at]
                    take = pa.array(doc + lo)
                    position = at - np.searchsorted(found.doc, np.arange(hi - lo))[doc]
                    columns += [batch.column("row").take(take), batch.column("doc_id").take(take), pa.array(position, pa.int32()), pa.array(many, pa.int32())]
                    names += ["row", "doc_id", "pos", "many"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


_SPAN = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("first_docs", pa.list_(pa.int64()))])


def _cut(data: bytes, hits: list[dict]) -> tuple[int, int, list[dict], str | None]:
    """Sentences, removed ones, spans and kept text of one text."""
    buf = np.frombuffer(data, np.uint8)
    found = Sentences(buf, np.array([0, len(buf)]))
    n = len(found.start)
    if not hits:
        return n, 0, [], None
    gone = np.zeros(n + 1, np.int64)
    for h in hits:
        gone[h["pos"]] += 1
        gone[h["pos"] + h["many"]] -= 1
    covered = np.cumsum(gone)[:n] > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    first, stop = edge[::2], edge[1::2]
    chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    after = np.append(found.start[1:], len(buf))  # white space behind a removed run goes with it
    kept, at = [], 0
    docs: list[set[int]] = [set() for _ in first]
    for h in hits:
        if h["first_doc"] is not None:
            docs[int(np.searchsorted(first, h["pos"], "right")) - 1].add(h["first_doc"])
    for i, j in zip(first.tolist(), stop.tolist(), strict=True):
        kept.append(data[at : found.start[i]])
        at = int(after[j - 1])
    kept.append(data[at:])
    spans = [
        {"first": i, "last": j - 1, "start": int(chars[found.start[i]]), "end": int(chars[found.end[j - 1]]), "first_docs": sorted(d)}
        for i, j, d in zip(first.tolist(), stop.tolist(), docs, strict=True)
    ]
    return n, int(covered.sum()), spans, b"".join(kept).decode()


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in batches:
        for at in range(0, big.num_rows, 500):
            batch = big.slice(at, 500)
            out = []
            for text, hits in zip(batch.column("text").to_pylist(), batch.column("hits").to_pylist(), strict=True):
                n, removed, spans, kept = _cut((text or "").encode(), hits or [])
                out.append((n, removed, spans, kept if removed else text))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            arrays = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:2]), pa.array(columns[2], pa.list_(_SPAN)), pa.array(columns[3], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_sentences", "n_removed", "spans", "text"])


def remove_repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_length: int = RUN_LENGTH, pair_words: int = PAIR_WORDS, only_changed: bool = False) -> DataFrame:
    """doc_id, n_sentences, n_removed, spans (array of first, last sentence, start, end in code
    points, first_docs: where the removed runs stay) and text (the input without the spans and the white space
    behind each) per row; with ``only_changed`` just the rows that lose something."""
    texts = numbered(docs, "sentence-texts", doc_id=F.col(id_col).cast("long"), text=F.col(text_col))
    prints = texts.select("text").mapInArrow(_hash(run_length, pair_words, False), "h1 long, h2 long")
    # Written out, so that the joins' sides are plain exchanges, whose hot keys Spark can split.
    repeated = materialize(prints.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2"), "repeated-runs")
    runs = texts.mapInArrow(_hash(run_length, pair_words, True), "h1 long, h2 long, row long, doc_id long, pos int, many int")
    hits = materialize(runs.join(repeated, ["h1", "h2"], "left_semi"), "run-hits")
    place = F.struct("doc_id", "row", "pos")
    first = materialize(hits.groupBy("h1", "h2").agg(F.min(place).alias("first")), "first-runs")
    later = hits.join(first, ["h1", "h2"]).where(place != F.col("first"))
    per_row = materialize(later.groupBy("row").agg(F.collect_set(F.struct("pos", "many", F.col("first.doc_id").alias("first_doc"))).alias("hits")), "row-hits")
    discard(repeated, hits, first)
    # Always a shuffle of both sides, so that cost follows the input at every size.
    joined = texts.join(per_row, "row", "inner" if only_changed else "left")
    span = "array<struct<first: long, last: long, start: long, end: long, first_docs: array<long>>>"
    return joined.select("doc_id", "text", "hits").mapInArrow(_remove, f"doc_id long, n_sentences long, n_removed long, spans {span}, text string")
