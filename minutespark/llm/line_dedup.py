"""Lines that many documents share: two Bloom filters pick suspects, an exact count confirms them.

A line's key is the line without the white space ``[\\x20\\x09-\\x0D]`` at both ends, A-Z in lower case. Keys of at least
``min_chars`` code points that are in at least ``min_docs`` documents lose all their lines, or all but the first
(``keep_first``: of the smallest id, then the smallest text hash, then the first line).

1. Tasks hash the distinct keys of each document and pack a million of hashes at a time: each once, with a mark if several
   documents of the pack have it. A hot line is thus one entry of a pack. Packs are dealt by hash to slots, whose number
   grows with the corpus's lines, so that a slot is of bounded size.
2. A slot fills two Bloom filters in one pass over its packs: *once* with every hash, *twice* with those that *once* already
   had or that are marked. What the second filter has is suspected; no key of two documents is missed.
3. Only lines of suspected hashes are shuffled, as text and summed up before: their documents are counted by the key itself,
   so neither the filters' false positives nor equal hashes change the result.
4. Texts are shuffled once, to the numbers of the lines that they lose.

Texts are looked up by MD5, so ids may be null or repeated; with ``keep_first`` rows of equal id and text keep the same line.
A null text counts as empty: one empty line, which stays. Every row gives one row. Extra columns are ignored. Memory is
bounded by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minutespark.llm import textkit as tk
from minutespark.llm.scratch import discard, materialize, sized

MIN_DOCS = 10
#: Hashes of a pack; lines of the corpus for each slot, and least number of slots.
PACK, SLOT_LINES, SLOTS = 1 << 20, 1 << 20, 64
#: Bits of a filter for each entry, and bits that an entry sets: some 0.3 % of single hashes are suspected.
BITS, PROBES = 16, 4
_GATHER = 1 << 20


class Bloom:
    """A Bloom filter over 64-bit hashes, in 64-bit words."""

    def __init__(self, entries: int):
        self.bits = 1 << max(10, (BITS * entries - 1).bit_length())
        self.words = np.zeros(self.bits // 64, np.uint64)

    def _at(self, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        mixed = tk.mix(hashes)
        low, step = mixed, (mixed >> tk.U(32)) | tk.U(1)
        for i in range(PROBES):
            at = (low + step * tk.U(i)) & tk.U(self.bits - 1)
            yield (at >> tk.U(6)).astype(np.int64), tk.U(1) << (at & tk.U(63))

    def add(self, hashes: np.ndarray) -> None:
        for word, bit in self._at(hashes):
            np.bitwise_or.at(self.words, word, bit)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for word, bit in self._at(hashes):
            found &= (self.words[word] & bit) != 0
        return found


class Lines:
    """All lines of a slice of texts: the keys' start and end in ``low``, text index, number in the text."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, min_chars: int = 1):
        breaks = np.flatnonzero(buf == 10)
        self.low = np.take(tk._LOWER, buf)
        self.count = np.bincount(np.searchsorted(offs, breaks, "right") - 1, minlength=len(offs) - 1) + 1
        self.begin = np.sort(np.concatenate([offs[:-1], breaks + 1]))
        self.finish = np.sort(np.concatenate([breaks, offs[1:]]))
        self.doc = np.repeat(np.arange(len(offs) - 1), self.count)
        self.number = np.arange(len(self.doc)) - np.repeat(np.cumsum(self.count) - self.count, self.count)
        self.start, self.end = self.begin.copy(), self.finish.copy()
        full = np.flatnonzero(self.end > self.start)
        padded = full[tk.SPACE[buf[self.start[full]]] | tk.SPACE[buf[self.end[full] - 1]]]
        for i in padded.tolist():
            line = buf[self.begin[i] : self.finish[i]].tobytes()
            left = line.lstrip()
            self.start[i] += len(line) - len(left)
            self.end[i] = self.start[i] + len(left.rstrip())
        points = self.end - self.start
        if min_chars > 1:
            inner = np.zeros(len(buf) + 1, np.int64)
            np.cumsum((buf & 0xC0) == 0x80, out=inner[1:])
            points = points - (inner[self.end] - inner[self.start])
        self.on = points >= max(min_chars, 1)

    def keys(self, distinct: bool) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and positions of the lines with a key; ``distinct``: the first of each document's equal ones."""
        at = np.flatnonzero(self.on)
        h = tk.span_hash(self.low, self.start[at], self.end[at])
        if distinct and len(at):
            size, doc = self.end[at] - self.start[at], self.doc[at]
            order = np.lexsort((at, size, h, doc))
            keep = np.ones(len(order), bool)
            a, b = order[1:], order[:-1]
            keep[1:] = (doc[a] != doc[b]) | (h[a] != h[b]) | (size[a] != size[b])
            order = np.sort(order[keep])
            h, at = h[order], at[order]
        return h, at

    def text(self, at: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Array]]:
        """The keys at positions ``at`` as strings, about a megabyte at a time."""
        size = self.end[at] - self.start[at]
        total, lo = np.cumsum(size), 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + _GATHER, "right")))
            part, n = at[lo:hi], size[lo:hi]
            offsets = np.zeros(len(part) + 1, np.int32)
            np.cumsum(n, out=offsets[1:])
            if len(part) == 1:
                data = self.low[self.start[part[0]] : self.end[part[0]]]
            else:
                data = self.low[np.arange(offsets[-1]) + np.repeat(self.start[part] - offsets[:-1], n)]
            yield part, pa.StringArray.from_buffers(len(part), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))
            lo = hi


def _packs(slots: int, min_chars: int):
    """(slot, hashes, marks) of all distinct keys of documents, a pack at a time."""

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        h, many = np.unique(np.concatenate(held), return_counts=True)
        slot = (tk.mix(h) % tk.U(slots)).astype(np.int32)
        order = np.argsort(slot, kind="stable")
        names, first = np.unique(slot[order], return_index=True)
        cuts = [*first.tolist(), len(order)]
        parts = [order[a:b] for a, b in zip(cuts, cuts[1:])]
        columns = [pa.array(names), pa.array([h[p].tobytes() for p in parts], pa.binary()), pa.array([np.packbits(many[p] > 1).tobytes() for p in parts], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["slot", "hashes", "marks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for _, _, buf, offs in tk.slices(batch.column(0)):
                h, _ = Lines(buf, offs, min_chars).keys(True)
                if len(h):
                    held.append(h)
                    n += len(h)
                if n >= PACK:
                    yield flush(held)
                    held, n = [], 0
        if held:
            yield flush(held)

    return run


def _suspects(table: pa.Table) -> pa.Table:
    """The hashes of a slot that its second filter has."""
    packs = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
    once, twice = Bloom(sum(map(len, packs))), Bloom(sum(map(len, packs)))
    for h, marks in zip(packs, table.column("marks").to_pylist(), strict=True):
        again = np.unpackbits(np.frombuffer(marks, np.uint8), count=len(h)).astype(bool) | once.has(h)
        twice.add(h[again])
        once.add(h)
    found = np.unique(np.concatenate([h[twice.has(h)] for h in packs]))
    return pa.table({"h": pa.array(tk.signed(found))})


def _keyed(min_chars: int, distinct: bool):
    """(row's other columns, h, number, key) of the lines of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, buf, offs in tk.slices(batch.column(0)):
                lines = Lines(buf, offs, min_chars)
                h, at = lines.keys(distinct)
                done = 0
                for part, keys in lines.text(at):
                    row = pa.array(lines.doc[part] + lo)
                    others = [batch.column(i).take(row) for i in range(1, batch.num_columns)]
                    yield pa.RecordBatch.from_arrays(
                        [*others, pa.array(tk.signed(h[done : done + len(part)])), pa.array(lines.number[part].astype(np.int32)), keys], names=[*batch.schema.names[1:], "h", "number", "key"]
                    )
                    done += len(part)

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, gone) to (doc_id, text without those lines, n_lines, n_dropped)."""
    for batch in batches:
        ids, texts, gone = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        many, dropped = [], []
        for i, (text, numbers) in enumerate(zip(texts, gone, strict=True)):
            text = text or ""
            many.append(text.count("\n") + 1)
            dropped.append(len(numbers or ()))
            if numbers:
                without = set(numbers)
                texts[i] = "\n".join(line for n, line in enumerate(text.split("\n")) if n not in without)
        yield pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.string()), pa.array(many, pa.int64()), pa.array(dropped, pa.int64())], names=["doc_id", "text", "n_lines", "n_dropped"])


def repeated_keys(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text", keep_first: bool = False) -> DataFrame:
    """One row per key in at least ``min_docs`` documents: key, n_docs; with ``keep_first`` also its first place (id, sig, number)."""
    texts = docs.select(F.col(text_col).alias("text"))
    n = texts.agg(F.sum(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    slots = max(SLOTS, -(-n // SLOT_LINES))
    packs = texts.mapInArrow(_packs(slots, min_chars), "slot int, hashes binary, marks binary")
    # A key in two documents is the least that the filters can tell.
    suspects = materialize(packs.groupBy("slot").applyInArrow(_suspects, "h long"), "line-suspects") if min_docs > 1 else None
    place = [F.col(id_col).cast("long").alias("id"), _sig(F.col(text_col), F.col(id_col)).alias("sig")] if keep_first else []
    layout = "id long, sig binary, " * keep_first + "h long, number int, key string"
    lines = docs.select(F.col(text_col), *place).mapInArrow(_keyed(min_chars, True), layout)
    if suspects is not None:
        lines = lines.join(sized(suspects), "h", "left_semi")
    first = [F.min(F.struct("id", "sig", "number")).alias("first")] if keep_first else []
    counted = materialize(lines.groupBy("key").agg(F.count("*").alias("n_docs"), *first).where(F.col("n_docs") >= min_docs), "line-keys")
    if suspects is not None:
        discard(suspects)
    return counted


def _sig(text, ident=None):
    whole = F.coalesce(text, F.lit(""))
    return F.unhex(F.md5(whole if ident is None else F.concat(F.coalesce(ident.cast("string"), F.lit("")), F.lit("\n"), whole)))


def drop_repeated_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text", keep_first: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, text without the lines of repeated keys, n_lines (before), n_dropped."""
    hot = repeated_keys(docs, min_docs, min_chars, id_col, text_col, keep_first)
    sig = _sig(F.col(text_col), F.col(id_col) if keep_first else None)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), sig.alias("sig"))
    lines = rows.select("text", "sig").mapInArrow(_keyed(min_chars, False), "sig binary, h long, number int, key string").drop("h")
    lines = lines.join(sized(hot, "key"), "key")
    if keep_first:
        lines = lines.where((F.col("sig") != F.col("first.sig")) | (F.col("number") != F.col("first.number")))
    gone = materialize(lines.groupBy("sig").agg(F.collect_set("number").alias("gone")), "lines-gone")
    # Shuffled at every size: numbers of lines grow with the texts.
    joined = rows.join(gone.hint("merge"), "sig", "left").select("doc_id", "text", "gone")
    return joined.mapInArrow(_kept, "doc_id long, text string, n_lines long, n_dropped long")


def with_digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
