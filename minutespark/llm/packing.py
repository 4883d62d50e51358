"""Best-fit packing of token sequences with a bounded number of open bins.

Texts are tokenized where they lie (no shuffle of texts), each distinct word once; longer documents are cut into pieces of the
sequence length. Only the pieces' descriptions, some 50 bytes each, are dealt out by a hash into
packing groups of about ``GROUP_PIECES`` pieces; each group is packed online, in order of (id,
piece), into at most ``open_bins`` open sequences. A bitset keyed by free space finds the open sequence
with the least sufficient space; if none has room and all are in use, the fullest one closes. A
group's state is that bitset and its bins, whatever the group's size.

Nulls: a null text is an empty document (just the end token); a null id is kept. Repeated rows
are packed as often as they come. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minutespark.llm import textkit as tk
from minutespark.llm.scratch import materialize

GROUP_PIECES = 50_000
#: Tokens of a worker's word table (4 bytes each); it is emptied when full, which changes no result.
TABLE_TOKENS = 8_000_000


class WordTokenizer:
    """Token ids of whole slices of texts. The tokenizer drops white space and no token crosses it, so a text's ids are
    those of its white-space-separated words, one after the other. Each distinct word is encoded once and kept in a
    table (hash, place of its ids); the ids of a slice are one gather from it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.words, self.begin, self.count, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        ids, count = [], []
        for at in range(0, len(words), 8192):
            for e in self.tokenizer.encode_batch_fast(words[at : at + 8192], add_special_tokens=False):
                ids.append(array("I", e.ids))
                count.append(len(e.ids))
        count = np.array(count, np.int64)
        at = np.searchsorted(self.words, hashes)
        self.begin = np.insert(self.begin, at, len(self.flat) + np.cumsum(count) - count)
        self.count = np.insert(self.count, at, count)
        self.words = np.insert(self.words, at, hashes)
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(ids), np.uint32).astype("<u4")])

    def ids(self, buf: np.ndarray, offs: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, each text's followed by ``end_id``, and the texts' n + 1 offsets."""
        start, end, doc = tk.word_spans(buf, offs)
        word, first, inverse = np.unique(tk.span_hash(buf, start, end), return_index=True, return_inverse=True)
        if len(self.flat) > TABLE_TOKENS:
            self.clear()
        at = np.searchsorted(self.words, word)
        new = np.flatnonzero(self.words[np.minimum(at, len(self.words) - 1)] != word) if len(self.words) else np.arange(len(word))
        if len(new):
            self._learn(word[new], [buf[start[i] : end[i]].tobytes().decode() for i in first[new]])
            at = np.searchsorted(self.words, word)
        count = self.count[at][inverse]
        running = np.cumsum(count)
        total = int(running[-1]) if len(running) else 0
        place = np.arange(total)
        out = np.full(total + len(offs) - 1, end_id, "<u4")
        out[place + np.repeat(doc, count)] = self.flat[place + np.repeat(self.begin[at][inverse] - running + count, count)]
        sizes = np.bincount(doc, count, len(offs) - 1).astype(np.int64) + 1
        return out, np.concatenate([[0], np.cumsum(sizes)])


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer_for(path: str) -> WordTokenizer:
    """One per worker process, so that its table outlives a task."""
    if path not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def _pieces(path: str, length: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = tokenizer_for(path)
        for batch in batches:
            for lo, hi, buf, offs in tk.slices(batch.column(1)):
                tokens, cut = tokenizer.ids(buf, offs, end_id)
                many = -(-np.diff(cut) // length)
                row = np.repeat(np.arange(hi - lo), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * length
                size = np.minimum(length, np.diff(cut)[row] - start)
                first = cut[row] + start
                parts = [tokens[a:b] for a, b in zip(first.tolist(), (first + size).tolist(), strict=True)]
                columns = [batch.column(0).take(pa.array(row + lo)), pa.array(piece, pa.int32()), pa.array(start), pa.array(size), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                columns += [pa.array([p.tobytes() for p in parts], pa.binary())] * with_ids
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    return run


class OpenBins:
    """Open sequences in a bitset: bit f is set if some open one has f free tokens."""

    def __init__(self, length: int, most: int, first: int):
        self.length, self.most, self.next, self.free, self.count = length, most, first, 0, 0
        self.bins: dict[int, list[int]] = {}

    def _take(self, free: int) -> int:
        held = self.bins[free]
        found = held.pop()
        if not held:
            del self.bins[free]
            self.free &= ~(1 << free)
        self.count -= 1
        return found

    def _put(self, sequence: int, free: int) -> None:
        self.bins.setdefault(free, []).append(sequence)
        self.free |= 1 << free
        self.count += 1

    def place(self, size: int) -> tuple[int, int]:
        """(sequence, offset) of a piece of ``size`` tokens."""
        fitting = self.free >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            sequence = self._take(free)
        else:
            if self.count >= self.most:
                self._take((self.free & -self.free).bit_length() - 1)
            sequence, free = self.next, self.length
            self.next += 1
        if free > size:
            self._put(sequence, free - size)
        return sequence, self.length - free


def _pack(length: int, open_bins: int):
    """Rows come grouped by packing group, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, bins = None, None
        for batch in batches:
            groups, sizes = batch.column("group").to_pylist(), batch.column("length").to_pylist()
            sequences, offsets = [], []
            for group, size in zip(groups, sizes, strict=True):
                if group != current:
                    current, bins = group, OpenBins(length, open_bins, group << 36)
                sequence, offset = bins.place(size)
                sequences.append(sequence)
                offsets.append(offset)
            kept = batch.drop_columns(["group"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64())], names=[*kept.schema.names, "sequence_id", "offset"])

    return run


def pack_documents(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = 4096, end_id: int = 1, open_bins: int = 1024, with_ids: bool = False
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; with
    ``with_ids`` also the piece's ids (little-endian unsigned 32-bit)."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    layout = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    pieces = slim.mapInArrow(_pieces(tokenizer_path, length, end_id, with_ids), layout)
    # The row number deals out pieces with null or repeated ids, too.
    pieces = materialize(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-pieces.count() // GROUP_PIECES))
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups))).drop("row")
    dealt = dealt.repartition(groups, "group").sortWithinPartitions("group", "doc_id", "piece", "ids_crc32")
    return dealt.mapInArrow(_pack(length, open_bins), layout + ", sequence_id long, offset long")
