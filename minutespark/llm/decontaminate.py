"""Benchmark decontamination by SimHash of item-sized windows.

Windows of a text that have an item's size are fingerprinted (64-bit SimHash of their words). Items
are dealt into size classes in steps of a sixth; an item stands in the index with the fingerprint of
each of its own windows of the class's size, in its own class and in all smaller ones down to ``threshold`` of its words, so
that texts which are shorter than the item's class are looked at too. A fingerprint is cut into blocks, half as many as the
``radius`` of its class has bits; two that differ in at most so many bits agree in some block up to one bit, so looking
every block up together with its one-bit neighbours finds all pairs within the radius. Each pair found is
aligned and verified exactly: the item's k-word shingles against those of the text's window of
the item's length, weighted by how often they occur, must reach ``threshold`` (weighted Jaccard). A window that shares no
shingle with any item cannot reach it, so only windows around a shared one are fingerprinted, which loses nothing.

Items are indexed in blocks of at most ``ITEM_BYTES`` (a stated query set against all rows), so the index in
a task is bounded; texts are scanned where they lie and only hits are shuffled.

Words are split at ASCII white space and lower-cased (A-Z). An item with fewer than k words has its word
sequence as its only shingle. Nulls: null or empty texts and items match nothing; null ids are
kept. Repeated rows give one result. Of windows that are equally similar the first counts. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minutespark.llm import textkit as tk
from minutespark.llm.scratch import neutral

ITEM_BYTES = 8 << 20
#: Words of a text that are fingerprinted at a time.
CHUNK = 1 << 14
#: Pairs of fingerprints that are compared at a time.
PAIRS = 1 << 20
U = np.uint64


def radius(size: int) -> int:
    """Bits in which fingerprints of windows of ``size`` words may differ. One word of a short window turns more of them."""
    return 15 if size < 28 else 11


def size_class(n: int) -> int:
    """The largest class not above n words: all sizes up to 6, then steps of a sixth."""
    c = 1
    while (nxt := c + max(1, c // 6)) <= n:
        c = nxt
    return c


def window_prints(words: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(size, fingerprints of all windows of that many words)."""
    bits = np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1)
    for kind, most in ((np.uint8, 255), (np.uint32, 1 << 32)):  # sums wrap, but their differences hold
        some = [s for s in sizes if s <= min(most, len(words)) and (kind is np.uint8 or s > 255)]
        if not some:
            continue
        ones = np.zeros((len(words) + 1, 64), kind)
        np.cumsum(bits, axis=0, dtype=kind, out=ones[1:])
        for size in some:
            yield size, np.packbits((ones[size:] - ones[:-size]) > size // 2, axis=1).view(np.uint64).ravel()


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two bags of shingle hashes."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    common = int(np.minimum(n[i], m[j]).sum())
    return common / (len(a) + len(b) - common) if len(a) + len(b) else 0.0


def _blocks(prints: np.ndarray, size: int) -> list[tuple[np.ndarray, int]]:
    """The fingerprints' blocks (values, bits of each)."""
    n = (radius(size) + 1) // 2
    edges = [64 * i // n for i in range(n + 1)]
    return [(((prints >> U(lo)) & U((1 << (hi - lo)) - 1)).astype(np.int64), hi - lo) for lo, hi in zip(edges, edges[1:], strict=False)]


def _grams(words: np.ndarray, n: int, k: int) -> np.ndarray:
    """Hashes of all n-word shingles, as ``textkit.shingles`` has them."""
    acc = np.full(max(0, len(words) - n + 1), 0 if n == k else n, np.uint64)
    for j in range(n):
        acc = acc * tk._BASE + words[j : len(words) - n + 1 + j]
    return tk.mix(acc)


class Index:
    """Fingerprints of items by size class, with a table for each block, and the items' shingles."""

    def __init__(self, ids: list[int], texts: list[str], k: int, threshold: float = 0.8):
        self.ids, self.k = ids, k
        column = pa.array(texts, pa.string())
        buf, offs = tk.text_bytes(column)
        words, doc = tk.word_hashes(buf, offs)
        cut = np.searchsorted(doc, np.arange(len(ids) + 1))
        self.words = [words[cut[i] : cut[i + 1]] for i in range(len(ids))]
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.bags = [tk.shingles(w, np.zeros(len(w), np.int64), k)[0] for w in self.words]
        self.grams = {}
        for n in {min(k, int(m)) for m in self.lengths} - {0}:
            held = np.unique(np.concatenate([b for b, m in zip(self.bags, self.lengths, strict=True) if min(k, m) == n]))
            seen = np.zeros(1 << 20, bool)
            seen[(held & U((1 << 20) - 1)).astype(np.int64)] = True
            self.grams[n] = held, seen
        self.classes: dict[int, dict] = {}
        by_class: dict[int, list[tuple[np.ndarray, int]]] = {}
        for i, w in enumerate(self.words):
            if len(w):
                for c, prints in window_prints(w, sorted({size_class(m) for m in range(max(1, int(threshold * len(w))), len(w) + 1)})):
                    by_class.setdefault(c, []).append((prints, i))
        for c, found in by_class.items():
            prints = np.concatenate([p for p, _ in found])
            item = np.concatenate([np.full(len(p), i) for p, i in found])
            offset = np.concatenate([np.arange(len(p)) for p, _ in found])
            tables = []
            for block, bits in _blocks(prints, c):
                near = (block[:, None] ^ np.array([0, *(1 << b for b in range(bits))])).ravel()
                order = np.argsort(near, kind="stable")
                count = np.bincount(near, minlength=1 << bits)
                tables.append((count > 0, count, np.cumsum(count) - count, order // (bits + 1)))
            self.classes[c] = {"prints": prints, "item": item, "offset": offset, "tables": tables}

    def near(self, words: np.ndarray, doc: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """Places of the words within the longest item's length of a shingle that some item has, in the same text."""
        edge = np.zeros(len(words) + 1, np.int64)
        reach = int(self.lengths.max(initial=0))
        for n, (held, seen) in self.grams.items():
            gram = _grams(words, n, self.k)
            at = np.flatnonzero(seen[(gram & U((1 << 20) - 1)).astype(np.int64)])
            at = at[held[np.minimum(np.searchsorted(held, gram[at]), len(held) - 1)] == gram[at]]
            at = at[doc[at] == doc[at + n - 1]]
            np.add.at(edge, np.maximum(at - reach, cut[doc[at]]), 1)
            np.add.at(edge, np.minimum(at + n + reach, cut[doc[at] + 1]), -1)
        return np.flatnonzero(np.cumsum(edge[:-1]) > 0)

    def search(self, words: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Size, window start, item and the window's place in the item, of all pairs within the radius."""
        for size, prints in window_prints(words, list(self.classes)):
            c = self.classes[size]
            for (block, _), (held, count, start, entry) in zip(_blocks(prints, size), c["tables"], strict=True):
                at = np.flatnonzero(held[block])
                if not len(at):
                    continue
                for at in np.split(at, np.flatnonzero(np.diff(np.cumsum(count[block[at]]) // PAIRS)) + 1):  # some windows at a time
                    n = count[block[at]]
                    where = np.repeat(at, n)
                    inner = np.arange(len(where)) - np.repeat(np.cumsum(n) - n, n)
                    which = entry[start[block[where]] + inner]
                    close = np.bitwise_count(prints[where] ^ c["prints"][which]) <= radius(size)
                    if close.any():
                        where, which = where[close], which[close]
                        yield size, where, c["item"][which], c["offset"][which]

    def hits(self, words: np.ndarray, doc: np.ndarray, cut: np.ndarray, threshold: float) -> dict[tuple[int, int], tuple[float, int, int]]:
        """Best (similarity, first word, words) for each text and item; texts lie side by side."""
        tried: set[tuple[int, int]] = set()
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        widest = max(self.classes, default=1)
        place = self.near(words, doc, cut)
        region = np.cumsum(np.concatenate([[0], (np.diff(place) > 1) | (np.diff(doc[place]) > 0)]))[: len(place)]
        some = words[place]
        for lo in range(0, len(some), CHUNK):
            for size, where, item, offset in self.search(some[lo : lo + CHUNK + widest - 1]):
                where = where + lo
                inside = region[where + size - 1] == region[where]
                where, item, offset = place[where[inside]], item[inside], offset[inside]
                own = doc[where]
                start = np.maximum(np.minimum(where - offset, cut[own + 1] - self.lengths[item]), cut[own])
                for pair in set(zip(start.tolist(), item.tolist(), own.tolist(), strict=True)).difference(tried):
                    tried.add(pair)
                    at, i, d = pair
                    window = words[at : min(at + self.lengths[i], cut[d + 1])]
                    bag = tk.shingles(window, np.zeros(len(window), np.int64), self.k)[0]
                    similarity = weighted_similarity(self.bags[i], bag)
                    found = (similarity, int(cut[d]) - at, len(window))
                    if similarity >= threshold and found > best.get((d, i), (0.0, 0, 0)):
                        best[d, i] = found
        return best

    def scan(self, column: pa.Array, threshold: float) -> Iterator[tuple[int, int, float, int, int]]:
        """Row, item, similarity, first word and words of every text and item that it holds."""
        for lo, hi, buf, offs in tk.slices(column):
            words, doc = tk.word_hashes(buf, offs)
            cut = np.searchsorted(doc, np.arange(hi - lo + 1))
            for (d, item), (similarity, back, n) in self.hits(words, doc, cut, threshold).items():
                yield lo + d, item, similarity, -back, n


def _scan(index: Index, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            out = [(ids[row].as_py(), index.ids[item], *rest) for row, item, *rest in index.scan(batch.column(1), threshold)]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "item_id", "similarity", "first_word", "n_words"])

    return run


def _keep(index: Index, threshold: float, text_at: int):
    """The rows that hold no item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            clean[[row for row, *_ in index.scan(batch.column(text_at), threshold)]] = False
            yield batch.filter(pa.array(clean))

    return run


def _indexes(items: DataFrame, item_id: str, item_text: str, k: int, threshold: float) -> Iterator[Index]:
    """One index for each block of items."""
    probes = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("text is not null")
    total = probes.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-total // ITEM_BYTES))
    for block in range(blocks):
        part = probes.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).distinct().toArrow()
        index = Index(part.column(0).to_pylist(), part.column(1).to_pylist(), k, threshold)
        if index.classes:
            yield index


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row for each id and item that its text holds: doc_id, item_id, similarity, first_word,
    n_words (the best window)."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    layout = "doc_id long, item_id long, similarity double, first_word long, n_words long"
    found = docs.sparkSession.createDataFrame([], layout)
    for index in _indexes(items, item_id, item_text, k, threshold):
        found = found.union(slim.mapInArrow(_scan(index, threshold), layout))
    best = F.max(F.struct("similarity", (-F.col("first_word")).alias("first"), "n_words")).alias("best")
    merged = found.groupBy("doc_id", "item_id").agg(best)
    return merged.select("doc_id", "item_id", "best.similarity", (-F.col("best.first")).alias("first_word"), "best.n_words")


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that hold no item. Each row is judged by its own text, whatever its id."""
    rows, (text,) = neutral(docs, text_col)
    for index in _indexes(items, item_id, item_text, k, threshold):
        rows = rows.mapInArrow(_keep(index, threshold, rows.columns.index(text)), rows.schema)
    return rows.toDF(*docs.columns)
