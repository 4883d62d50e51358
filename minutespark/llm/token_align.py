"""Alignment of two tokenizers' tokens over the same bytes, by pointer jumping, and how often ids are linked.

A text, with a space before it, is encoded by A (byte-level BPE) and B (pieces with byte fallback). Both sequences of tokens
tile its bytes; the offsets where a token of each ends cut them into groups. Every token points to its farthest-right
overlapping token (at equal ends to B's); doubling the successors, all tokens at once, leads each to the last token
of its group, which names the group. An A and a B token of one group are linked; an id pair's count is the number of
documents of the corpus that hold it linked.

1. Tasks cut texts into chunks at single spaces between other characters. Neither tokenizer has a token across such a space,
   so tokens, groups and links of a text are those of its chunks, and a block of about ``BLOCK`` bytes of texts encodes each
   distinct chunk once. A block writes one row per text (its chunks) and one with its distinct pairs, their documents in the
   block, and which chunk has which pairs.
2. Blocks' pairs are added up over the cluster (each block has a pair once, so no pair is hot), the highest count of each A id
   is found (a table no larger than A's vocabulary, and so broadcast), and both go back to the blocks that hold the pair.
3. A block's texts sum the counts of their chunks. No table of all pairs is sent to any task.

Null and empty texts, and texts whose tokens do not give back their bytes (B turns U+2581 into a space), have no tokens: zeros, and an
empty groups string. Every row gives one row, repeated and null ids too; each counts as a document. Extra columns are ignored.
Memory of a task: a block, or the longest text; links of a group are counted by distinct ids, not by occurrence.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minutespark.llm import textkit as tk
from minutespark.llm.scratch import discard, materialize

#: Bytes of texts of a block; bytes of distinct chunks that are encoded at once; links that are expanded at once.
BLOCK, ENCODE, EXPAND = 8 << 20, 1 << 16, 1 << 20
_LAYOUT = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, chunks binary, pairs array<long>, docs array<int>, held binary"
_EMPTY = np.zeros(0, np.int64)
#: Bytes that may begin a white space character of more than one byte.
_WIDE_SPACE = (0xC2, 0xE1, 0xE2, 0xE3)


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves, the others as code points from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tokenizers:
    """Both tokenizers of a Python worker, and the bytes of their tokens."""

    _known: dict[tuple[str, str], Tokenizers] = {}

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        to_byte = _byte_of_char()
        with open(path_a, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        known = {i: bytes(map(to_byte.__getitem__, t)) for t, i in vocabulary.items() if all(c in to_byte for c in t)}
        self.bytes_a = [known.get(i, b"") for i in range(max([*known, *vocabulary.values()]) + 1)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in known]) for known in (self.bytes_a, self.bytes_b))
        self.fast = None
        #: ``id,`` ``id|`` and ``id;`` of each id.
        self.shown = [f"{i}{mark}" for i in range(max(len(self.bytes_a), len(self.bytes_b))) for mark in ",|;"]
        self._ranked()

    def _ranked(self) -> None:
        """The same byte-level BPE by ranks, where the installed encoder takes it: some four times as fast."""
        import tiktoken

        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        ranks = {b: i for i, b in enumerate(self.bytes_a) if b and self.a.id_to_token(i) not in special}
        single = sorted(i for b, i in ranks.items() if len(b) == 1)
        if single == list(range(256)) and sorted(ranks.values()) == list(range(len(ranks))):
            self.fast = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def of(cls, path_a: str, path_b: str) -> Tokenizers:
        if (path_a, path_b) not in cls._known:
            cls._known[path_a, path_b] = cls(path_a, path_b)
        return cls._known[path_a, path_b]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of A for space and text and of B for text (it adds the space), or None if their bytes differ from it."""
        spaced = " " + text
        a = self.fast.encode_ordinary(spaced) if self.fast else self.a.encode(spaced, add_special_tokens=False).ids
        b = self.b.encode(text)
        whole = spaced.encode()
        if b"".join(map(self.bytes_b.__getitem__, b)) != whole or b"".join(map(self.bytes_a.__getitem__, a)) != whole:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)


def chunk_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text of the chunks, each without the space before it (the first has the one that is put before a text)."""
    n = len(offs) - 1
    at = np.flatnonzero(buf == 0x20)
    doc = np.searchsorted(offs, at, "right") - 1
    inner = (at > offs[doc]) & (at + 1 < offs[doc + 1])
    at, doc = at[inner], doc[inner]
    before, after = buf[at - 1], buf[at + 1] if len(at) else at
    cut = (before > 0x20) & (after > 0x20) & ~np.isin(after, _WIDE_SPACE)
    at, doc = at[cut], doc[cut]
    full = np.flatnonzero(np.diff(offs) > 0)
    start = np.concatenate([offs[full], at + 1])
    end = np.concatenate([offs[full + 1], at])
    which = np.concatenate([full, doc])
    order = np.argsort(start, kind="stable")
    return start[order], np.sort(end), which[order] if n else which


class Chunks:
    """Tokens, groups and links of distinct chunks of texts."""

    def __init__(self, tokenizers: Tokenizers, texts: list[str]):
        """Chunks are encoded together, with spaces between; those that do not come back one by one."""
        self.valid = np.ones(len(texts), bool)
        self.t = tokenizers
        ids: list[list[np.ndarray]] = [[], []]
        counts = [np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)]
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) < ENCODE):
                size += len(texts[hi]) + 1
                hi += 1
            self._encode(texts, lo, hi, ids, counts)
            lo = hi
        self.a, self.b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in ids)
        self.n_a, self.n_b = counts
        self._group()

    def _encode(self, texts: list[str], lo: int, hi: int, ids: list, counts: list) -> None:
        joined = self.t.encode(" ".join(texts[lo:hi])) if all(x and x[0] > " " and x[-1] > " " for x in texts[lo:hi]) else None
        if joined is not None:
            ends = np.cumsum([len(x.encode()) + 1 for x in texts[lo:hi]])
            stop = []
            for tokens, size in zip(joined, (self.t.size_a, self.t.size_b), strict=True):
                at = np.cumsum(size[tokens])
                stop.append(np.searchsorted(at, ends))
                if not np.array_equal(at[stop[-1]], ends):
                    joined = None
                    break
        if joined is not None:
            for side in (0, 1):
                ids[side].append(joined[side])
                counts[side][lo:hi] = np.diff(stop[side] + 1, prepend=0)
        elif hi - lo > 1:
            mid = (lo + hi) // 2
            self._encode(texts, lo, mid, ids, counts)
            self._encode(texts, mid, hi, ids, counts)
        else:
            alone = self.t.encode(texts[lo])
            self.valid[lo] = alone is not None
            for side in (0, 1) if alone else ():
                ids[side].append(alone[side])
                counts[side][lo] = len(alone[side])

    def _group(self) -> None:
        last = farthest(np.cumsum(self.t.size_a[self.a]), np.cumsum(self.t.size_b[self.b]))
        ends = np.zeros(len(last), bool)
        ends[last] = True
        group = (np.cumsum(ends) - 1)[last]
        self.group_a, self.group_b = group[: len(self.a)], group[len(self.a) :]
        self.groups = int(group.max()) + 1 if len(group) else 0
        self.per_a, self.per_b = (np.bincount(x, minlength=self.groups) for x in (self.group_a, self.group_b))
        chunk = np.repeat(np.arange(len(self.n_b)), self.n_b)
        first = np.ones(len(self.group_b), bool)
        first[1:] = self.group_b[1:] != self.group_b[:-1]
        self.chunk_of = chunk[first]
        self.n_groups = np.bincount(self.chunk_of, minlength=len(self.n_b))
        self.n_links = np.zeros(len(self.n_b), np.int64)
        np.add.at(self.n_links, self.chunk_of, self.per_a * self.per_b)

    def strings(self) -> list[str]:
        """``a1,a2|b1;a3|b2;`` of each chunk."""
        group = np.concatenate([self.group_a, self.group_b])
        side = np.repeat([0, 1], [len(self.a), len(self.b)])
        order = np.lexsort((np.arange(len(group)), side, group))
        ids = np.concatenate([self.a, self.b])[order]
        last = np.ones(len(order), bool)
        last[:-1] = (group[order][1:] != group[order][:-1]) | (side[order][1:] != side[order][:-1])
        mark = np.where(last, 1 + side[order], 0)
        shown = list(map(self.t.shown.__getitem__, (3 * ids + mark).tolist()))
        cuts = np.concatenate([[0], np.cumsum(self.n_a + self.n_b)]).tolist()
        return ["".join(shown[a:b]) for a, b in zip(cuts, cuts[1:])]

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(chunk, pair, times), by chunk: pairs of distinct ids of a group, a << 32 | b."""
        sides = []
        for ids, group in ((self.a, self.group_a), (self.b, self.group_b)):
            key, times = tally(group << 32 | ids)
            sides.append((key & 0xFFFFFFFF, times, np.searchsorted(key >> 32, np.arange(self.groups + 1))))
        (a, times_a, cut_a), (b, times_b, cut_b) = sides
        each_a, each_b = np.diff(cut_a), np.diff(cut_b)
        total, out, lo = np.cumsum(each_a * each_b), [], 0
        while lo < self.groups:
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + EXPAND, "right")))
            n = (each_a * each_b)[lo:hi]
            group = np.repeat(np.arange(lo, hi), n)
            at = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
            i, j = cut_a[group] + at // each_b[group], cut_b[group] + at % each_b[group]
            out.append((self.chunk_of[group], a[i] << 32 | b[j], times_a[i] * times_b[j]))
            lo = hi
        return tuple(np.concatenate([_EMPTY, *(x[k] for x in out)]) for k in range(3))


def tally(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[first], np.diff(np.append(first, len(keys)))


def farthest(end_a: np.ndarray, end_b: np.ndarray) -> np.ndarray:
    """For all tokens (A's, then B's) the terminal one of their group: pointer jumping over farthest-right overlapping tokens."""
    n = len(end_a)
    if not n:
        return _EMPTY
    to_b = np.searchsorted(end_b, end_a)  # the token of B that holds the last byte of one of A
    to_a = np.searchsorted(end_a, end_b)
    own = np.arange(n, n + len(end_b))
    successor = np.concatenate([n + to_b, np.where(end_a[to_a] > end_b, to_a, own)])
    while True:
        ahead = successor[successor]
        if np.array_equal(ahead, successor):
            return successor
        successor = ahead


def _blocks(path_a: str, path_b: str, with_groups: bool):
    def block(number: int, ids: pa.Array, column: pa.Array) -> Iterator[pa.RecordBatch]:
        buf, offs = tk.text_bytes(column)
        n = len(offs) - 1
        start, end, doc = chunk_spans(buf, offs)
        h = tk.span_hash(buf, start, end)
        _, first, which = np.unique(h, return_index=True, return_inverse=True)
        texts = [buf[a:b].tobytes().decode() for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        chunks = Chunks(Tokenizers.of(path_a, path_b), texts)
        bad = np.zeros(n, bool)
        bad[doc[~chunks.valid[which]]] = True
        keep = ~bad[doc]
        doc, which = doc[keep], which[keep]
        sums = []
        for each in (chunks.n_a, chunks.n_b, chunks.n_groups, chunks.n_links):
            total = np.zeros(n, np.int64)
            np.add.at(total, doc, each[which])
            sums.append(pa.array(total))
        cuts = np.searchsorted(doc, np.arange(n + 1)).tolist()
        shown = chunks.strings()
        names, refs = [], []
        for a, b in zip(cuts, cuts[1:]):
            own = which[a:b]
            name = "".join([shown[i] for i in own.tolist()])[:-1]
            names.append(name if with_groups or not name else hashlib.sha256(name.encode()).hexdigest())
            refs.append(np.diff(np.sort(own), prepend=0).astype(np.int32).tobytes())
        chunk, pair, times = chunks.links()
        pairs, _ = tally(pair)
        at = np.searchsorted(pairs, pair)
        ends = np.searchsorted(chunk, np.arange(len(texts) + 1))
        docs = _documents_of(doc, which, ends, at, len(pairs))
        found = docs > 0
        place = np.cumsum(found) - 1
        held = found[at]
        ends = np.concatenate([[0], np.cumsum(held)])[ends]
        packed = np.concatenate([[len(texts), found.sum()], ends, place[at[held]]]).astype(np.int32).tobytes() + times[held].tobytes()
        packed = len(packed).to_bytes(8, "little") + pa.compress(packed, "zstd", asbytes=True)
        blocks = pa.array(np.full(n, number, np.int64))
        none = [pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.binary())]
        order = [f.split()[0] for f in _LAYOUT.split(", ")]
        yield pa.RecordBatch.from_arrays([blocks, ids, *sums, pa.array(names, pa.string()), pa.array(refs, pa.binary()), *none], names=order)
        one = [pa.array([number], pa.int64()), *(pa.nulls(1, pa.int64()) for _ in range(5)), pa.nulls(1, pa.string()), pa.nulls(1, pa.binary())]
        tables = [pa.array([pairs[found]], pa.list_(pa.int64())), pa.array([docs[found].astype(np.int32)], pa.list_(pa.int32())), pa.array([packed], pa.binary())]
        yield pa.RecordBatch.from_arrays([*one, *tables], names=order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0
        for batch in batches:
            column = batch.column(1).cast(pa.large_string())
            _, offs = tk.text_bytes(column)
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + BLOCK - size, "right")) - 1)
                ids.append(batch.column(0).slice(lo, hi - lo))
                texts.append(column.slice(lo, hi - lo))
                size += int(offs[hi] - offs[lo])
                lo = hi
                if size >= BLOCK or lo < batch.num_rows:
                    yield from block(number, pa.concat_arrays(ids), pa.concat_arrays(texts))
                    number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield from block(number, pa.concat_arrays(ids), pa.concat_arrays(texts))

    return run


def _documents_of(doc: np.ndarray, which: np.ndarray, ends: np.ndarray, pair: np.ndarray, n: int) -> np.ndarray:
    """In how many documents each of n pairs is; doc, which: chunk occurrences by document; ends, pair: pairs by chunk."""
    docs = np.zeros(n, np.int64)
    each = np.cumsum(np.diff(ends)[which])
    lo = 0
    while lo < len(doc):
        hi = int(np.searchsorted(each, (each[lo - 1] if lo else 0) + EXPAND, "right"))
        hi = int(np.searchsorted(doc, doc[min(max(hi, lo), len(doc) - 1)], "left"))  # whole documents
        if hi <= lo:
            hi = int(np.searchsorted(doc, doc[lo], "right"))
        key, _ = tally(doc[lo:hi] << 32 | which[lo:hi])
        d, c = key >> 32, key & 0xFFFFFFFF
        m = np.diff(ends)[c]
        at = np.repeat(ends[c] - np.cumsum(m) + m, m) + np.arange(m.sum())
        docs += np.bincount(tally(np.repeat(d - doc[lo], m) * n + pair[at])[0] % max(n, 1), minlength=n)
        lo = hi
    return docs


def _totals(rows: pa.Table, counts: pa.Table) -> pa.Table:
    """Sums of the counts, and links with the highest count, of a block's texts."""
    head = rows.filter(rows.column("held").is_valid())
    texts = rows.filter(rows.column("held").is_null())
    packed = head.column("held")[0].as_py()
    packed = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), "zstd", asbytes=True)
    chunks, pairs = np.frombuffer(packed, np.int32, 2).tolist()
    ends = np.frombuffer(packed, np.int32, chunks + 1, 8)
    at = np.frombuffer(packed, np.int32, ends[-1], 12 + 4 * chunks)
    times = np.frombuffer(packed[12 + 4 * (chunks + ends[-1]) :], np.int64)
    values = []
    for name in ("total", "best"):
        by_pair = np.zeros(pairs, np.int64)
        by_pair[counts.column("at").to_numpy()] = counts.column(name).to_numpy().astype(np.int64)
        sums = np.concatenate([[0], np.cumsum(by_pair[at] * times)])[ends]
        values.append(np.diff(sums))
    own = [np.cumsum(np.frombuffer(x, np.int32), dtype=np.int64) for x in texts.column("chunks").to_pylist()]
    count_sum, n_best = ([int(v[x].sum()) for x in own] for v in values)
    kept = texts.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    return kept.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64())).append_column("groups", texts.column("groups"))


def _pair_counts(blocks: DataFrame) -> DataFrame:
    pairs = blocks.where(F.col("held").isNotNull()).select(F.explode(F.arrays_zip("pairs", "docs")).alias("p"))
    return pairs.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.docs").alias("total"))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b (tokens), n_groups, n_links, n_best, count_sum and groups: the SHA-256 of
    ``a1,a2|b1;a3|b2,b3`` (ids in order), or that string itself (``with_groups``)."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    blocks = materialize(slim.mapInArrow(_blocks(path_a, path_b, with_groups), _LAYOUT), "aligned")
    counts = materialize(_pair_counts(blocks), "aligned-pairs")
    id_a = F.shiftright("pair", 32)
    # At most one row for each id of A.
    best = F.broadcast(counts.groupBy(id_a.alias("a")).agg(F.max("total").alias("highest")))
    counts = counts.withColumn("a", id_a).join(best, "a").select("pair", "total", (F.col("total") == F.col("highest")).alias("best"))
    held = blocks.where(F.col("held").isNotNull()).select(F.col("block").alias("to"), F.posexplode("pairs").alias("at", "pair"))
    # Shuffled at every size: pairs grow with the corpus.
    back = held.join(counts.hint("merge"), "pair").select("to", "at", "total", "best")
    rows = blocks.drop("pairs", "docs")
    layout = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    return rows.groupBy("block").cogroup(back.groupBy("to")).applyInArrow(_totals, layout)


def pair_counts(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per linked pair of ids: a_id, b_id, n_docs."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    blocks = materialize(slim.mapInArrow(_blocks(path_a, path_b, False), _LAYOUT), "aligned")
    counts = materialize(_pair_counts(blocks), "aligned-pairs")
    discard(blocks)
    return counts.select(F.shiftright("pair", 32).alias("a_id"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b_id"), F.col("total").alias("n_docs"))


def with_digest(found: DataFrame) -> DataFrame:
    return found.withColumnRenamed("groups", "groups_sha256")
