"""Removal of repeated byte strings by prefix-free parsing.

A byte is removed if it lies in a string of ``length`` bytes that also starts anywhere else
in the corpus (same text included); matches never cross texts, overlaps count, and strings are
judged on the input.

Rolling-hash triggers parse each text: the trigger of a position is the least hash of the
``GRAM``-byte grams in the ``WIDTH`` grams from there. It depends on content only, so equal
strings are parsed alike wherever they stand, and every string of ``length`` bytes holds a first
and a last trigger. What lies between them is its core; the strings with the same core in a
row form a block (the core, a phrase's suffix before it and a phrase's prefix after it). A text of
n bytes has some 2 n / 112 blocks, so this dictionary and parse are all that is shuffled.

* A stretch that repeats with a period of at most ``PERIOD`` bytes (a run of one byte, a ruler of dashes) moves the trigger with each
  period. Where it holds all its strings twice, all its bytes go, and only the strings of its first period are parsed, for the other places that have them.
* A core that occurs once rules its block out (most of a corpus ends here).
* A block that occurs twice removes all its bytes.
* A core with several distinct blocks is where a repeat begins or ends. The distinct blocks of such cores, one occurrence each, are the
  dictionary. It is dealt into shards by core, and each shard gets a suffix array to depth ``length`` (exact, by prefix
  doubling over its bytes); neighbours that agree to that depth match.

A block is made so long that every string of ``length`` bytes lies in one. So the order of suffixes is settled within the
dictionary at the depth that is asked for, and of the parse only equal symbols are needed (a group-by), not its suffix array: that
one would order suffixes beyond ``length``. Suffixes of unique cores are left out of the dictionary, since nothing can equal
them. Cores with more than ``LOCAL_BLOCKS`` distinct blocks do not fit a shard; their strings are matched over the cluster by
128-bit fingerprints. Blocks are told apart by 128-bit fingerprints.

Nulls: a null text is empty; null ids are kept. Repeated rows repeat each other's strings.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minutespark.llm import textkit as tk
from minutespark.llm.scratch import discard, materialize, numbered, sized

U = np.uint64
GRAM, WIDTH = 32, 224
SLICE = 1 << 19
#: Longer texts are parsed in parts that overlap by length - 1 bytes.
PART = 1 << 22
#: The longest period whose stretches are taken as one, and the distance at which they are looked for.
PERIOD, GRID = 64, 64
#: Cores with more distinct blocks than this are compared by a shuffle of their strings.
LOCAL_BLOCKS = 2000
POSITION_BITS = 24
#: Bytes of a span that go into one polynomial; longer ones chain those of their parts, as strings of 1024 bytes and more
#: exist that collide under every polynomial modulo 2**64.
SPAN = 128
_BYTES = np.random.default_rng(7).integers(1, 2**63, (2, 256), dtype=np.uint64)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if which not in _tables or len(_tables[which][0]) < n:
        size = 1 << max(20, int(n).bit_length())
        steps = np.empty((2, size), np.uint64)
        steps[0], steps[1] = U(_BASES[which]), U(pow(_BASES[which], -1, 1 << 64))
        steps[:, 0] = 1
        _tables[which] = (np.cumprod(steps[0]), np.cumprod(steps[1]))
    return _tables[which]


class Prefixes:
    """Two independent prefix polynomials of a byte string, for fingerprints of its spans."""

    def __init__(self, buf: np.ndarray):
        self.sums = []
        for which in (0, 1):
            power, _ = _powers(which, len(buf) + 1)
            total = np.zeros(len(buf) + 1, np.uint64)
            np.cumsum(_BYTES[which][buf] * power[: len(buf)], out=total[1:])
            self.sums.append(total)

    def of(self, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        sums, inverse = self.sums[which], _tables[which][1]
        size = end - start
        h = tk.mix(size.astype(np.uint64) + U(which))
        on = slice(None)
        for at in range(0, int(size.max(initial=0)), SPAN):
            if at:
                on = np.flatnonzero(size > at)
            lo = start[on] + at
            h[on] = tk.mix(h[on] * U(3) ^ tk.mix((sums[np.minimum(lo + SPAN, end[on])] - sums[lo]) * inverse[lo]))
        return h


def _triggers(buf: np.ndarray) -> np.ndarray:
    """For each position, that of the least gram among the WIDTH grams from there (leftmost)."""
    h = tk._BYTE[buf]
    base, span = 0x9E3779B97F4A7C15, 1
    while span < GRAM:
        h = h[:-span] * U(pow(base, span, 1 << 64)) + h[span:]
        span *= 2
    h = tk.mix(h)
    h &= ~U((1 << POSITION_BITS) - 1)
    h |= np.arange(len(h), dtype=np.uint64)
    span = 1
    while span * 2 <= WIDTH:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    rest = WIDTH - span
    h = np.minimum(h[: len(h) - rest], h[rest:]) if rest else h
    return (h & U((1 << POSITION_BITS) - 1)).astype(np.int64)


def stretches(buf: np.ndarray, offs: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of stretches within a text that repeat with a period of at most ``PERIOD`` bytes and hold each of their strings
    twice. They are looked for where words, ``GRID`` bytes apart, recur at the period's distance; one that is missed is parsed like other text."""
    found: list[tuple[int, int, int]] = []
    if len(buf) < length + PERIOD:
        return found
    words = np.ndarray((len(buf) - 7,), "<u8", buf, 0, (1,))
    taken = np.zeros(len(buf) // GRID + 1, bool)
    run = (length - 7 - GRID) // GRID + 1
    for period in range(1, PERIOD + 1):
        later = words[period::GRID]
        away = np.flatnonzero(words[::GRID][: len(later)] != later)
        away = np.concatenate([[-1], away, [len(later)]])
        for i in np.flatnonzero(np.diff(away) > run):
            first, last = int(away[i]) + 1, int(away[i + 1]) - 1
            if taken[first] and taken[last]:
                continue
            lo, hi = max(0, first * GRID - GRID), min(len(buf) - period, (last + 1) * GRID + 8)
            differ = buf[lo + period : hi + period] != buf[lo:hi]
            for edge in offs[np.searchsorted(offs, lo, "right") : np.searchsorted(offs, hi + period)]:
                differ[max(0, edge - period - lo) : max(0, edge - lo)] = True
            breaks = np.concatenate([[-1], np.flatnonzero(differ), [len(differ)]])
            for j in np.flatnonzero(np.diff(breaks) > length):
                start, end = lo + int(breaks[j]) + 1, lo + int(breaks[j + 1]) + period
                found.append((start, end, period))
                taken[-(-start // GRID) : -(-end // GRID)] = True
    return found


def blocks(buf: np.ndarray, offs: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Blocks of the texts in ``buf``: text index, first and last string start (within the text),
    core fingerprint and block fingerprint. Of a periodic stretch, the strings of its first period stand for all."""
    if len(buf) < length:
        return {}
    at = _triggers(buf)
    ahead = length - GRAM + 1 - WIDTH
    n = len(buf) - length + 1
    first, last = at[:n], at[ahead : ahead + n]
    valid = np.zeros(n, bool)
    new = np.zeros(n, bool)
    new[1:] = (first[1:] != first[:-1]) | (last[1:] != last[:-1])
    for lo, hi in zip(offs[:-1], offs[1:], strict=True):
        if hi - lo >= length:
            valid[lo : hi - length + 1] = True
            new[lo] = True
    again = np.zeros(n + 1, bool)
    for begin, end, period in stretches(buf, offs, length):
        again[begin + period : end - length + 1] = True
    new[1:] |= again[1:n] != again[: n - 1]
    start = np.flatnonzero(new & valid)
    if not len(start):
        return {}
    doc = np.searchsorted(offs, start, "right") - 1
    stop = np.minimum(np.append(start[1:], n), offs[doc + 1] - length + 1) - 1
    own = ~again[start]
    start, doc, stop = start[own], doc[own], stop[own]
    prefixes = Prefixes(buf)
    core = prefixes.of(0, first[start], last[start] + GRAM)
    inside = (first[start] - start).astype(np.uint64) * U(0xD6E8FEB86659FD93)
    one = prefixes.of(0, start, stop + length) ^ tk.mix(inside)
    two = prefixes.of(1, start, stop + length) ^ tk.mix(inside + U(1))
    return {"doc": doc, "lo": start - offs[doc], "hi": stop - offs[doc], "core": core, "b1": one, "b2": two}


def _parts(batch: pa.RecordBatch, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, place of the first byte in its text, bytes, offsets) of some texts, or of a part of a long one."""
    for lo, hi, buf, offs in tk.slices(batch.column(1), SLICE):
        if hi - lo > 1:
            yield lo, 0, buf, offs
            continue
        for at in range(0, max(1, len(buf) - length + 1), PART):
            part = buf[at : at + PART + length - 1]
            yield lo, at, part, np.array([0, len(part)])


def _parse(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, at, part, offs in _parts(batch, length):
                found = blocks(part, offs, length)
                if found:
                    take = pa.array(found["doc"] + lo)
                    place = (found["lo"] + at) * 1024 + (found["hi"] - found["lo"])
                    columns = [pa.array(tk.signed(found[c])) for c in ("core", "b1", "b2")]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(take), *columns, pa.array(place)], names=["row", "core", "b1", "b2", "place"])

    return run


def _periodic(length: int):
    """The periodic stretches of the parsed parts: every string in one also starts a period away."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, at, part, offs in _parts(batch, length):
                found = stretches(part, offs, length)
                if found:
                    start, end, _ = np.array(found, np.int64).T
                    doc = np.searchsorted(offs, start, "right") - 1
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc + lo)), pa.array(start - offs[doc] + at), pa.array(end - offs[doc] + at)], names=["row", "start", "end"])

    return run


def _cut(length: int):
    """Bytes of the asked-for blocks of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = tk.text_bytes(batch.column("text"))
            for lo in range(0, batch.num_rows, 64):
                out = []
                for i, asked in enumerate(batch.column("asked").slice(lo, 64).to_pylist(), lo):
                    for a in asked:
                        start, more = divmod(a["place"], 1024)
                        out.append((a["core"], a["b1"], a["b2"], buf[offs[i] + start : offs[i] + start + more + length].tobytes()))
                if out:
                    columns = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary())], names=["core", "b1", "b2", "string"])

    return run


def _starts(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a batch's blocks side by side, and of every string of ``length`` bytes its place, block and offset."""
    column = batch.column("string").cast(pa.large_binary())
    offs = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    buf = np.frombuffer(column.buffers()[2], np.uint8)[offs[0] : offs[-1]]
    count = np.diff(offs) - length + 1
    block = np.repeat(np.arange(len(column)), count)
    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return buf, offs[block] - offs[0] + inner, block, inner


def suffix_array(buf: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that begin at ``start`` in lexicographic order of their first ``length`` bytes, and whether each agrees in all of
    them with the one before it. By prefix doubling from ranks of eight bytes; two overlapping halves give the last
    step, so no byte beyond ``length`` counts."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    words = np.ndarray((len(buf),), ">u8", padded, 0, (1,))
    rank, depth = np.unique(words, return_inverse=True)[1], 8
    while depth * 2 <= length:
        behind = np.concatenate([rank[depth:], np.zeros(min(depth, len(rank)), np.int64)])
        rank, depth = np.unique(rank * (int(rank.max()) + 1) + behind, return_inverse=True)[1], depth * 2
    head, tail = rank[start], rank[start + length - depth]
    order = np.lexsort((tail, head))
    same = np.zeros(len(order), bool)
    same[1:] = (head[order[1:]] == head[order[:-1]]) & (tail[order[1:]] == tail[order[:-1]])
    return order, same


def _runs(batch: pa.RecordBatch, block: np.ndarray, inner: np.ndarray) -> pa.RecordBatch:
    """Matched offsets of blocks as ranges."""
    order = np.lexsort((inner, block))
    block, inner = block[order], inner[order]
    new = np.ones(len(block), bool)
    new[1:] = (block[1:] != block[:-1]) | (inner[1:] != inner[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(block)) - 1
    keys = [batch.column(c).take(pa.array(block[first])) for c in ("core", "b1", "b2")]
    return pa.RecordBatch.from_arrays([*keys, pa.array(inner[first]), pa.array(inner[last])], names=["core", "b1", "b2", "begin", "finish"])


def _match(length: int):
    """Rows come in order of cores; those of a core's last rows wait for the next batch."""

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        for batch in table.combine_chunks().to_batches():
            keys = np.stack([batch.column(c).to_numpy() for c in ("core", "b1", "b2")], axis=1)
            _, once = np.unique(keys, axis=0, return_index=True)
            if len(once) < batch.num_rows:
                batch = batch.take(pa.array(np.sort(once)))
            buf, start, block, inner = _starts(batch, length)
            order, same = suffix_array(buf, start, length)
            same[:-1] |= same[1:]
            hit = order[same]
            if len(hit):
                yield _runs(batch, block[hit], inner[hit])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for big in batches:
            for at in range(0, big.num_rows, 1000):
                waiting.append(big.slice(at, 1000))
                size += waiting[-1].num_rows
                if size < 1000:
                    continue
                table = pa.Table.from_batches(waiting)
                core = table.column("core").to_numpy()
                if core[0] == core[-1]:
                    continue
                done = int(np.flatnonzero(core != core[-1])[-1]) + 1
                yield from work(table.slice(0, done))
                waiting, size = table.slice(done).combine_chunks().to_batches(), table.num_rows - done
        if waiting:
            yield from work(pa.Table.from_batches(waiting))

    return run


def _explode(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 1000):
                batch = big.slice(at, 1000)
                buf, start, block, inner = _starts(batch, length)
                prefixes = Prefixes(buf)
                one, two = (prefixes.of(which, start, start + length) for which in (0, 1))
                keys = [batch.column(c).take(pa.array(block)) for c in ("core", "b1", "b2")]
                yield pa.RecordBatch.from_arrays([pa.array(tk.signed(one)), pa.array(tk.signed(two)), *keys, pa.array(inner)], names=["w1", "w2", "core", "b1", "b2", "begin"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlapping and touching spans of a text as one."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        out = []
        for spans in batch.column("spans").to_pylist():
            merged: list[dict] = []
            for s in sorted(spans, key=lambda s: s["start"]):
                if merged and s["start"] <= merged[-1]["end"]:
                    merged[-1]["end"] = max(merged[-1]["end"], s["end"])
                else:
                    merged.append(s)
            out.append(merged)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, kind)], names=["row", "spans"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offs = tk.text_bytes(batch.column("text"))
        out = []
        for i, spans in enumerate(batch.column("spans").to_pylist()):
            data = buf[offs[i] : offs[i + 1]].tobytes()
            kept, at = [], 0
            for s in spans or ():
                kept.append(data[at : s["start"]])
                at = s["end"]
            left = b"".join([*kept, data[at:]])
            out.append((len(data), len(data) - len(left), len(spans or ()), left))
        columns = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def repeated_spans(texts: DataFrame, length: int) -> DataFrame:
    """(row, spans): byte spans to remove, for the rows of ``texts`` (row, text) that have any."""
    key = ["core", "b1", "b2"]
    parsed = texts.select("row", "text").mapInArrow(_parse(length), "row long, core long, b1 long, b2 long, place long")
    # Written out, so that the join's two sides are plain exchanges, whose hot keys Spark can split.
    cores = materialize(parsed.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"), "cores")
    repeated = materialize(parsed.join(cores, "core", "left_semi"), "repeated-cores")
    seen = repeated.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("row", "place")).alias("at"))
    distinct = materialize(seen, "blocks")
    several = materialize(distinct.groupBy("core").agg(F.count("*").alias("blocks")).where("blocks > 1"), "several")
    edges = distinct.join(sized(several), "core").select("blocks", "at", *key)
    asked = edges.groupBy("at.row").agg(F.collect_list(F.struct(*key, "at.place", "blocks")).alias("asked"))
    asked = materialize(asked, "asked")
    cut = texts.join(sized(asked, "asked"), "row").select("text", "asked").mapInArrow(_cut(length), "core long, b1 long, b2 long, string binary")
    hot = materialize(several.where(F.col("blocks") > LOCAL_BLOCKS).select("core"), "hot-cores")
    cut = materialize(cut, "block-strings")
    local = cut.join(sized(hot), "core", "left_anti").repartition("core").sortWithinPartitions("core")
    ranges = local.mapInArrow(_match(length), "core long, b1 long, b2 long, begin long, finish long")
    strings = cut.join(sized(hot), "core", "left_semi").dropDuplicates(key).mapInArrow(_explode(length), "w1 long, w2 long, core long, b1 long, b2 long, begin long")
    twice = strings.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
    far = strings.join(twice, ["w1", "w2"], "left_semi").select(*key, "begin", F.col("begin").alias("finish"))
    whole = distinct.where("n > 1").select(*key, F.lit(0).cast("long").alias("begin"), F.lit(1023).cast("long").alias("finish"))
    flagged = materialize(ranges.union(far).union(whole), "flagged")
    discard(cut, asked, several, hot, cores, distinct)
    lo, more = F.floor(F.col("place") / 1024), F.col("place") % 1024
    spans = repeated.join(flagged, key).select("row", (lo + F.col("begin")).alias("start"), (lo + F.least(F.col("finish"), more) + length).alias("end"))
    spans = spans.union(texts.select("row", "text").mapInArrow(_periodic(length), "row long, start long, end long"))
    spans = spans.groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    spans = materialize(spans.mapInArrow(_merge, spans.schema), "spans")
    discard(flagged, repeated)
    return spans


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes) for every row."""
    if length < GRAM + WIDTH:
        raise ValueError(f"length must be at least {GRAM + WIDTH}")
    texts = numbered(docs, "byte-texts", doc_id=F.col(id_col).cast("long"), text=F.coalesce(F.col(text_col), F.lit("")))
    joined = texts.join(sized(repeated_spans(texts, length), "spans"), "row", "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def with_digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[bytes], length: int) -> list[tuple[int, int, int, str]]:
    """The definition, for tests: (bytes, removed, spans, digest) of each text."""
    count: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            count[t[i : i + length]] = count.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        starts = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((len(t), int(gone.sum()), starts, hashlib.sha256(kept).hexdigest()))
    return out
