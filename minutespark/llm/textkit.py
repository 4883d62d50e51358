"""Vectorised word and shingle hashing over Arrow string columns.

Texts are taken as UTF-8 bytes; a null text counts as empty. All functions work on slices of
about a megabyte, so memory is bounded by that or by the longest single text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
U = np.uint64
_BASE = U(0x9E3779B97F4A7C15 | 1)
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)
#: Words of more bytes are hashed one by one.
LONG = 256
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply)."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and their n + 1 offsets."""
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, offsets


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of consecutive rows of about ``most`` bytes."""
    buf, offs = text_bytes(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + most, "right")) - 1
        hi = min(max(hi, lo + 1), n, lo + 4096)
        yield lo, hi, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (bytes) and text index of all words ``[^\\x20\\x09-\\x0D]+``."""
    if not len(buf):
        return (np.zeros(0, np.int64),) * 3
    on = ~SPACE[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[offs] = True
    begin, end = on.copy(), on.copy()
    begin[1:] &= ~on[:-1] | first[1:-1]
    end[:-1] &= ~on[1:] | first[1:-1]
    start = np.flatnonzero(begin)
    return start, np.flatnonzero(end) + 1, np.searchsorted(offs, start, "right") - 1


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of byte spans: eight bytes at a time go through the finalizer in a chain, so no algebraic
    relation between strings carries over. Spans over ``LONG`` bytes are hashed by BLAKE2b."""
    size = end - start
    h = mix(size.astype(np.uint64) + U(0xD6E8FEB86659FD93))
    if not len(size):
        return h
    padded = np.zeros(len(buf) + 8, np.uint8)
    np.take(_LOWER, buf, out=padded[: len(buf)]) if lower else padded.__setitem__(slice(len(buf)), buf)
    words = np.ndarray((len(buf) + 1,), "<u8", padded, 0, (1,))
    on, at = np.flatnonzero(size <= LONG), 0
    while len(on):
        value = words[start[on] + at] & _MASK[np.minimum(size[on] - at, 8)]
        h[on] = mix(h[on] * U(3) ^ value)
        at += 8
        on = on[size[on] > at]
    for i in np.flatnonzero(size > LONG):
        h[i] = int.from_bytes(hashlib.blake2b(padded[start[i] : end[i]], digest_size=8).digest(), "little")
    return h


def word_hashes(buf: np.ndarray, offs: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text index of every word, in order."""
    start, end, doc = word_spans(buf, offs)
    return span_hash(buf, start, end, lower), doc


def shingles(words: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles and their text; a text with 1 to k - 1 words has its whole
    word sequence as the only one."""
    parts = []
    if len(words) >= k:
        acc = np.zeros(len(words) - k + 1, np.uint64)
        for j in range(k):
            acc = acc * _BASE + words[j : len(words) - k + 1 + j]
        whole = doc[: len(acc)] == doc[k - 1 :]
        parts.append((mix(acc[whole]), doc[: len(acc)][whole]))
    which, first, count = np.unique(doc, return_index=True, return_counts=True)
    for d, at, n in zip(which[count < k], first[count < k], count[count < k], strict=True):
        acc = np.full(1, n, np.uint64)
        for j in range(n):
            acc = acc * _BASE + words[at + j : at + j + 1]
        parts.append((mix(acc), np.full(1, d)))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def distinct_shingles(words: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles without repeats in a text, ordered by text and hash."""
    h, d = shingles(words, doc, k)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[keep], d[keep]


def group_sums(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Sums of 64-bit values by group, modulo 2**64 (exact: halves are added as doubles)."""
    low = np.bincount(group, (values & U(0xFFFFFFFF)).astype(np.float64), n).astype(np.uint64)
    high = np.bincount(group, (values >> U(32)).astype(np.float64), n).astype(np.uint64)
    return low + (high << U(32))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.flags.c_contiguous else np.ascontiguousarray(x).view(np.int64)
