"""Vectorised word kernels over Arrow string columns.

Texts are handled as UTF-8 bytes in slices of about one megabyte, so memory stays flat whatever the batch size.  A word is a
maximal run of bytes that a 256-entry table marks; every function works on all words of a slice at once with numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

#: every byte but ASCII white space
NON_SPACE = np.ones(256, bool)
NON_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: ASCII letters and digits, and every byte of a non-ASCII character
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 63]] = True
#: ASCII lower case
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POW = np.multiply.accumulate(np.full(4096, 0x9E3779B97F4A7C15, np.uint64))
_GRAM = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEQ = (np.uint64(0xD1342543DE82EF95), np.uint64(0xAF251AF3B0F025B5))


def mix(z: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    z = z ^ (z >> np.uint64(30))
    z = z * np.uint64(0xBF58476D1CE4E5B9)
    z = z ^ (z >> np.uint64(27))
    z = z * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(column, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of runs of rows of about ``limit`` bytes; a longer text is a run alone."""
    data, off = column_bytes(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


@dataclass
class Words:
    """The words of a slice: start byte, length, row, hash; ``first`` and ``count`` per row."""

    start: np.ndarray
    length: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    count: np.ndarray
    index: np.ndarray
    within: np.ndarray
    begin: np.ndarray


def words(data: np.ndarray, off: np.ndarray, table: np.ndarray = NON_SPACE, lower: bool = True) -> Words:
    rows = len(off) - 1
    marked = table[data]
    start = marked.copy()
    if len(data):
        start[1:] &= ~marked[:-1]
        inner = off[(off > 0) & (off < len(data))]
        start[inner] |= marked[inner]
    index = np.flatnonzero(marked)
    begin = np.flatnonzero(start[index])
    starts = index[begin]
    length = np.diff(np.append(begin, len(index)))
    within = np.arange(len(index)) - np.repeat(begin, length)
    row = np.searchsorted(off, starts, "right") - 1
    if len(starts):
        power = _POW[within & 4095]
        if length.max() > 4096:
            power = power * (np.uint64(2) * (within >> 12).astype(np.uint64) + np.uint64(1))
        value = _BYTE[(LOWER[data] if lower else data)[index]] * power
        h = mix(np.add.reduceat(value, begin) + length.astype(np.uint64))
    else:
        h = np.zeros(0, np.uint64)
    count = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    return Words(starts, length, row, h, first, count, index, within, begin)


def fold_case(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with ASCII and Latin-1 capitals made small; lengths stay."""
    out = LOWER[data]
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    value = data[second]
    out[second[(value >= 0x80) & (value <= 0x9E) & (value != 0x97)]] += 32
    return out


def prefix_hash(data: np.ndarray, w: Words, n: int, lower: bool = True) -> np.ndarray:
    """Hash of each word's first ``n`` bytes."""
    if not len(w.start):
        return np.zeros(0, np.uint64)
    value = _BYTE[(LOWER[data] if lower else data)[w.index]] * _POW[np.minimum(w.within, 4095)]
    value[w.within >= n] = 0
    return mix(np.add.reduceat(value, w.begin) ^ np.uint64(0x5851F42D4C957F2D))


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of all k-word shingles; a row of fewer words, but one at least, has its whole word sequence as the only one."""
    n = len(w.hash)
    if n >= k:
        same = w.row[: n - k + 1] == w.row[k - 1 :]
        h = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            h += w.hash[j : n - k + 1 + j] * _GRAM[j]
        h, row = mix(h[same]), w.row[: n - k + 1][same]
    else:
        h, row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((w.count > 0) & (w.count < k))
    if len(short):
        extra = [mix(np.array([(w.hash[w.first[r] : w.first[r] + w.count[r]] * _GRAM[: w.count[r]]).sum(dtype=np.uint64)]) ^ (_GRAM[63:] * np.uint64(w.count[r])))[0] for r in short]
        h, row = np.concatenate([h, np.array(extra, np.uint64)]), np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        h, row = h[order], row[order]
    return h, row


def sequence_keys(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each row's word sequence; rows of equal words have equal keys."""
    rows = len(w.count)
    out = []
    place = np.arange(len(w.hash)) - np.repeat(w.first, w.count)
    some = np.flatnonzero(w.count)
    for c in _SEQ:
        key = np.zeros(rows, np.uint64)
        if len(some):
            power = np.multiply.accumulate(np.full(int(w.count.max()), c, np.uint64))
            key[some] = np.add.reduceat(w.hash * power[place], w.first[some])
        out.append(mix(key + w.count.astype(np.uint64) * c))
    return out[0], out[1]


def distinct_per_row(h: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of each row, sorted within the row: (hash, row, count per row)."""
    if not len(h):
        return h, row, np.zeros(rows, np.int64)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[keep], row[keep], np.bincount(row[keep], minlength=rows)


def sentences(data: np.ndarray, w: Words) -> np.ndarray:
    """Sentence number of each word, rising through the slice: a new one starts with a row, after a line break and after a gap that holds . ! or ?"""
    n = len(w.start)
    if not n:
        return np.zeros(0, np.int64)
    seen = np.concatenate([[0], np.cumsum(_STOP[data])])
    new = np.zeros(n, bool)
    end = w.start + w.length
    if n > 1:
        new[1:] = (w.row[1:] != w.row[:-1]) | (seen[w.start[1:]] > seen[end[:-1]])
    return np.cumsum(new)
