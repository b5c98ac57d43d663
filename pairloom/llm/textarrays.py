"""Words and shingles of whole texts as numpy arrays.

A word is a run of characters other than space and the control characters
9 to 13, as in ``[^\\x20\\x09-\\x0D]+``. All of these are single bytes in
UTF-8, so words are found on the bytes of an Arrow column without making a
Python object for each. Word hashes are 64 bits wide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
SEGMENT = 1 << 18
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SHINGLE = 5

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (a finaliser of multiply and shift steps)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(SEGMENT, 1 << (n - 1).bit_length())
    if size not in _powers:
        with np.errstate(over="ignore"):
            both = []
            for base in (BASE, BASE_INVERSE):
                p = np.full(size + 1, base, dtype=np.uint64)
                p[0] = 1
                both.append(np.cumprod(p, dtype=np.uint64))
        if size > SEGMENT:
            return tuple(both)
        _powers[size] = tuple(both)
    return _powers[size]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each text the index of its first word (one more at the end)."""
    ink = ~WHITE[data]
    before = np.empty_like(ink)
    after = np.empty_like(ink)
    if len(ink):
        before[1:], before[0] = ink[:-1], False
        after[:-1], after[-1] = ink[1:], False
        edges = offsets[(offsets > 0) & (offsets < len(ink))]
        before[edges] = False
        after[edges - 1] = False
    starts = np.flatnonzero(ink & ~before)
    ends = np.flatnonzero(ink & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word, made from prefix sums over bounded segments."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            lo = starts[i]
            j = max(i + 1, int(np.searchsorted(ends, lo + SEGMENT, side="right")))
            hi = ends[j - 1]
            up, down = powers(int(hi - lo))
            sums = np.zeros(hi - lo + 1, dtype=np.uint64)
            np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * up[: hi - lo], out=sums[1:])
            s, e = starts[i:j] - lo, ends[i:j] - lo
            out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
            i = j
    return out


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words; empty if there are fewer words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        h = words[:n].copy()
        for k in range(1, size):
            h = h * BASE + words[k : n + k]
        return mix(h)


def shingle_sets(column: pa.Array, size: int = SHINGLE):
    """Yield each text's sorted distinct shingle hashes, letters A-Z in lower case.

    With fewer words than ``size`` the whole sequence is the one shingle; a
    text without words has none.
    """
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        if hi == lo:
            yield np.zeros(0, dtype=np.uint64)
        elif hi - lo < size:
            # the number of words keeps short sequences apart from shingles
            yield window_hashes(words[lo:hi], hi - lo) + np.uint64(hi - lo)
        else:
            yield np.unique(window_hashes(words[lo:hi], size))


def row_chunks(batch: pa.RecordBatch, text_col: str, limit: int = 4 << 20):
    """Slices of a batch whose texts have ``limit`` bytes or are one text, so that work arrays stay small."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(text_col)), 0), dtype=np.int64)
    filled = np.cumsum(lengths)
    at = 0
    while at < len(lengths):
        before = filled[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(filled, before + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end


def counts(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each text have the flag."""
    sums = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[offsets])
