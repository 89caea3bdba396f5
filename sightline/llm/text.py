"""Words, shingles and their hashes over whole Arrow batches of text, as NumPy columns.

A word is a maximal run of bytes outside a separator set. All separators used here are ASCII,
so working on UTF-8 bytes gives the same words as working on code points. Hashes are 64 bits
wide and do not depend on where in a batch a word stands.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that are worked on at a time; a longer single text is taken whole.
CHUNK_BYTES = 2_000_000
#: The same where a batch's parts have no say in the result, so that they can be small.
SMALL_CHUNK = 500_000

SPACES = bytes([0x20, *range(0x09, 0x0E)])
NOT_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def release() -> None:
    """Gives freed memory back to the system: a Python worker waits for its next task with what its last
    one needed, and on a small executor the next stage needs that."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def released(scan):
    """A function over batches that releases memory after the last one."""

    def run(batches):
        yield from scan(batches)
        release()

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit lanes: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(32))
        x = x * U64(0xD6E8FEB86659FD93)
        x = x ^ (x >> U64(32))
        x = x * U64(0xD6E8FEB86659FD93)
        return x ^ (x >> U64(32))


def stream(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U64) + U64(seed) * U64(1 << 32)) * U64(0x9E3779B97F4A7C15))


BYTE_VALUES = stream(256, 1)
BYTE_STEP = U64(0x9E3779B97F4A7C15)
WORD_STEP = U64(0xC2B2AE3D27D4EB4F)
#: Modular inverse of WORD_STEP.
WORD_BACK = U64(pow(int(WORD_STEP), -1, 1 << 64))

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        grown = np.full(max(1 << 16, 2 * n), base, dtype=U64)
        grown[0] = 1
        with np.errstate(over="ignore"):
            have = _powers[int(base)] = np.cumprod(grown, dtype=U64)
        if len(have) > 1 << 22:  # one huge text must not pin memory
            _powers.pop(int(base))
    return have[:n]


def fold_table(lower: bool) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    return table


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64, count=len(column) + 1, offset=8 * column.offset) if where is not None and len(column) else np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, or of one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


@dataclass
class Words:
    """The words of some rows: byte ranges into `data`; the words of row r are first[r]:first[r+1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        n = len(self.starts)
        if not n:
            return np.zeros(0, U64)
        out = np.empty(n, U64)
        lens = self.ends - self.starts
        before = np.concatenate(([0], np.cumsum(lens)))
        lo = 0
        while lo < n:  # a bounded number of word bytes at a time
            hi = min(n, max(lo + 1, int(np.searchsorted(before, before[lo] + CHUNK_BYTES, "right")) - 1))
            own = lens[lo:hi]
            heads = before[lo:hi] - before[lo]
            total = int(before[hi] - before[lo])
            inside = np.arange(total) - np.repeat(heads, own)
            at = np.repeat(self.starts[lo:hi], own) + inside
            with np.errstate(over="ignore"):
                terms = BYTE_VALUES[self.data[at]] * powers(BYTE_STEP, int(own.max()))[inside]
                out[lo:hi] = np.add.reduceat(terms, heads) + own.astype(U64)
            lo = hi
        return mix(out)

    def text(self, word: int) -> str:
        return self.data[self.starts[word] : self.ends[word]].tobytes().decode()


def find_words(raw: np.ndarray, offsets: np.ndarray, separators: bytes, lower: bool) -> Words:
    data = fold_table(lower)[raw] if lower else raw
    table = np.ones(256, bool)
    table[np.frombuffer(separators, np.uint8)] = False
    inside = table[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (edge[:n] | ~np.concatenate(([False], inside[:-1]))[:n]))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False]))[:n])) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets, "left"))


def batches_of_words(column: pa.Array, separators: bytes, lower: bool, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) for each bounded part of the column."""
    raw, offsets = utf8(column)
    for lo, hi in chunks(offsets, limit):
        a = offsets[lo]
        yield lo, hi, find_words(raw[a : offsets[hi]], offsets[lo : hi + 1] - a, separators, lower)


def grams(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every `size` consecutive hashes (n - size + 1 of them), by doubling."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    out, have, power, width, left = None, 0, h, 1, size
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                part = power[have : have + n]
                out = part.copy() if out is None else out * powers(WORD_STEP, width + 1)[width] + part
                have += width
            left >>= 1
            if left:
                m = len(power) - width
                power = power[:m] * powers(WORD_STEP, width + 1)[width] + power[width : width + m]
                width *= 2
        return mix(out + U64(size))


def spans(h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of h[lo:hi] for ranges of any length."""
    n = len(h)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, U64), np.cumsum(h * powers(WORD_STEP, n), dtype=U64)))
        return mix((sums[hi] - sums[lo]) * powers(WORD_BACK, n + 1)[lo] + (hi - lo).astype(U64))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i:i+width]) for every i with i + width <= len(x)."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[width - have : width - have + n])


#: Low bits of a winnowing key that hold the position; the hash's high bits decide first.
AT_BITS = 28
AT_MASK = U64((1 << AT_BITS) - 1)


def winnow(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest of every `width` consecutive hashes, the leftmost of equals.
    Equal stretches of hashes choose alike wherever they stand."""
    if len(h) >= 1 << AT_BITS:
        raise ValueError("a single text has too many words")
    return (sliding_min((h & ~AT_MASK) | np.arange(len(h), dtype=U64), width) & AT_MASK).astype(np.int64)


def joined(words: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of each row's kept words joined by one space."""
    rows = len(words.first) - 1
    at = np.flatnonzero(keep)
    lens = words.ends[at] - words.starts[at] + 1
    before = np.concatenate(([0], np.cumsum(lens)))
    total = int(before[-1])
    out = np.full(total, 0x20, np.uint8)
    if total:
        inside = np.arange(total) - np.repeat(before[:-1], lens)
        src = np.repeat(words.starts[at], lens) + inside
        body = inside < np.repeat(lens - 1, lens)
        out[body] = words.data[src[body]]
    ends = before[np.searchsorted(at, words.first[1:], "left")]
    begins = before[np.searchsorted(at, words.first[:-1], "left")]
    drop = ends - 1  # the space after the last word of each row that has any
    some = ends > begins
    mask = np.ones(total, bool)
    mask[drop[some]] = False
    sizes = ends - begins - some
    assert rows == len(sizes)
    return out[mask], np.concatenate(([0], np.cumsum(sizes)))


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())).cast(pa.string())


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
