"""Vectorised text kernels shared by the word-based operators.

Everything here works on a whole Arrow string column at once: words are found
with byte masks, word hashes come from one prefix sum per megabyte, and the hash
of ``k`` consecutive words comes from a second prefix sum.  No Python loop runs
per word.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20
PIECE_BYTES = 8 << 20

_U = np.uint64


def _mask(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return out


#: Bytes of words that white space separates, and of words of letters and digits.
#: Both work on UTF-8 bytes because every separator is ASCII.
SPACED = ~_mask((0x20, 0x20), (0x09, 0x0D))
LETTERED = _mask((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = int(_rng.integers(1, 1 << 62)) * 2 + 1
_WORD_BASE = int(_rng.integers(1, 1 << 62)) * 2 + 1


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up), SEGMENT)
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up, self.down


_bytes_powers, _words_powers = _Powers(_BASE), _Powers(_WORD_BASE)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; returns a new array."""
    x = x ^ (x >> _U(32))
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


class Words(NamedTuple):
    buffer: np.ndarray  # bytes of all texts, folded if asked for
    starts: np.ndarray  # byte offset of each word
    ends: np.ndarray
    offsets: np.ndarray  # words of text d: offsets[d] to offsets[d + 1]
    hashes: np.ndarray  # 64 bits a word

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offset of each row in them; null is empty."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1 + column.offset)[column.offset :]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def tokenise(column: pa.Array, table: np.ndarray, lower: bool) -> Words:
    """Words (maximal runs of bytes that ``table`` marks) of every text."""
    data, off = raw_bytes(column)
    if lower:
        data = LOWER[data]
    inside = table[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = off[1:-1]  # a word never runs from one text into the next
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(data, starts, ends, np.searchsorted(starts, off), _hash(data, starts, ends))


def _hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    w = 0
    while w < len(starts):
        a = starts[w]
        to = max(w + 1, int(np.searchsorted(ends, a + SEGMENT, "right")))
        up, down = _bytes_powers.upto(int(ends[to - 1] - a) + 1)
        part = data[a : ends[to - 1]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * up[: len(part)], out=sums[1:])
        s, e = starts[w:to] - a, ends[w:to] - a
        out[w:to] = (sums[e] - sums[s]) * down[s]
        w = to
    return mix(out)


class Rolling:
    """Hashes of runs of consecutive words."""

    def __init__(self, hashes: np.ndarray) -> None:
        up, self.down = _words_powers.upto(len(hashes) + 1)
        self.sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * up[: len(hashes)], out=self.sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        length = (ends - starts).astype(np.uint64)
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + length)

    def windows(self, k: int) -> np.ndarray:
        """One hash for each start at which ``k`` words are left."""
        n = len(self.sums) - 1
        if n < k:
            return np.zeros(0, np.uint64)
        return mix((self.sums[k:] - self.sums[: n - k + 1]) * self.down[: n - k + 1] + _U(k))


def window_starts(offsets: np.ndarray, k: int) -> np.ndarray:
    """Starts of the windows of ``k`` words that lie inside one text."""
    n = int(offsets[-1])
    if n < k:
        return np.zeros(0, np.int64)
    inside = np.ones(n - k + 1, bool)
    for edge in offsets[1:-1]:
        inside[max(0, edge - k + 1) : edge] = False
    return np.flatnonzero(inside)


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES):
    """Consecutive slices of a batch that hold about ``limit`` bytes of text at most
    (one text that is longer makes a slice of its own)."""
    at = batch.schema.get_field_index(column)
    sizes = raw_bytes(batch.column(at))[1]
    start = 0
    while start < batch.num_rows:
        to = max(start + 1, int(np.searchsorted(sizes, sizes[start] + limit, "right")) - 1)
        yield batch.slice(start, to - start)
        start = to


def covered(starts: np.ndarray, length: np.ndarray | int, n: int) -> np.ndarray:
    """Which of ``n`` positions the windows [start, start + length) cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    return np.cumsum(edge[:n]) > 0


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Flagged positions in each text."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]
