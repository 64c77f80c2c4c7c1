"""Runs of marked bytes, and CRC-32 of many byte spans at once."""

from __future__ import annotations

import zlib

import numpy as np

#: Bytes of a span whose checksum is made together with others; what is longer goes on alone.
TOGETHER = 64


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of marked bytes, none of which crosses from one
    text into the next, and the first run of each text (with the number of runs last)."""
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = off[1:-1]
    edges = edges[(edges > 0) & (edges < len(inside))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def _table() -> np.ndarray:
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> 1) ^ np.uint32(0xEDB88320), value >> 1)
    return value


_STEP = _table()


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """Unsigned CRC-32 of data[start:end] for each span; ``before`` holds the checksums of
    what stands in front of each, as the second argument of ``zlib.crc32`` does."""
    length = ends - starts
    order = np.argsort(-np.minimum(length, TOGETHER + 1).astype(np.int16), kind="stable")
    sizes, at = length[order], starts[order]
    state = ~(np.zeros(len(order), np.uint32) if before is None else before[order].astype(np.uint32))
    open_at = np.searchsorted(-np.minimum(sizes, TOGETHER + 1), -np.arange(min(TOGETHER, int(sizes[0]) if len(sizes) else 0)))
    for p, k in enumerate(open_at):  # the first k spans have a byte at p
        part = state[:k]
        state[:k] = (part >> np.uint32(8)) ^ _STEP[(part ^ data[at[:k] + p]) & np.uint32(255)]
    out = np.empty(len(order), np.uint32)
    out[order] = ~state
    for i in np.flatnonzero(length > TOGETHER).tolist():
        out[i] = zlib.crc32(data[starts[i] + TOGETHER : ends[i]].tobytes(), int(out[i]))
    return out
