"""Removal of word sequences that repeat, by fixed-block anchors.

Reference blocks are the non-overlapping runs of ``b = (window + 1) // 2`` words of
each text; any window holds one whole.  Every rolling run of ``b`` words probes that
index; runs that equal a block of another place are anchors.  Anchors are extended
word by word to both sides, for all members of a group at once: every window around
an anchor gets a hash, windows with two places or more survive, and neighbouring
survivors are one maximal exact repeat.  No pairs of places are made, so a passage
that many documents share costs one entry a place.

Data flow.  Texts are dealt once into batches (hash of id and text) and that exchange is
read three times.  Both exchanges of hashes carry, per batch and hash bucket, one
sorted array of distinct hashes, 4 bytes an anchor probe and 8 bytes a window; the
answer is one bit for each.  A hash that is frequent in a batch is sent once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _kernels as K

WINDOW = 35
#: Characters of text in a batch, and rolling runs in a hash bucket, on average.
BATCH_CHARS = 6_000_000
BUCKET_CHARS = 1_500_000

_SENT = "bucket long, batch long, hashes binary, often binary, blocks binary"
_TOLD = "batch long, bucket long, flags binary"
_U = np.uint64


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


class _Batch:
    """The texts of a batch in an order that every reading reproduces."""

    def __init__(self, table: pa.Table, window: int) -> None:
        self.table = table.combine_chunks().sort_by([("id", "ascending"), ("text", "ascending")])
        column = self.table.column("text")
        self.text = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
        self.words = K.tokenise(self.text, K.SPACED, False)
        self.window, self.block = window, (window + 1) // 2
        self.rolling = K.Rolling(self.words.hashes)
        n = len(self.words.hashes)
        self.valid = K.window_starts(self.words.offsets, self.block)
        self.anchors = self.rolling.windows(self.block)[self.valid] if n >= self.block else np.zeros(0, _U)

    def starts_of_blocks(self) -> np.ndarray:
        """Which of the rolling runs are reference blocks."""
        owner = np.searchsorted(self.words.offsets, self.valid, "right") - 1
        return (self.valid - self.words.offsets[owner]) % self.block == 0

    def candidates(self, anchored: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold an anchor."""
        n = len(self.words.hashes)
        starts = K.window_starts(self.words.offsets, self.window)
        if not len(starts) or not anchored.any():
            return np.zeros(0, np.int64)
        count = np.zeros(n + 1, np.int64)
        flags = np.zeros(n, np.int64)
        flags[self.valid[anchored]] = 1
        np.cumsum(flags, out=count[1:])
        return starts[count[starts + self.window - self.block + 1] > count[starts]]

    def windows(self, starts: np.ndarray) -> np.ndarray:
        return self.rolling.spans(starts, starts + self.window)


def _distinct(hashes: np.ndarray, buckets: int):
    """Distinct hashes by (bucket, hash), the bounds of the buckets, and each input's place."""
    bucket = ((hashes >> _U(32)) % _U(buckets)).astype(np.int64)
    order = np.lexsort((hashes, bucket)) if buckets > 1 else np.argsort(hashes)
    h, b = hashes[order], bucket[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (b[1:] != b[:-1])
    place = np.empty(len(h), np.int64)
    place[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    bounds = np.searchsorted(b[first], np.arange(buckets + 1))
    return h[first], np.diff(np.append(first, len(h))), bounds, place


def _send(batch_id: int, hashes: np.ndarray, buckets: int, blocks: np.ndarray | None, width) -> pa.Table:
    if blocks is not None:  # runs are told apart by bucket and 32 bits; windows settle it
        hashes = (hashes & _U(0xFFFFFFFF)) | ((hashes >> _U(32)) % _U(buckets) << _U(32))
    values, times, bounds, place = _distinct(hashes, buckets)
    marked = np.zeros(len(values), bool)
    if blocks is not None:
        marked[place[blocks]] = True
    rows = [k for k in range(buckets) if bounds[k] < bounds[k + 1]]
    cut = lambda x: [x[bounds[k] : bounds[k + 1]] for k in rows]
    return pa.table(
        {
            "bucket": pa.array(rows, pa.int64()),
            "batch": pa.array([batch_id] * len(rows), pa.int64()),
            "hashes": pa.array([x.astype(width).tobytes() for x in cut(values)], pa.binary()),
            "often": pa.array([_bits(x) for x in cut(times > 1)], pa.binary()),
            "blocks": pa.array([_bits(x) for x in cut(marked)], pa.binary()),
        }
    )


def _told(told: pa.Table, hashes: np.ndarray, buckets: int, low: bool) -> np.ndarray:
    """The answer for each of the hashes that were sent."""
    if low:
        hashes = (hashes & _U(0xFFFFFFFF)) | ((hashes >> _U(32)) % _U(buckets) << _U(32))
    values, _, bounds, place = _distinct(hashes, buckets)
    flags = np.zeros(len(values), bool)
    for bucket, data in zip(told.column("bucket").to_pylist(), told.column("flags").to_pylist(), strict=True):
        a, b = bounds[bucket], bounds[bucket + 1]
        flags[a:b] = _flags(data, b - a)
    return flags[place]


def _matcher(width, need_block: bool):
    """Answers a bucket: which hashes have two places or more, one of them (for runs) a block."""

    def match(key, group):
        lists = [np.frombuffer(x, width) for x in group.column("hashes").to_pylist()]
        sizes = [len(x) for x in lists]
        often = np.concatenate([_flags(x, n) for x, n in zip(group.column("often").to_pylist(), sizes, strict=True)])
        blocks = np.concatenate([_flags(x, n) for x, n in zip(group.column("blocks").to_pylist(), sizes, strict=True)])
        hashes = np.concatenate(lists)
        order = np.argsort(hashes)
        h = hashes[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        size = np.diff(np.append(first, len(h)))
        good = (size > 1) | (np.add.reduceat(often[order].astype(np.int64), first) > 0)
        if need_block:
            good &= np.add.reduceat(blocks[order].astype(np.int64), first) > 0
        flags = np.empty(len(h), bool)
        flags[order] = np.repeat(good, size)
        cuts = np.split(flags, np.cumsum(sizes)[:-1])
        some = [i for i, x in enumerate(cuts) if x.any()]
        return pa.table(
            {
                "batch": group.column("batch").combine_chunks().take(pa.array(some, pa.int64())),
                "bucket": pa.array([key[0].as_py()] * len(some), pa.int64()),
                "flags": pa.array([_bits(cuts[i]) for i in some], pa.binary()),
            }
        )

    return match


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept (the words that stay, joined by
    one space) and repeats (the maximal repeated spans, in words).

    Words are runs without white space, unchanged.  A word goes if a window of ``window``
    words covers it whose sequence also starts at any other place of the input.  Null and
    empty texts have no words and keep the empty string; texts shorter than the window
    keep all; very long ones are read whole; rows that repeat an id or a text each count
    as a place; rows with a null id are handled like others; an empty table stays empty;
    other columns are left out.  Equality is that of 64-bit hashes of whole windows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    batches, buckets = 1 + total // BATCH_CHARS, 1 + total // BUCKET_CHARS
    rows = rows.withColumn("batch", F.pmod(F.xxhash64("id", "text", F.lit(17)), F.lit(batches)))
    id_type = rows.schema["id"].dataType

    def probe(key, group):
        b = _Batch(group, window)
        return _send(key[0].as_py(), b.anchors, buckets, b.starts_of_blocks(), np.uint32)

    def anchored(b: _Batch, told: pa.Table) -> np.ndarray:
        return b.candidates(_told(told, b.anchors, buckets, True) if told.num_rows else np.zeros(len(b.anchors), bool))

    def extend(key, group, told):
        if not told.num_rows:
            return _send(key[0].as_py(), np.zeros(0, _U), buckets, None, np.uint64)
        b = _Batch(group, window)
        starts = anchored(b, told)
        hashes = b.windows(starts)
        out = _send(key[0].as_py(), hashes, buckets, None, np.uint64)
        return out

    def finish(key, group, told):
        runs, wide = (told.filter(pa.compute.equal(told.column("step"), k)) for k in (1, 2))
        b = _Batch(group, window)
        n = len(b.words.hashes)
        gone = np.zeros(n, bool)
        if wide.num_rows:
            starts = anchored(b, runs)
            gone = K.covered(starts[_told(wide, b.windows(starts), buckets, False)], window, n)
        removed = K.per_text(gone, b.words.offsets)
        kept, spans = [], []
        for d, text in enumerate(b.text.to_pylist()):
            words = (text or "").encode().split()
            at = []
            if removed[d]:
                a, e = b.words.offsets[d], b.words.offsets[d + 1]
                edge = np.flatnonzero(np.diff(gone[a:e].astype(np.int8), prepend=0, append=0)).reshape(-1, 2).tolist()
                at = [{"start": s, "end": t} for s, t in edge]
                stay = [0, *(x for pair in edge for x in pair), len(words)]
                words = [w for s, t in zip(stay[::2], stay[1::2], strict=True) for w in words[s:t]]
            kept.append(b" ".join(words))
            spans.append(at)
        return pa.table(
            {
                "id": b.table.column("id"),
                "n_words": pa.array(b.words.counts(), pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "kept": pa.array(kept, pa.binary()).cast(pa.string()),
                "repeats": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            }
        )

    grouped = rows.groupBy("batch")
    runs = grouped.applyInArrow(probe, _SENT).groupBy("bucket").applyInArrow(_matcher(np.uint32, True), _TOLD)
    windows = grouped.cogroup(runs.groupBy("batch")).applyInArrow(extend, _SENT).groupBy("bucket").applyInArrow(_matcher(np.uint64, False), _TOLD)
    told = runs.withColumn("step", F.lit(1)).unionByName(windows.withColumn("step", F.lit(2)))
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([T.StructField("id", id_type), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("repeats", span)])
    return grouped.cogroup(told.groupBy("batch")).applyInArrow(finish, schema).withColumnRenamed("id", id_col)
