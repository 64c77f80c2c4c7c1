"""Benchmark decontamination with an FM-index over each training shard.

A shard is a bounded piece of a partition.  Its words are mapped to the alphabet
of the test phrases (any other word is a separator, which no phrase can cross),
runs too short for the shortest phrase are left out, and an FM-index is built
over what remains: suffix array, Burrows-Wheeler transform in a wavelet matrix,
and every 16th suffix position.  All phrases are searched backward at once, the
row ranges are located by LF steps to sampled positions, and the occurrences of a
document are merged into removal spans.

The text never leaves its partition, so there is no shuffle and no skew.  Test
phrases are read by the driver in blocks of bounded size (``BLOCK_CHARS``) and kept as
sorted arrays; with several blocks, the spans found so far are written before the next
block is broadcast, so one is held at a time.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _kernels as K
from ._shared import Stage

#: Characters of test phrases that are held and broadcast at a time.
BLOCK_CHARS = 4_000_000
SAMPLE_EVERY = 16

SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


class WaveletMatrix:
    """Rank and access over a sequence of small integers."""

    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        self.bits = max(1, int(sigma - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        begin = np.zeros(sigma, np.int64)  # where the rows of each symbol begin at the bottom
        names = np.arange(sigma)
        for level in range(self.bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            ones = np.zeros(len(symbols) + 1, np.int64)
            np.cumsum(bit, out=ones[1:])
            zeros = len(symbols) - int(ones[-1])
            self.ones.append(ones)
            self.zeros.append(zeros)
            begin = np.where((names >> level) & 1, zeros + ones[begin], begin - ones[begin])
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        self.begin = begin

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of symbol[i] before at[i]."""
        for j, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            up = ones[at]
            at = np.where((symbol >> (self.bits - 1 - j)) & 1, zeros + up, at - up)
        return at - self.begin[symbol]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and its rank there."""
        symbol = np.zeros(len(at), np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            up = ones[at]
            bit = ones[at + 1] - up
            symbol = 2 * symbol + bit
            at = np.where(bit, zeros + up, at - up)
        return symbol, at - self.begin[symbol]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Prefix doubling; the last symbol has to be the only 0."""
    n = len(text)
    rank = text.astype(np.int64)
    step = 1
    while True:
        after = np.full(n, -1, np.int64)
        after[: n - step] = rank[step:]
        key = rank * (max(n, int(rank.max()) + 1) + 1) + after + 1
        order = np.argsort(key)
        key = key[order]
        new = np.zeros(n, np.int64)
        new[1:] = np.cumsum(key[1:] != key[:-1])
        rank[order] = new
        if new[-1] == n - 1:
            return order
        step *= 2


class FMIndex:
    """Counts and locates patterns in a text of integers of 1 or more."""

    def __init__(self, text: np.ndarray, sigma: int) -> None:
        text = np.append(text.astype(np.int64), 0)
        self.n = len(text)
        order = suffix_array(text)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])[:-1]
        self.tree = WaveletMatrix(text[order - 1], sigma)
        sampled = (order % SAMPLE_EVERY == 0) | (order == 0)
        self.sampled = sampled
        self.sample_rank = np.cumsum(sampled) - 1
        self.samples = order[sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of patterns, one a row of the matrix; backward from the end."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for column in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[live, column]
            lo[live] = self.first[symbol] + self.tree.rank(symbol, lo[live])
            hi[live] = self.first[symbol] + self.tree.rank(symbol, hi[live])
            live = live[lo[live] < hi[live]]
        return lo, np.where(lo < hi, hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, by LF steps to the sampled ones."""
        out = np.zeros(len(rows), np.int64)
        steps = np.zeros(len(rows), np.int64)
        rows, live = rows.copy(), np.arange(len(rows))
        while len(live):
            done = self.sampled[rows[live]]
            at = live[done]
            out[at] = self.samples[self.sample_rank[rows[at]]] + steps[at]
            live = live[~done]
            symbol, rank = self.tree.access(rows[live])
            rows[live] = self.first[symbol] + rank
            steps[live] += 1
        return out


class Phrases:
    """Test phrases of one block: distinct windows over a dense word alphabet."""

    def __init__(self, items: list[tuple[object, str | None]], window: int) -> None:
        words = K.tokenise(pa.array([t for _, t in items], pa.large_string()), K.LETTERED, True)
        # 0 ends the text, 1 separates, words begin at 2
        self.vocabulary, dense = np.unique(words.hashes, return_inverse=True)
        dense = dense.astype(np.int32) + 2
        self.sigma = len(self.vocabulary) + 2
        # Windows as places in the words; equal ones are brought together by sorting their words.
        self.items = sorted({str(n) for n, _ in items if n is not None})
        code = {n: k for k, n in enumerate(self.items)}
        counts = words.counts()
        whose = np.array([-1 if n is None else code[str(n)] for n, _ in items], np.int32)
        self.groups = []
        for size in np.unique(np.minimum(counts, window)).tolist():
            own = np.flatnonzero((np.minimum(counts, window) == size) & (whose >= 0)) if size else []
            if not len(own):
                continue
            n = counts[own] - size + 1
            begin = np.repeat(words.offsets[own], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            table = dense[begin[:, None] + np.arange(size)]
            owner = np.repeat(whose[own], n)
            order = np.lexsort((owner, *table.T[::-1]))
            table, owner = table[order], owner[order]
            new = np.append(True, (table[1:] != table[:-1]).any(1))
            first = new | np.append(True, owner[1:] != owner[:-1])  # an item once a window
            place = np.cumsum(new) - 1
            self.groups.append((size, table[new], np.searchsorted(place[first], np.arange(new.sum() + 1)), owner[first]))
        self.shortest = min((g[0] for g in self.groups), default=0)

    def scan(self, words: K.Words) -> tuple[np.ndarray, list[set[str]]]:
        """Hit words of a shard, and the items found in each of its texts."""
        n, items = len(words.hashes), [set() for _ in range(len(words.offsets) - 1)]
        hit = np.zeros(n, bool)
        if not self.groups or not n:
            return hit, items
        at = np.minimum(np.searchsorted(self.vocabulary, words.hashes), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == words.hashes
        # Runs of known words inside one text, at least as long as the shortest phrase.
        joined = known[1:] & known[:-1]
        edges = words.offsets[1:-1]
        joined[edges[(edges > 0) & (edges < n)] - 1] = False
        begin = np.flatnonzero(known & ~np.concatenate([[False], joined]))
        end = np.flatnonzero(known & ~np.concatenate([joined, [False]])) + 1
        keep = end - begin >= self.shortest
        begin, end = begin[keep], end[keep]
        if not len(begin):
            return hit, items
        length = end - begin + 1  # with a separator behind each run
        base = np.concatenate([[0], np.cumsum(length)])
        where = np.arange(base[-1]) - np.repeat(base[:-1], length) + np.repeat(begin, length)
        text = np.ones(base[-1], np.int64)
        word = np.ones(base[-1], bool)
        word[base[1:] - 1] = False
        text[word] = at[where[word]] + 2
        index = FMIndex(text, self.sigma)
        for size, patterns, edges, owners in self.groups:
            lo, hi = index.search(patterns)
            found = hi - lo
            if not found.any():
                continue
            which = np.repeat(np.arange(len(patterns)), found)
            rows = np.arange(found.sum()) - np.repeat(np.cumsum(found) - found, found) + np.repeat(lo, found)
            at_word = where[index.locate(rows)]
            hit |= K.covered(at_word, size, n)
            text_of = np.searchsorted(words.offsets, at_word, "right") - 1
            for d, p in np.unique(np.stack([text_of, which], 1), axis=0).tolist():
                items[d].update(self.items[o] for o in owners[edges[p] : edges[p + 1]].tolist())
        return hit, items


def _blocks(benchmark: DataFrame, id_col: str, text_col: str):
    """Items in lists of bounded size; the driver holds one list at a time."""
    rows = benchmark.select(id_col, text_col).where(F.col(text_col).isNotNull())
    total = rows.agg(F.sum(F.length(text_col))).first()[0] or 0
    n = -(-total // BLOCK_CHARS) or 1
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64(id_col, text_col), F.lit(n)) == k) if n > 1 else rows
        yield [tuple(r) for r in part.collect()]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Adds to each row its number of words, the merged word spans that occur in the
    benchmark (``spans``) and the items they come from (``items``, sorted).

    Null and empty texts have no words and no spans; items with null text or id match
    nothing; an item of fewer than ``window`` words is one phrase; repeated rows each
    get their result; very long texts are searched whole; an empty table stays empty, an
    empty benchmark matches nothing; input columns with the names of results are replaced,
    others stay.
    """
    added = [("n_words", T.LongType()), ("spans", SPAN), ("items", T.ArrayType(T.StringType()))]
    kept = [c for c in docs.columns if c not in {n for n, _ in added}]
    out = docs.select(*kept)
    schema = T.StructType([*out.schema.fields, *(T.StructField(n, t) for n, t in added)])
    out = out.withColumns({"n_words": F.lit(0).cast("long"), "spans": F.array().cast(SPAN), "items": F.array().cast("array<string>")})
    stage, before = None, None
    for block in _blocks(benchmark, item_col, item_text_col):
        if before is not None:  # one block's phrases at a time
            stage = stage or Stage(docs.sparkSession, "search")
            out = stage.save(out)
            before.destroy()
        before = docs.sparkSession.sparkContext.broadcast(Phrases(block, window))
        out = out.mapInArrow(_searcher(before, text_col, len(kept)), schema)
    return out


def _searcher(phrases, text_col: str, n_kept: int):
    def search(batches):
        for batch in batches:
            for piece in K.pieces(batch, text_col):
                words = K.tokenise(piece.column(text_col), K.LETTERED, True)
                hit, items = phrases.value.scan(words)
                edge = np.diff(hit.astype(np.int8), prepend=0, append=0)
                edges = words.offsets[1:-1]
                cut = np.zeros(len(hit) + 1, bool)
                inner = edges[(edges > 0) & (edges < len(hit))]
                cut[inner] = hit[inner] & hit[inner - 1]  # spans end with their text
                begin, end = np.flatnonzero((edge == 1) | cut), np.flatnonzero((edge == -1) | cut)
                owner = np.searchsorted(words.offsets, begin, "right") - 1
                spans = [[] for _ in range(piece.num_rows)]
                for d, b, e in zip(owner.tolist(), begin.tolist(), end.tolist(), strict=True):
                    spans[d].append((b - int(words.offsets[d]), e - int(words.offsets[d])))
                spans = [_merged(old, new) for old, new in zip(piece.column("spans").to_pylist(), spans, strict=True)]
                items = [sorted(new.union(old)) for old, new in zip(piece.column("items").to_pylist(), items, strict=True)]
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns[:n_kept], pa.array(words.counts(), pa.int64()), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))],
                    names=[*piece.schema.names[:n_kept], "n_words", "spans", "items"],
                )

    return search


def _merged(old: list[dict], new: list[tuple[int, int]]) -> list[dict]:
    """Union of two lists of spans."""
    if not old:
        return [{"start": b, "end": e} for b, e in new]
    out: list[dict] = []
    for b, e in sorted(itertools.chain(((s["start"], s["end"]) for s in old), new)):
        if out and b <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], e)
        else:
            out.append({"start": b, "end": e})
    return out
