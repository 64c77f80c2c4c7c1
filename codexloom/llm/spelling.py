"""Spelling variants of a corpus' words, grouped by letter-parity masks.

A word's mask has a bit for each letter (some rare ones share one): whether the letter
occurs an odd number of times.  One inserted or deleted letter flips one bit; one replaced
letter flips two, or none where both share a bit.  So the masks of two near words differ in
two bits at most, and of three bands that a mask is split into one at least is equal.
Words are joined on an equal band and a length that differs by one at most; the other
bits and the edit distance are tested inside the join, which puts out near pairs only.

Common letters leave few values to a band, so a second exact key goes with it: one edit
leaves the first or the last half of a word as it is.  A pair is put out by the first
half and band that both words share.

Data flow.  A pass over whole texts in Arrow batches counts words map-side, so the shuffle
carries a word once a partition.  Words that are frequent enough are written once; the join
works on them alone.  Keys with many words are dealt into blocks, each compared with all
words of its key.  Forms are chosen by a minimum that combines map-side, and roots found
by doubling jumps, whose number is bounded: n doubles at least with each step.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _kernels as K
from . import _spans as S
from ._shared import Stage, small

BANDS = 3
#: Bits of a band; three of them are a mask.
BAND_BITS = 21
#: Words of one key that a join block holds on its left side.
BLOCK_WORDS = 4096
#: Distinct words that a partition keeps before it sends them.
HELD_WORDS = 500_000

_LETTER = np.zeros(256, bool)
_LETTER[0x61:0x7B] = True


def _gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as strings."""
    length = ends - starts
    to = np.cumsum(length)
    at = np.arange(int(to[-1]) if len(to) else 0) + np.repeat(starts - (to - length), length)
    offsets = np.zeros(len(length) + 1, np.int32)
    offsets[1:] = to
    return pa.StringArray.from_buffers(len(length), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[at])))


def words_of(ids: list[str | None], column: pa.Array, every: int, shortest: int) -> pa.Array:
    """Words of ``shortest`` code points or more: the runs of letters, A-Z lower-cased, of
    which those whose checksum with the id ``every`` divides have lost one letter.  A row
    with a null id loses none."""
    data, off = K.raw_bytes(column)
    data = K.LOWER[data]
    lead = data == 0xC3  # of the two bytes of U+00C0 to U+00FF
    inside = _LETTER[data] | lead
    inside[1:] |= lead[:-1]
    starts, ends, first = S.runs(inside, off)
    wide = np.zeros(len(data) + 1, np.int64)
    np.cumsum(lead, out=wide[1:])
    points = ends - starts - (wide[ends] - wide[starts])
    owner = np.repeat(np.arange(len(ids)), np.diff(first))
    before = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
    has_id = np.array([i is not None for i in ids], bool)
    check = S.crc32(data, starts, ends, before[owner])
    less = (check % np.uint32(every) == 0) & has_id[owner]
    stay = np.flatnonzero((points >= shortest) & ~less)
    changed = []
    for i in np.flatnonzero(less & (points > shortest)).tolist():
        run, at = data[starts[i] : ends[i]].tobytes().decode(), int(check[i]) % int(points[i])
        changed.append(run[:at] + run[at + 1 :])
    return pa.concat_arrays([_gather(data, starts[stay], ends[stay]), pa.array(changed, pa.string())])


def _added(held: list[pa.Table]) -> pa.Table:
    summed = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")])
    return pa.table({"word": summed.column("word"), "n": summed.column("n_sum")})


def vocabulary(docs: DataFrame, every: int = 97, shortest: int = 5, least: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word and n of the words that occur ``least`` times or more in all texts together."""

    def count(batches):
        held, size = [], 0
        for batch in batches:
            for part in K.pieces(batch, "text"):
                found = pc.value_counts(words_of(part.column(0).to_pylist(), part.column(1), every, shortest))
                held.append(pa.table({"word": found.field("values"), "n": found.field("counts")}))
                size += len(found)
                if size > HELD_WORDS:
                    held = [_added(held)]
                    size = held[0].num_rows
                    if size > HELD_WORDS // 2:
                        yield from held[0].to_batches()
                        held, size = [], 0
        if held:
            yield from _added(held).to_batches()

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def parity_mask(word: Column) -> Column:
    """63 bits: the parities of the letters, dealt in turn to the three bands."""

    def flip(mask: Column, letter: Column) -> Column:
        code = F.ascii(letter)
        bit = F.when(code < 0xC0, code - 0x61).otherwise(code - 0xC0 + 26) % (BANDS * BAND_BITS)
        place = bit % BANDS * BAND_BITS + F.floor(bit / BANDS).cast("int")
        return mask.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))

    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), flip)


def _band(k: int) -> Column:
    return F.lit(((1 << BAND_BITS) - 1) << (BAND_BITS * k)).cast("long")


def _keyed(words: DataFrame, length: Column) -> DataFrame:
    """A row for each half and band: step (which of them) and key, for pairs whose shorter
    word has that length."""
    first = F.floor(length / 2).cast("int")
    halves = (F.substring("word", F.lit(1), first), F.right("word", length - first))
    steps = [F.struct(F.lit(s * BANDS + k).alias("step"), F.xxhash64(length, h, F.col("mask").bitwiseAND(_band(k))).alias("key")) for s, h in enumerate(halves) for k in range(BANDS)]
    return words.withColumn("at", F.explode(F.array(*steps))).select("at.*", "word", "n", "len", "mask")


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs of different words, one edit apart, each pair once: a, n_a, b, n_b.

    ``words`` has one row per word, and its n; an edit inserts, deletes or replaces one
    code point."""
    words = words.select("word", "n", F.length("word").alias("len"), parity_mask(F.col("word")).alias("mask"))
    left = _keyed(words, F.col("len"))
    right = _keyed(words.withColumn("shorter", F.explode(F.array("len", F.col("len") - 1))), F.col("shorter"))
    # keys of many words: their left rows go to one of some blocks each, their right rows to all
    hot = left.groupBy("step", "key").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK_WORDS)
    hot = small(hot.select("step", "key", F.ceil(F.col("size") / BLOCK_WORDS).alias("blocks")))
    blocks = F.coalesce(F.col("blocks"), F.lit(1).cast("long"))
    left = left.join(hot, ["step", "key"], "left").withColumn("block", F.pmod(F.xxhash64("word"), blocks)).drop("blocks")
    right = right.join(hot, ["step", "key"], "left").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).drop("blocks")

    a, b = left.alias("a"), right.alias("b")
    of = lambda c: (F.col(f"a.{c}"), F.col(f"b.{c}"))
    (wa, wb), (la, lb), (ma, mb) = of("word"), of("len"), of("mask")
    flips = ma.bitwiseXOR(mb)
    bits, step = F.bit_count(flips), F.col("a.step")
    same_length = (la == lb) & bits.isin(0, 2) & (wa < wb)
    # not in an earlier band or half as well
    first_band = F.lit(True)
    for k in range(BANDS - 1):
        first_band &= (step % BANDS <= k) | (flips.bitwiseAND(_band(k)) != 0)
    half = F.floor(la / 2).cast("int")
    first_half = (step < BANDS) | (F.substring(wa, F.lit(1), half) != F.substring(wb, F.lit(1), half))
    near = (same_length | ((la < lb) & (bits == 1))) & first_band & first_half & (F.levenshtein(wa, wb, 1) == 1)
    keys = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("step", "key", "block")]
    return a.join(b, [*keys, near]).select(wa.alias("a"), F.col("a.n").alias("n_a"), wb.alias("b"), F.col("b.n").alias("n_b"))


def _roots(formed: DataFrame, stage: Stage) -> DataFrame:
    """word and root of the words that have a form, by jumps that double: after k rounds
    each points 2**k forms ahead, or at its root."""
    jumps = stage.save(formed.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    while True:
        ahead = jumps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        found = jumps.join(ahead, "root", "left")
        found = stage.save(found.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        stage.drop(jumps)
        jumps = found.drop("moved")
        if not found.where("moved").limit(1).count():
            return jumps


def spelling_variants(docs: DataFrame, every: int = 97, shortest: int = 5, least: int = 3, times: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are the runs of letters (A-Z lower-cased, U+00C0 to U+00FF as they are) of whole
    texts, of ``shortest`` code points and with ``least`` occurrences over all texts; a run
    whose checksum with its row's id ``every`` divides has lost one letter.  Near words are one edit
    apart; a word's form is its near word of largest n (of equal ones the smallest), if that
    is ``times`` its own n or more (times is 2 or more, so forms never run in circles), and
    its root where its forms lead.  Null and empty texts have no words; runs of a row with a
    null id stay whole; repeated rows count each; very long texts are read whole, a slice
    at a time; an empty table has no words; other columns are left out.
    """
    if times < 2:
        raise ValueError("times has to be 2 or more")
    stage = Stage(docs.sparkSession, "spelling")
    words = stage.save(vocabulary(docs, every, shortest, least, id_col, text_col))
    ways = F.explode(F.array(*(F.struct(F.col(x).alias("word"), F.col(y).alias("other"), F.col(f"n_{y}").alias("m")) for x, y in ("ab", "ba"))))
    near = near_pairs(words).select(ways.alias("w")).select("w.*")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    m = -F.col("best.m")
    formed = words.join(best, "word", "left").withColumn("takes", F.coalesce(m >= times * F.col("n"), F.lit(False)))
    formed = stage.save(formed.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("takes"), F.col("best.other")).alias("form"), F.when(F.col("takes"), m).alias("form_n")))
    return formed.join(_roots(formed, stage), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
