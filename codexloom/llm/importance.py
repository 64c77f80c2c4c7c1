"""Importance resampling towards a target distribution.

Texts are bags of hashed runs of words.  Two tallies, of all documents and of the target
texts, give each bucket a gain (the logarithm of how much more often the target has it),
and a document's weight is the mean gain of its features, looked up in one array.  A
Gumbel number that depends on the id alone turns the highest scores into a draw without
replacement.

The draw needs no global sort.  Scores are whole numbers, and no data can spread them over
more than some 120,000 values (a gain is at most 1000 ln(features + buckets), a Gumbel number
lies between -3,115 and 22,875), so their exact histogram is a small table.  Its
suffix sums say how many documents lie above each score; the score at which the
quota is reached is the cutoff.  Scores from there on survive, and ``row_number`` by id
within each of them, added to its offset, is the rank.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _kernels as K
from . import _spans as S
from ._shared import Stage, small

#: Scores of one band, whose offsets are summed up together.
BAND = 1024
#: Equal rows that one row of a sequence stands for.
COPIES = 1 << 16


class Bags:
    """Hashed features of the texts of a column: runs of 1 to ``n`` words, joined by one space."""

    def __init__(self, column: pa.Array, n: int, buckets: int) -> None:
        data, off = K.raw_bytes(column)
        data = K.LOWER[data]
        inside = K.LETTERED[data]
        starts, ends, first = S.runs(inside, off)
        self.n_words = np.diff(first)
        if n > 1:  # words side by side, so that a run of them is one span
            length = ends - starts
            joined = np.full(int(length.sum()) + len(length), 0x20, np.uint8)
            joined[np.arange(int(length.sum())) + np.repeat(np.arange(len(length)), length)] = data[inside]
            ends = np.cumsum(length) + np.arange(len(length))
            data, starts = joined, ends - length
        text = np.repeat(np.arange(len(off) - 1), self.n_words)
        owner, bucket = [], []
        for k in range(n):
            whole = text[k:] == text[: len(text) - k] if k else np.ones(len(text), bool)
            at = np.flatnonzero(whole)
            owner.append(text[at])
            bucket.append(S.crc32(data, starts[at], ends[at + k]) % np.uint32(buckets))
        self.owner, self.bucket = np.concatenate(owner), np.concatenate(bucket).astype(np.int64)
        self.n_features = np.bincount(self.owner, minlength=len(off) - 1)

    def weights(self, gains: np.ndarray) -> np.ndarray:
        """The floored mean gain of each text, 0 without features."""
        if len(self.owner) and (np.diff(self.owner) < 0).any():
            order = np.argsort(self.owner, kind="stable")
            self.owner, self.bucket = self.owner[order], self.bucket[order]
        sums = np.zeros(len(self.owner) + 1, np.int64)
        np.cumsum(gains[self.bucket], out=sums[1:])
        to = np.cumsum(self.n_features)
        return (sums[to] - sums[to - self.n_features]) // np.maximum(self.n_features, 1)


def bucket_counts(texts: DataFrame, n: int = 1, buckets: int = 10_000, text_col: str = "text") -> DataFrame:
    """bucket and n: how many features of all the texts fall into each bucket.  A partition
    sends a row a bucket at most.  Null and empty texts have no features."""

    def tally(batches):
        found = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in K.pieces(batch, "text"):
                found += np.bincount(Bags(part.column(0), n, buckets).bucket, minlength=buckets)
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(found[some], pa.int64())], ["bucket", "n"])

    counts = texts.select(F.col(text_col).alias("text")).mapInArrow(tally, "bucket long, n long")
    return counts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """1000 times the logarithm of target share over raw share of each bucket, both with one
    feature more a bucket, floored."""
    s, t = sum(raw.values()), sum(target.values())
    ratio = lambda b: (target.get(b, 0) + 1.0) * (s + float(buckets)) / ((raw.get(b, 0) + 1.0) * (t + float(buckets)))
    return np.array([math.floor(1000 * math.log(ratio(b))) for b in range(buckets)], np.int64)


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    least_words: int = 20,
    n: int = 1,
    buckets: int = 10_000,
    seed: str = "2024",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: id, n_words, n_features, weight, score and rank (1, 2, 3, ... from
    the highest score, equal ones by id; null if not drawn).

    Of the rows with ``least_words`` words or more, ``percent`` in a hundred are drawn, rounded
    down.  Words are those of letters and digits, A-Z lower-cased, of whole texts; null and
    empty texts have none, weight 0, and are drawn only where ``least_words`` is 0.  A row with
    a null id has neither score nor rank and isn't counted.  Rows that repeat an id have one
    random number; where they tie, the one with fewer features, then words, comes first, and
    equal rows share the ranks of their place in any order.  Where the target is empty, all
    weights follow from the raw tally alone; an empty table stays empty; other columns are
    left out, so their names can't clash.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "resample")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # a row a bucket: bounded by the parameter
    raw, wanted = ({r["bucket"]: r["n"] for r in bucket_counts(x, n, buckets, c).collect()} for x, c in ((rows, "text"), (target, text_col)))
    gain = gains(raw, wanted, buckets)

    def weigh(batches):
        for batch in batches:
            for part in K.pieces(batch, "text"):
                bags = Bags(part.column(1), n, buckets)
                weight = bags.weights(gain)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.int64()) for x in (bags.n_words, bags.n_features, weight))], ["id", "n_words", "n_features", "weight"])

    long = [T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(-1000 * F.ln(-F.ln((draw + 0.5) / 4294967296)))
    scored = stage.save(rows.mapInArrow(weigh, T.StructType([T.StructField("id", rows.schema["id"].dataType), *long])).withColumn("score", F.col("weight") + gumbel))
    counted = F.col("score").isNotNull() & (F.col("n_words") >= least_words)

    band = F.floor(F.col("score") / BAND)
    histogram = stage.save(scored.where(counted).groupBy("score").agg(F.count("*").alias("n")).withColumn("band", band))
    quota = (histogram.agg(F.sum("n")).first()[0] or 0) * percent // 100
    above = lambda of: F.sum("n").over(of.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    bands = histogram.groupBy("band").agg(F.sum("n").alias("n")).select("band", above(Window.orderBy(F.desc("band"))).alias("higher"))
    offsets = histogram.withColumn("inside", above(Window.partitionBy("band").orderBy(F.desc("score")))).join(F.broadcast(bands), "band")
    surviving = stage.save(offsets.select("score", (F.col("higher") + F.col("inside")).alias("before")).where(F.col("before") < quota))
    cutoff = surviving.agg(F.min("score")).first()[0]
    if cutoff is None:
        return scored.withColumn("rank", F.lit(None).cast("long")).withColumnRenamed("id", id_col)

    same = ["id", "n_words", "n_features", "weight", "score"]
    distinct = scored.where(counted & (F.col("score") >= cutoff)).groupBy(*same).agg(F.count("*").alias("copies"))
    place = Window.partitionBy("score").orderBy("id", "n_features", "n_words")
    behind = F.sum("copies").over(place.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("copies")
    ranked = distinct.join(small(surviving), "score").withColumn("first", F.col("before") + behind)
    blocks = ranked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {COPIES}"))))
    copies = F.sequence(F.col("block") * COPIES, F.least(F.col("copies"), (F.col("block") + 1) * COPIES) - 1)
    one = blocks.withColumn("copy", F.explode(copies)).withColumn("rank", F.col("first") + F.col("copy") + 1)
    drawn = one.select(*same, F.when(F.col("rank") <= quota, F.col("rank")).alias("rank"))
    rest = scored.where(~counted | (F.col("score") < cutoff))
    return drawn.unionByName(rest.withColumn("rank", F.lit(None).cast("long"))).withColumnRenamed("id", id_col)
