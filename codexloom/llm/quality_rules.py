"""Quality rules with risk-controlled thresholds.

Every statistic has a fixed grid of cutoffs.  For each stratum, labelled good texts
show how many a cutoff would reject falsely; a cutoff is admitted only if the exact
binomial test rejects "the false rejection rate is above ``RISK``" at level ``DELTA``
divided by the number of tests (strata x statistics x cutoffs, Bonferroni), so all
admitted cutoffs hold at once with probability 1 - DELTA.  Among them, the one that
rejects most bad texts is taken, a false rejection counting ten times; ties go to the
loosest, and a stratum without enough labels gets no cutoff.  Several statistics
share a stratum's risk: each is tested at RISK / number of statistics.

DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text_stats as S
from ._shared import Stage, held_out, small

RISK = 0.05
DELTA = 0.05
GRID = {
    "symbol_ratio": [0.05, 0.1, 0.2, 0.3, 0.5, 0.8, 1.5],
    "dup_line_ratio": [0.1, 0.2, 0.3, 0.4, 0.5, 0.7],
    "upper_ratio": [0.1, 0.2, 0.3, 0.4, 0.6, 0.8],
    "digit_ratio": [0.05, 0.1, 0.2, 0.4],
    "mean_word": [9.0, 10.0, 12.0, 15.0, 20.0],
    "same_ratio": [0.5, 0.6, 0.7, 0.8, 0.9],
}


def binomial_tail(k: Column, n: Column, risk: float) -> Column:
    """Log of P(X <= k) for X ~ Binomial(n, risk), summed exactly in log space."""
    odds = math.log(risk) - math.log1p(-risk)
    first = n * F.lit(math.log1p(-risk))
    begin = F.struct(first.alias("term"), first.alias("sum"))

    def add(done: Column, i: Column) -> Column:
        term = done["term"] + F.log(n - i + 1) - F.log(i) + F.lit(odds)
        high, low = F.greatest(done["sum"], term), F.least(done["sum"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("sum"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, begin, add, lambda done: done["sum"])


def thresholds(stage: Stage, labelled: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """One row per stratum with a cutoff (or null) for each statistic, from rows with
    ``stratum``, ``quality`` (1 good, 0 bad) and the statistics of ``GRID``."""
    cuts = [(name, cut) for name, grid in GRID.items() for cut in grid]
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(c).alias("cut"), (F.col(n) > c).alias("over")) for n, c in cuts)))
    good, bad = F.col("quality") == 1, F.col("quality") == 0
    counts = (
        labelled.select("stratum", "quality", rows.alias("r"))
        .groupBy("stratum", "r.name", "r.cut")
        .agg(F.count_if(good).alias("n"), F.count_if(good & F.col("r.over")).alias("k"), F.count_if(bad & F.col("r.over")).alias("caught"))
    )
    counts = stage.save(counts)
    strata = counts.agg(F.countDistinct("stratum").alias("strata")).first()["strata"]
    level = math.log(delta / (max(strata, 1) * len(cuts)))
    # With k at the mean or above, the tail is about one half or more, which no level admits;
    # so no row's list of terms is longer than the bound on false rejections.
    p = risk / len(GRID)
    low = F.when(F.col("k") < F.col("n") * F.lit(p), binomial_tail(F.col("k"), F.col("n"), p) <= level)
    admitted = counts.where(F.coalesce(low, F.lit(False)))
    worth = admitted.withColumn("worth", F.col("caught") - 10 * F.col("k")).where("worth > 0")
    best = worth.groupBy("stratum", "name").agg(F.max_by("cut", F.struct("worth", "cut")).alias("cut"))
    return best.groupBy("stratum").agg(*(F.max(F.when(F.col("name") == n, F.col("cut"))).alias(f"cut_{n}") for n in GRID))


def verdicts(scored: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Adds ``base_failed`` and ``kept`` to rows with statistics and ``stratum``."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    over = F.lit(False)
    for name in GRID:
        over = over | F.coalesce(F.col(name) > F.col(f"cut_{name}"), F.lit(False))
    joined = scored.join(small(cutoffs), "stratum", "left")
    return joined.withColumn("base_failed", base).withColumn("kept", ~base & ~over).drop(*(f"cut_{n}" for n in GRID))


def apply_rules(docs: DataFrame, labels: DataFrame, carry: list[str], text_col: str = "text", id_col: str = "doc_id", stratum_col: str = "lang") -> DataFrame:
    """The columns ``carry`` of each row with its statistics, base_failed and kept.

    Null and empty texts fail the base rule.  A null stratum is a stratum of its own, and
    not the empty one.  An empty table stays empty; columns that aren't carried are left
    out, and carried ones mustn't have names of results.  Labels with null values, without a document or of held-out documents are
    not used; repeated labels count once; no labels means base rules alone.  Repeated
    rows each get their result.
    """
    stage = Stage(docs.sparkSession, "rules")
    named = [F.col(c).alias(f"in_{i}") for i, c in enumerate(carry)]
    rows = docs.select(*named, F.col(id_col).alias("id"), F.coalesce(F.concat(F.lit("="), F.col(stratum_col).cast("string")), F.lit("")).alias("stratum"), F.col(text_col).alias("st_text"))
    scored = stage.save(S.with_stats(rows, "st_text").drop("st_text"))
    scored = scored.withColumns(S.ratios())
    marks = labels.select(F.col("doc_id").alias("id"), "quality").where("id is not null and quality in (0, 1)").distinct()
    labelled = scored.where(~held_out("id")).select("id", "stratum", *GRID).join(marks, "id")
    cutoffs = stage.save(thresholds(stage, labelled))
    out = verdicts(scored, cutoffs)
    return out.select(*(F.col(f"in_{i}").alias(c) for i, c in enumerate(carry)), *S.STATS, "base_failed", "kept")
