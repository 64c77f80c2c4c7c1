"""Mixing sources to target weights: temperature mixing and block permutations.

The share of each source is raised to one exponent and normalised.  The exponent is
the largest in [0, 1] (nearest the natural mix) that meets the target: an entropy of
the mix of at least a fraction of the uniform one, or at most so many passes over any
source.  It is bisected in sections: one aggregate over the source table tries 32
exponents at a time.  Budgets are then realised by permuting blocks of documents in
each source: all documents for every full pass, whole blocks in permuted order for the
rest, and the last block document by document.  Whether a document is in is decided by
its own block and key against one cut row of its source, so the texts are not shuffled
and a source that holds a third of all rows is no different from others.

DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import Stage, small

BLOCKS = 1024
SECTIONS = 32
ROUNDS = 4
ENTROPY = 0.99
REPEATS = 4.0


def exponent(sources: DataFrame, entropy: float | None = ENTROPY, repeats: float | None = REPEATS, budget: float | None = None) -> float:
    """Largest exponent whose mix has at least ``entropy`` of the uniform mix's entropy;
    if its passes exceed ``repeats``, the smallest exponent whose don't.  Passes are those
    of a mix of ``budget`` tokens, or without one of the natural mix, which passes every
    source once at least.  Without a target, 1.  A budget of more than ``repeats`` times
    all tokens can't be met and raises ValueError."""
    total = sources.agg(F.sum("tokens").alias("t"), F.max("tokens").alias("most"), F.min("tokens").alias("least"), F.count(F.lit(1)).alias("n")).first()
    if repeats is not None and budget is not None and total["n"] and budget > repeats * total["t"]:
        raise ValueError(f"{budget} tokens are more than {repeats} passes over all sources")
    if not total["n"] or total["n"] == 1:
        return 1.0
    low, high = 0.0, 1.0
    if entropy is not None:
        share = F.col("tokens") / F.lit(float(total["t"]))
        for _ in range(ROUNDS):
            grid = [low + (high - low) * i / SECTIONS for i in range(SECTIONS + 1)]
            sums = []
            for i, a in enumerate(grid):
                p = F.pow(share, F.lit(a))
                sums += [F.sum(p).alias(f"z{i}"), F.sum(p * F.log(p)).alias(f"e{i}")]
            row = sources.agg(*sums).first()
            met = [math.log(row[f"z{i}"]) - row[f"e{i}"] / row[f"z{i}"] >= entropy * math.log(total["n"]) - 1e-12 for i in range(len(grid))]
            last = max((i for i, ok in enumerate(met) if ok), default=0)
            if last == SECTIONS:
                low = high
                break
            low, high = grid[last], grid[last + 1]
    found = low if entropy is not None else 1.0
    if repeats is not None and budget is not None:
        # The smallest source is passed most often, and less often the larger the exponent.
        ratio = F.col("tokens") / F.lit(float(total["least"]))
        low, high = found, 1.0
        for _ in range(ROUNDS):
            grid = [low + (high - low) * i / SECTIONS for i in range(SECTIONS + 1)]
            row = sources.agg(*(F.sum(F.pow(ratio, F.lit(a))).alias(f"z{i}") for i, a in enumerate(grid))).first()
            first = next((i for i in range(len(grid)) if budget / (total["least"] * row[f"z{i}"]) <= repeats), SECTIONS)
            low, high = grid[max(0, first - 1)], grid[first]
            if not first:
                break
        return high
    if repeats is not None and total["most"] > total["least"]:
        # passes of the smallest source, when the largest is passed once
        bound = 1 - math.log(repeats) / math.log(total["most"] / total["least"])
        found = max(found, bound)
    return min(1.0, max(0.0, found))


def _key(salt: int, *of: Column) -> Column:
    return F.xxhash64(F.lit(salt), *of)


def mix_sources(
    docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", budget_tokens: int | None = None, entropy: float | None = ENTROPY, repeats: float | None = REPEATS, seed: int = 11
) -> DataFrame:
    """Adds n_tokens (words), weight (the source's share of the mix), copies (how often
    the mix has the document), block and place (its order: by place).

    ``budget_tokens`` is the size of the mix; by default it is such that each source is
    passed once at least, so no document is left out.  Null sources are one source;
    null and empty texts have no tokens and come once per full pass; very long texts are
    counted whole; ties of keys go to the same side; repeated rows are all in or all out;
    an empty table stays empty; input columns with the names of results are replaced, all
    others stay, whatever their names.
    """
    added = ("n_tokens", "weight", "copies", "block", "place")
    names = {c: f"in_{i}" for i, c in enumerate(docs.columns)}
    kept = [c for c in docs.columns if c not in added]
    stage = Stage(docs.sparkSession, "mix")
    docs, source_col, id_col, text_col = docs.toDF(*names.values()), names[source_col], names[id_col], names[text_col]
    tokens = F.coalesce(F.regexp_count(F.col(text_col), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")
    block = F.pmod(_key(seed, F.col(id_col)), F.lit(BLOCKS)).cast("int")
    where = {"mx_source": F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")), "mx_block": block, "mx_key": _key(seed + 1, F.col(id_col))}
    stats = stage.save(docs.select(*(c.alias(n) for n, c in where.items()), tokens.alias("tokens")))
    blocks = stage.save(stats.groupBy("mx_source", "mx_block").agg(F.sum("tokens").alias("tokens")))
    sources = stage.save(blocks.groupBy("mx_source").agg(F.sum("tokens").alias("tokens")))
    some = sources.where("tokens > 0")
    a = exponent(some, entropy, repeats, budget_tokens)
    total = some.agg(F.sum("tokens").alias("t"), F.max("tokens").alias("most")).first()
    powers = some.agg(F.sum(F.pow(F.col("tokens") / F.lit(float(total["t"] or 1)), F.lit(a))).alias("z")).first()["z"] or 1.0
    weight = F.pow(F.col("tokens") / F.lit(float(total["t"] or 1)), F.lit(a)) / F.lit(powers)
    if budget_tokens is None:  # passes are largest / tokens to the power 1 - a: least for the largest source, once
        budget = F.pow(F.lit(float(total["most"] or 1)), F.lit(1 - a)) * F.pow(F.col("tokens").cast("double"), F.lit(a))
    else:
        budget = F.lit(float(budget_tokens)) * weight
    if repeats is not None:  # rounding mustn't begin a further pass
        budget = F.least(budget, F.lit(repeats) * F.col("tokens"))
    plan = some.select("mx_source", "tokens", weight.alias("weight"), F.floor(budget + F.lit(1e-6)).cast("long").alias("budget"))
    plan = plan.select("mx_source", "weight", F.floor(F.col("budget") / F.col("tokens")).cast("long").alias("passes"), (F.col("budget") % F.col("tokens")).alias("rest"))

    # Blocks in permuted order up to the rest of the budget; BLOCKS rows a source at most.
    turn = _key(seed + 2, F.col("mx_source"), F.col("mx_block"))
    order = Window.partitionBy("mx_source").orderBy("turn", "mx_block")
    run = blocks.withColumn("turn", turn).withColumn("upto", F.sum("tokens").over(order))
    run = run.join(small(plan.select("mx_source", "rest")), "mx_source").where("upto > rest")
    left = (F.col("rest") - F.col("upto") + F.col("tokens")).alias("left")
    cut = run.groupBy("mx_source").agg(F.min(F.struct("turn", "mx_block", left)).alias("c"))
    cut = stage.save(cut.select("mx_source", "c.turn", F.col("c.mx_block").alias("cut_block"), "c.left"))
    # In the cut block, documents by key while they fit.
    last = cut.select("mx_source", F.col("cut_block").alias("mx_block"), "left")
    edge = stats.join(small(last), ["mx_source", "mx_block"]).groupBy("mx_source", "mx_key", "left").agg(F.sum("tokens").alias("tokens"))
    edge = edge.withColumn("upto", F.sum("tokens").over(Window.partitionBy("mx_source").orderBy("mx_key")))
    keys = edge.where("upto <= left").groupBy("mx_source").agg(F.max("mx_key").alias("last_key"))
    full = stage.save(plan.join(cut, "mx_source", "left").join(keys, "mx_source", "left"))

    rows = docs.select(*(names[c] for c in kept)).withColumns(where | {"n_tokens": tokens})
    rows = rows.join(small(full), "mx_source", "left")
    before = F.coalesce(turn < F.col("turn"), F.lit(False))
    within = F.coalesce((F.col("mx_block") == F.col("cut_block")) & (F.col("mx_key") <= F.col("last_key")), F.lit(False))
    extra = (before | within).cast("long")
    return rows.select(
        *(F.col(names[c]).alias(c) for c in kept),
        "n_tokens",
        F.coalesce("weight", F.lit(0.0)).alias("weight"),
        (F.coalesce("passes", F.lit(1).cast("long")) + extra).alias("copies"),
        F.col("mx_block").alias("block"),
        _key(seed + 3, turn, F.col("mx_key")).alias("place"),
    )
