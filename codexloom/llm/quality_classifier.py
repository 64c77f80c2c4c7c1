"""Quality by a sparse rule ensemble.

Boosted trees over text statistics are grown on a bounded sample of labelled rows.
Every path from a root to a node is a conjunctive rule; a logistic model with an L1
penalty weighs the rules, which leaves few; those are compiled into one Spark column
expression, so scoring runs inside the scan, with no Python.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text_stats as S
from ._shared import Stage, held_out, sampled

#: Labelled rows that a model is fitted on, at most (the first by hash of the id).
SAMPLE_ROWS = 20_000
TREES = 12
DEPTH = 3
PENALTY = 0.002
FEATURES = ("symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "digit_ratio", "punct_ratio", "mean_word", "same_ratio", "n_words")


class Condition(NamedTuple):
    feature: int
    cut: float
    over: bool


Rule = tuple[Condition, ...]


def _best_split(x: np.ndarray, g: np.ndarray, h: np.ndarray, least: int) -> tuple[float, int, float]:
    """Gain, feature and cut of the best split for gradients g and curvatures h."""
    best = (1e-9, -1, 0.0)
    total = g.sum() ** 2 / (h.sum() + 1)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, gs, hs = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
        at = np.flatnonzero(v[1:] > v[:-1])
        at = at[(at + 1 >= least) & (len(v) - at - 1 >= least)]
        if len(at):
            gain = gs[at] ** 2 / (hs[at] + 1) + (gs[-1] - gs[at]) ** 2 / (hs[-1] - hs[at] + 1) - total
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), f, float((v[at[k]] + v[at[k] + 1]) / 2))
    return best


def grow_rules(x: np.ndarray, y: np.ndarray, seed: int = 5) -> list[Rule]:
    """Rules of boosted trees, each grown on half of the rows."""
    rng = np.random.default_rng(seed)
    score = np.zeros(len(y))
    found: dict[Rule, None] = {}
    for _ in range(TREES):
        rows = np.flatnonzero(rng.random(len(y)) < 0.5) if len(y) > 200 else np.arange(len(y))
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        nodes: list[tuple[Rule, np.ndarray]] = [((), rows)]
        step = np.zeros(len(y))
        while nodes:
            path, own = nodes.pop()
            split = (0.0, -1, 0.0)
            if len(path) < DEPTH and len(own) >= 10:
                split = _best_split(x[own], g[own], h[own], max(3, len(y) // 1000))
            if split[1] < 0:
                step[holds(path, x)] = g[own].sum() / (h[own].sum() + 1)
                continue
            for over in (False, True):
                rule = (*path, Condition(split[1], split[2], over))
                found[rule] = None
                side = x[own, split[1]] > split[2]
                nodes.append((rule, own[side if over else ~side]))
        score += 0.3 * step
    return list(found)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= (x[:, c.feature] > c.cut) == c.over
    return out


def lasso(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, rounds: int = 600) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty, by accelerated proximal gradient."""
    n = len(y)
    weight, bias = np.zeros(x.shape[1]), 0.0
    ahead, ahead_bias, t = weight.copy(), bias, 1.0
    step = 4 / (1 + (x**2).sum(1).max(initial=1.0))
    for _ in range(rounds):
        error = (1 / (1 + np.exp(-np.clip(x @ ahead + ahead_bias, -30, 30))) - y) / n
        new = ahead - step * n / max(n, 1) * (x.T @ error)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_bias = ahead_bias - step * error.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_bias = new + (t - 1) / t2 * (new - weight), new_bias + (t - 1) / t2 * (new_bias - bias)
        weight, bias, t = new, new_bias, t2
    return bias, weight


class RuleEnsemble:
    """A fitted model: weighted rules over FEATURES."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.rules: list[tuple[Rule, float]] = []
        good = float(y.mean()) if len(y) else 1.0
        self.bias = float(np.log((good + 1e-3) / (1 - good + 1e-3)))
        if 0 < good < 1:
            rules = grow_rules(x, y)
            if rules:
                self.bias, weights = lasso(np.stack([holds(r, x) for r in rules], 1).astype(float), y)
                self.rules = [(r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-4]

    def column(self) -> Column:
        """The score as an expression over columns named as FEATURES."""
        total = F.lit(float(self.bias))
        for rule, weight in self.rules:
            test = F.lit(True)
            for c in rule:
                value = F.col(FEATURES[c.feature])
                test = test & (value > c.cut if c.over else value <= c.cut)
            total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def quality_scores(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, held_out, score (0 to 1) and predicted of each row.

    Null texts count as empty and get the score of an empty text; labels with null
    values, without a document or of held-out documents are not learnt; without labels
    of both kinds the score is the share of good ones (1 without any); very long texts are
    read whole; ties of the sample's order go by the row's values; repeated rows each get
    the same result; an empty table stays empty; other columns are left out.
    """
    stage = Stage(docs.sparkSession, "quality")
    rows = S.with_stats(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text").drop("text")
    rows = stage.save(rows).withColumns(S.ratios())
    marks = labels.select(F.col("doc_id").alias("id"), "quality").where("id is not null and quality in (0, 1)").distinct()
    fit = rows.where(~held_out("id")).join(marks, "id").select(*FEATURES, "quality", F.xxhash64("id").alias("by"), "id")
    sample = sampled(stage.save(fit), "by", SAMPLE_ROWS, "id", "quality", *FEATURES).drop("by", "id").toPandas()
    model = RuleEnsemble(sample[list(FEATURES)].to_numpy(float), sample["quality"].to_numpy(float))
    score = model.column()
    return rows.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
