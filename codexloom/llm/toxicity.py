"""Toxicity by a counterfactual-regularised classifier.

A logistic model over the distinct words of a text and their stems (the first 4 to 8
bytes, by their share of the words).  Identity terms are the listed ones and the words of
the sample that share a listed one's stem (plurals, feminine and other forms).  For all
labelled sentences, each identity term in turn is swapped for another term of its group
(or for none); the squared change of the score under a swap, by the words and the stems
that it changes, is part of the loss, and so is the summed weight of each group's terms, so
mentions of a group carry no weight of their own.  Where a sentence has no identity term,
one is put in place of a word of it and swapped from there.  An L1 penalty leaves few
words, so scoring a text is one lookup of its words and stems in a small table.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _kernels as K
from ._shared import Stage, held_out, sampled

#: Labelled texts that a model is fitted on, at most, of each label: whole ones, by hash
#: of their id.
SAMPLE_ROWS = 2_000
#: Longer texts than this (characters) are taken only where a label has too few others,
#: the shorter of them first.
PLAIN_CHARS = 4_000
PENALTY = 0.0001
SWAP_WEIGHT = 40.0
#: Features that a model chooses among, at most, and the least z-score of one.
FEATURES = 4_000
LEAST_SCORE = 3.0
STEMS = (4, 5, 6, 7, 8)
#: A stem counts once if it is there, again if it is one word in 250, and in 80.
SHARES = (1 << 40, 250, 80)
THRESHOLD = 0.7

#: Sentences of more words than this are swapped in parts of so many.
SENTENCE_WORDS = 64
#: Words of sentences that one step swaps in.
STEP_WORDS = 1 << 18
#: Part of all swaps that the summed weights of the groups' terms count for.
SUMMED = 0.02
#: A form of a term begins with its first letters, all but two and five at least (all of a
#: shorter term), and has at most so many letters more or less, two for a shorter term.
FORM_LETTERS = 3

#: Terms for groups of people, neutral in themselves, by language.
IDENTITY = {
    "en": (
        "woman women man men girls boys muslim islamic christian catholic jew jewish hindu buddhist sikh atheist black white asian african arab latino latina hispanic chinese mexican "
        "romani indigenous gay lesbian bisexual homosexual queer straight trans transgender immigrant migrant refugee foreigner disabled deaf blind elderly old young"
    ).split(),
    "fr": (
        "femme femmes homme hommes musulman chrétien catholique juif juive noir noire blanc blanche asiatique africain arabe rom gitan gay lesbienne bisexuel homosexuel transgenre immigré migrant "
        "réfugié étranger handicapé sourd aveugle"
    ).split(),
    "de": (
        "frau frauen mann männer muslim muslimisch christ christlich katholisch jude jüdisch schwarz weiß asiatisch afrikanisch araber roma schwul lesbe lesbisch bisexuell homosexuell "
        "einwanderer migrant flüchtling geflüchtete ausländer behindert gehörlos blind"
    ).split(),
    "es": (
        "mujer mujeres hombre hombres musulmán musulmana cristiano católico judío judía negro blanco asiático africano árabe latino gitano gay lesbiana bisexual homosexual transgénero "
        "inmigrante migrante refugiado extranjero discapacitado sordo ciego"
    ).split(),
}


def _distinct(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each (row, key), and how often the pair occurs."""
    order = np.lexsort((keys, rows))
    r, k = rows[order], keys[order]
    first = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (k[1:] != k[:-1]))) if len(r) else np.zeros(0, np.int64)
    return order[first], np.diff(np.append(first, len(r)))


def stems(words: K.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of ``size`` bytes or more, and a hash of their first bytes."""
    at = np.flatnonzero(words.ends - words.starts >= size)
    value = np.full(len(at), size, np.uint64)
    for j in range(size):
        value = value * np.uint64(257) + words.buffer[words.starts[at] + j]
    return at, K.mix(value)


def features(words: K.Words, chosen: np.ndarray, total: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs of the words at ``chosen``: each distinct word, and each stem
    once for each of SHARES that it reaches among the words of the text (or ``total``)."""
    rows = np.searchsorted(words.offsets, chosen, "right") - 1
    once = _distinct(rows, words.hashes[chosen])[0]
    out_rows, out = [rows[once]], [words.hashes[chosen[once]]]
    part = words._replace(starts=words.starts[chosen], ends=words.ends[chosen])
    total = words.counts() if total is None else total
    for size in STEMS:
        own, keys = stems(part, size)
        own = rows[own]
        first, times = _distinct(own, keys)
        for level, one_in in enumerate(SHARES):
            enough = first[times * one_in >= total[own[first]]]
            out_rows.append(own[enough])
            out.append(keys[enough] + np.uint64(level))
    return np.concatenate(out_rows), np.concatenate(out)


def _tokenise(texts: pa.Array) -> K.Words:
    return K.tokenise(texts, K.LETTERED, True)


def _member(values: np.ndarray, sorted_table: np.ndarray) -> np.ndarray:
    if not len(sorted_table):
        return np.zeros(len(values), bool)
    return sorted_table[np.minimum(np.searchsorted(sorted_table, values), len(sorted_table) - 1)] == values


def known_features(words: K.Words, table: np.ndarray, total: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, place in the sorted ``table``) pairs of the features that the table has."""
    hit = _member(words.hashes, table)
    for size in STEMS:
        at, keys = stems(words, size)
        for level in range(len(SHARES)):
            hit[at] |= _member(keys, table - np.uint64(level))
    rows, keys = features(words, np.flatnonzero(hit), total)
    known = _member(keys, table)
    return rows[known], np.searchsorted(table, keys[known])


class Terms(NamedTuple):
    """Identity terms of all groups as words."""

    words: K.Words
    group: np.ndarray

    @classmethod
    def known(cls, text: K.Words | None = None) -> Terms:
        """The listed terms, and their forms among the words of a text."""
        names = [(g, t) for g, terms in enumerate(IDENTITY.values()) for t in terms]
        if text is not None:
            listed = {t for _, t in names}
            stems_of: dict[str, list[tuple[int, str]]] = {}
            for g, t in names:
                stems_of.setdefault(t[: max(5, len(t) - 2)], []).append((g, t))
            for at in np.unique(text.hashes, return_index=True)[1].tolist():
                word = text.buffer[text.starts[at] : text.ends[at]].tobytes().decode("utf-8", "replace")
                if len(word) < 3 or len(word) > 24 or word in listed:
                    continue
                groups = {g for k in range(3, len(word) + 1) for g, t in stems_of.get(word[:k], ()) if is_form(word, t)}
                names += [(g, word) for g in groups]
            names.sort()
        return cls(_tokenise(pa.array([t for _, t in names], pa.large_string())), np.array([g for g, _ in names]))


def is_form(word: str, term: str) -> bool:
    """Whether a word that begins with the term's stem is long enough and no longer than a form of it."""
    return abs(len(word) - len(term)) <= (FORM_LETTERS if len(term) >= 5 else 2)


def in_parts(words: K.Words, most: int) -> K.Words:
    """Texts of more than ``most`` words as several; those without words are left out."""
    n = words.counts()
    parts = -(-n // most)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    return words._replace(offsets=np.append(np.repeat(words.offsets[:-1], parts) + most * nth, words.offsets[-1]))


def taken(words: K.Words, rows: np.ndarray) -> K.Words:
    """The texts at ``rows``, some of them several times."""
    n = words.counts()[rows]
    offsets = np.append(0, np.cumsum(n))
    at = np.repeat(words.offsets[rows] - offsets[:-1], n) + np.arange(offsets[-1])
    return K.Words(words.buffer, words.starts[at], words.ends[at], offsets, words.hashes[at])


def with_terms(words: K.Words, at: np.ndarray, term: np.ndarray, terms: K.Words) -> K.Words:
    """The words with ``terms[term[s]]`` in the place ``at[s]`` of text s (-1: left out)."""
    starts, ends, hashes = words.starts.copy(), words.ends.copy(), words.hashes.copy()
    put = term >= 0
    starts[at[put]] = terms.starts[term[put]] + len(words.buffer)
    ends[at[put]] = terms.ends[term[put]] + len(words.buffer)
    hashes[at[put]] = terms.hashes[term[put]]
    kept = np.ones(len(starts), bool)
    kept[at[~put]] = False
    offsets = words.offsets - np.append(0, np.cumsum(~put))
    return K.Words(np.concatenate([words.buffer, terms.buffer]), starts[kept], ends[kept], offsets, hashes[kept])


class Swaps(NamedTuple):
    """Differences of features under swaps: entries (row, column, value), and the swaps
    that have the row's difference."""

    rows: np.ndarray
    cols: np.ndarray
    values: np.ndarray
    times: np.ndarray


class ToxicityModel:
    """Weights of a few word hashes."""

    def __init__(self, texts: list[str], labels: np.ndarray) -> None:
        self.words, self.weights = np.zeros(0, np.uint64), np.zeros(0)
        share = float(labels.mean()) if len(labels) else 0.0
        self.bias = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        if not 0 < share < 1:
            return
        column = pa.array(texts, pa.large_string())
        words = _tokenise(column)
        rows, keys = features(words, np.arange(len(words.hashes)))
        terms = Terms.known(words)
        known, at = np.unique(keys, return_inverse=True)
        toxic, all_ = np.bincount(at, labels[rows], len(known)), np.bincount(at, minlength=len(known))
        n, t = len(labels), labels.sum()
        p = all_ / n
        score = np.abs(toxic / t - (all_ - toxic) / (n - t)) / np.sqrt(p * (1 - p) * (1 / t + 1 / (n - t)) + 1e-12)
        best = np.argsort(-score, kind="stable")[:FEATURES]
        vocabulary = np.union1d(known[best[score[best] >= LEAST_SCORE]], terms.words.hashes)
        used = _member(keys, vocabulary)
        rows, cols = rows[used], np.searchsorted(vocabulary, keys[used])
        del words, keys, at, used
        bias, weights = self._fit(rows, cols, labels, len(vocabulary), self._swaps(texts, terms, vocabulary))
        keep = np.abs(weights) > 1e-4
        self.bias, self.words, self.weights = bias, vocabulary[keep], weights[keep]

    @staticmethod
    def _swaps(texts: list[str], terms: Terms, vocabulary: np.ndarray) -> Swaps:
        """Counterfactual pairs of all sentences: each identity term of the sentence or one put
        in place of another word, against another term of the group or none.  A pair is the
        difference of all features of its two sentences; it is taken for the sentence as a
        text and inside longer texts, where a word reaches fewer of SHARES."""
        rng = np.random.default_rng(3)
        sign = rng.integers(1, 1 << 63, len(vocabulary), dtype=np.uint64)  # of a row: the sum of its columns' signs
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        times: dict[int, int] = {}
        order = np.argsort(terms.words.hashes, kind="stable")
        names, sizes = terms.words.hashes[order], np.bincount(terms.group)

        def record(pair: list[K.Words], each: int = 1) -> None:
            n = len(pair[0].offsets) - 1
            for least in (1, *(s + 1 for s in SHARES[:0:-1])):
                (r1, c1), (r2, c2) = (known_features(w, vocabulary, np.maximum(w.counts(), least)) for w in pair)
                cells, back = np.unique(np.concatenate([r1, r2]) * len(vocabulary) + np.concatenate([c1, c2]), return_inverse=True)
                value = np.bincount(back, np.repeat([1.0, -1.0], [len(r1), len(r2)]), len(cells))
                cells, value = cells[value != 0], value[value != 0]
                row, col = np.divmod(cells, len(vocabulary))
                signs = np.zeros(n, np.uint64)
                np.add.at(signs, row, sign[col] * value.astype(np.int64).astype(np.uint64))
                edge = np.searchsorted(row, np.arange(n + 1))
                kinds, which, count = np.unique(signs, return_index=True, return_counts=True)
                for kind, s, k in zip(kinds.tolist(), which.tolist(), count.tolist(), strict=True):
                    times[kind] = times.get(kind, 0) + k * each
                    if kind not in found:
                        found[kind] = col[edge[s] : edge[s + 1]], value[edge[s] : edge[s + 1]]

        def swap(sentences: list[str]) -> None:
            words = in_parts(_tokenise(pa.array(sentences, pa.large_string())), SENTENCE_WORDS)
            n = words.counts()
            inside = np.flatnonzero(_member(words.hashes, names))
            of = np.searchsorted(words.offsets, inside, "right") - 1
            bare = np.setdiff1d(np.arange(len(n)), of)
            group = rng.integers(len(sizes), size=len(bare))
            some = np.searchsorted(terms.group, group) + (rng.random(len(bare)) * sizes[group]).astype(np.int64)
            rows, own = np.concatenate([of, bare]), np.concatenate([order[np.searchsorted(names, words.hashes[inside])], some])
            at = np.concatenate([inside - words.offsets[of], (rng.random(len(bare)) * n[bare]).astype(np.int64)])
            # For one half of the pairs another term of the group, some places on in its list.
            first, size = np.searchsorted(terms.group, terms.group[own]), sizes[terms.group[own]]
            on = 1 + (rng.random(len(rows)) * (size - 1)).astype(np.int64)
            other = np.where(rng.random(len(rows)) < 0.5, first + (own - first + on) % size, -1)
            step = np.cumsum(n[rows]) // STEP_WORDS
            for part in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(step)) + 1):
                if len(part):
                    some = taken(words, rows[part])
                    record([with_terms(some, some.offsets[:-1] + at[part], t[part], terms.words) for t in (own, other)])

        batch, chars = [], 0
        for text in texts:
            batch += (text or "").split(".")
            chars += len(text or "")
            if chars >= K.SEGMENT:
                swap(batch)
                batch, chars = [], 0
        swap(batch)
        none = lambda n: terms.words._replace(starts=names[:0].astype(np.int64), ends=names[:0].astype(np.int64), hashes=names[:0], offsets=np.zeros(n + 1, np.int64))
        record([terms.words, none(len(names))])  # every term at least once against none
        together = terms.words._replace(offsets=np.searchsorted(terms.group, np.arange(len(sizes) + 1)))
        record([together, none(len(sizes))], max(1, int(SUMMED * sum(times.values()) / len(sizes) / len(SHARES))))
        sizes = [len(c) for c, _ in found.values()]
        cols, values = (np.concatenate(x) for x in zip(*found.values(), strict=True))
        return Swaps(np.repeat(np.arange(len(sizes)), sizes), cols, values, np.array([times[k] for k in found], float))

    @staticmethod
    def _fit(rows, cols, y, size, swaps: Swaps, rounds: int = 400) -> tuple[float, np.ndarray]:
        n = len(y)
        balance = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / n
        weight, ahead, t = np.zeros(size + 1), np.zeros(size + 1), 1.0  # the last is the bias
        # The largest curvature, by power iteration on X'DX (with the bias column) plus the swaps.
        v = np.ones(size + 1)
        product = lambda v: np.bincount(rows, v[cols], n) + v[-1]
        back = lambda e: np.append(np.bincount(cols, e[rows], size), e.sum())
        swap = lambda v: np.bincount(swaps.rows, v[swaps.cols] * swaps.values, len(swaps.times)) * swaps.times
        unswap = lambda d: np.bincount(swaps.cols, d[swaps.rows] * swaps.values, size + 1)
        rate = SWAP_WEIGHT / max(1, swaps.times.sum())
        for _ in range(30):
            v = v / (np.linalg.norm(v) + 1e-12)
            v = back(product(v) * balance * 0.25) + rate * unswap(swap(v))
        step = 0.9 / (np.linalg.norm(v) + 1e-12)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(product(ahead), -30, 30)))
            grad = back((p - y) * balance) + rate * unswap(swap(ahead))
            new = ahead - step * grad
            new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * PENALTY, 0)
            t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
            ahead = new + (t - 1) / t2 * (new - weight)
            weight, t = new, t2
        return float(weight[-1]), weight[:-1]

    def scores(self, texts: pa.Array) -> np.ndarray:
        total = np.full(len(texts), self.bias)
        words = _tokenise(texts)
        rows, at = known_features(words, self.words)
        np.add.at(total, rows, self.weights[at])
        return 1 / (1 + np.exp(-np.clip(total, -60, 60)))


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> ToxicityModel:
    """A model from a bounded sample of labelled rows that aren't held out."""
    stage = Stage(docs.sparkSession, "toxicity")
    marks = labels.select(F.col("doc_id").alias("id"), "toxic").where("id is not null and toxic in (0, 1)").distinct()
    marks = marks.where(~held_out("id"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    size = F.greatest(F.length("text") - PLAIN_CHARS, F.lit(0)).alias("over")
    known = stage.save(rows.select("id", size, F.xxhash64("text").alias("which")).join(marks, "id").distinct().withColumn("by", F.xxhash64("id")))
    chosen = None
    for label in (0, 1):
        part = known.where(F.col("toxic") == label)
        plain = sampled(part.where("over = 0"), "by", SAMPLE_ROWS, "id", "which")
        missing = SAMPLE_ROWS - plain.count()
        if missing:
            longer = part.where("over > 0")
            n = longer.count()
            if n > 4 * missing:
                longer = longer.where(F.col("over") <= longer.approxQuantile("over", [2 * missing / n], 0.5 * missing / n)[0])
            plain = plain.unionByName(longer.orderBy("over", "by", "id", "which").limit(missing))
        chosen = plain if chosen is None else chosen.unionByName(plain)
    chosen = stage.save(chosen.select("id", "which", "toxic", "by").distinct())  # 2 * SAMPLE_ROWS rows
    texts = rows.withColumn("which", F.xxhash64("text")).join(F.broadcast(chosen), ["id", "which"]).select("by", "id", "text", "toxic").distinct()
    sample = [(row["text"], row["toxic"]) for row in texts.orderBy("by", "id", "text", "toxic").select("text", "toxic").toLocalIterator()]
    return ToxicityModel([t for t, _ in sample], np.array([m for _, m in sample], float))


def toxicity_scores(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, held_out, score (0 to 1) and predicted (score of ``THRESHOLD`` or more).

    Null and empty texts have no words and get the score of the bias; labels with null
    values, without a document or of held-out documents are not learnt; without labels
    of both kinds the score is the share of toxic ones; very long texts are read whole;
    ties of the sample's order go by the row's values; repeated rows each get the same
    result; an empty table stays empty; other columns are left out.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, text_col, id_col))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def score(batches):
        for batch in batches:
            for piece in K.pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(model.value.scores(piece.column("text")))], names=["id", "score"])

    out = rows.mapInArrow(score, T.StructType([rows.schema["id"], T.StructField("score", T.DoubleType())]))
    return out.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
