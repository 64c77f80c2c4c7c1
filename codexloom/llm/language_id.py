"""Language identification by cross-parsing entropy.

For each language, a suffix automaton of labelled text is compiled into a transition
array over byte classes.  A text is parsed against each automaton into its longest
matches; the language that needs the fewest phrases for the normalised text wins.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _kernels as K
from ._shared import held_out

#: Labelled texts that a language is learnt from, at most; whole ones, by hash of their id.
TRAIN_TEXTS = 16
#: Longer texts than this (characters) are taken only where there are too few others,
#: the shorter of them first.
PLAIN_CHARS = 2_500
UNKNOWN = "und"

_LETTER = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def normalised(text: str | None) -> bytes:
    """Letters in lower case, anything else one blank."""
    letters = text.lower() if text and not text.isascii() else (text or "")
    if not letters.isascii():
        letters = "".join(c if c.isalpha() else " " for c in letters) if any(not c.isalpha() and ord(c) > 127 for c in set(letters)) else letters
    return b" ".join(letters.encode().translate(_LETTER).split())


class SuffixAutomaton:
    """All substrings of a text; ``table[state + class]`` is the next state's row or 0
    (rows of states begin at ``width``; row 0 stands for no match)."""

    def __init__(self, text: bytes, classes: bytes, width: int) -> None:
        data = text.translate(classes)
        links, lengths, edges = [-1], [0], [{}]
        last = 0
        for c in data:
            new = len(edges)
            edges.append({})
            lengths.append(lengths[last] + 1)
            links.append(0)
            p = last
            while p >= 0 and c not in edges[p]:
                edges[p][c] = new
                p = links[p]
            if p >= 0:
                q = edges[p][c]
                if lengths[q] == lengths[p] + 1:
                    links[new] = q
                else:
                    twin = len(edges)
                    edges.append(dict(edges[q]))
                    lengths.append(lengths[p] + 1)
                    links.append(links[q])
                    while p >= 0 and edges[p].get(c) == q:
                        edges[p][c] = twin
                        p = links[p]
                    links[q] = links[new] = twin
            last = new
        self.table = array("i", bytes(4 * width * (len(edges) + 1)))
        self.root = width
        for s, es in enumerate(edges):
            base = (s + 1) * width
            for c, t in es.items():
                self.table[base + c] = (t + 1) * width

    def phrases(self, data: bytes) -> int:
        """Greedy longest matches that a translated text is made of."""
        table, root = self.table, self.root
        state = count = 0  # row 0 leads nowhere: the first byte begins a phrase
        for c in data:
            state = table[state + c]
            if not state:
                count += 1
                state = table[root + c]  # 0 for a byte that isn't in the language: a phrase of its own
        return count


class LanguageModel:
    def __init__(self, samples: dict[str, bytes]) -> None:
        seen = sorted(set(b"".join(samples.values())))
        names = {b: k + 1 for k, b in enumerate(seen)}
        self.classes = bytes(names.get(b, 0) for b in range(256))
        self.languages = sorted(samples)
        self.automata = [SuffixAutomaton(samples[x], self.classes, len(seen) + 1) for x in self.languages]

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language, and the runner-up's share of the two phrase counts."""
        clean = normalised(text)
        if not clean or not self.automata:
            return UNKNOWN, 0.0
        data = clean.translate(self.classes)
        counts = [a.phrases(data) for a in self.automata]
        best = min(range(len(counts)), key=lambda k: (counts[k], self.languages[k]))
        rest = min((n for k, n in enumerate(counts) if k != best), default=None)
        return self.languages[best], 1.0 if rest is None else rest / (rest + counts[best])


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> LanguageModel:
    """A model from a bounded number of texts of each label that aren't held out."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out("id"))
    size = F.greatest(F.length("text"), F.lit(PLAIN_CHARS)).alias("size")
    order = Window.partitionBy("lang").orderBy("size", "by", "id", "which")
    rows = rows.withColumn("which", F.xxhash64("text"))
    first = rows.select("id", "lang", "which", size, F.xxhash64("id").alias("by")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= TRAIN_TEXTS)
    # TRAIN_TEXTS ids a language; repeated rows have one place each.
    chosen = rows.join(F.broadcast(first.select("id", "lang", "which", "n")), ["id", "lang", "which"]).select("lang", "n", "text").distinct()
    samples: dict[str, bytes] = {}
    for row in chosen.orderBy("lang", "n").toLocalIterator():
        samples[row["lang"]] = samples.get(row["lang"], b"") + b" " + normalised(row["text"])
    return LanguageModel(samples)


def identify(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """id, held_out, lang_pred and score (0 to 1; 0.5 is a tie) of each row.

    Null texts and texts without a letter are ``und`` with score 0, as is any text when
    nothing is labelled; ties go to the first language by name; labels of null or of
    held-out rows are not learnt; very long texts are parsed whole; repeated rows each get
    the same result; an empty table stays empty; other columns are left out.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, text_col, lang_col, id_col))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def predict(batches):
        for batch in batches:
            for piece in K.pieces(batch, "text"):
                found = [model.value.predict(t) for t in piece.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id"), pa.array([x for x, _ in found], pa.string()), pa.array(np.array([s for _, s in found], float))], names=["id", "lang_pred", "score"]
                )

    schema = T.StructType([rows.schema["id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    out = rows.mapInArrow(predict, schema)
    return out.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "lang_pred", "score")
