"""Statistics of a text as Spark column expressions (no Python on the executors)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACES = "[\\x20\\x09-\\x0D]+"
_WORD_CHAR = "[^\\x20\\x09-\\x0D]"

#: Names of what ``with_stats`` adds.
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_punct", "n_distinct")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Runs without white space, in order."""
    return F.array_remove(F.split(text, _SPACES), "")


def count_of(text: Column, members: str) -> Column:
    return F.regexp_count(text, F.lit(f"[{members}]")).cast("long")


def repeated_words(listed: Column, k: int = 3) -> Column:
    """Words inside windows of ``k`` words that occur twice or more in the list.

    Each window is its 64-bit hash and its place.  Sorting them brings equal windows
    together, whose words are then compared; sorting the places of those counts overlapping
    windows once.  O(n log n)."""

    def windows(h: Column) -> Column:
        one = lambda x, i: F.struct(F.xxhash64(x, *(F.get(h, i + j) for j in range(1, k))).alias("h"), i.alias("i"))
        return F.sort_array(F.transform(F.slice(h, F.lit(1), F.size(h) - (k - 1)), one))

    def places(s: Column) -> Column:
        def same(x: Column, y: Column) -> Column:
            equal = x["h"] == y["h"]
            for j in range(k):
                equal = equal & (F.get(listed, x["i"] + j) == F.get(listed, y["i"] + j))
            return F.coalesce(equal, F.lit(False))

        twins = F.filter(s, lambda x, j: same(x, F.get(s, j + 1)) | same(x, F.get(s, j - 1)))
        return F.sort_array(F.transform(twins, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        begin = F.struct(F.lit(0).alias("n"), F.lit(-k).alias("last"))
        grown = lambda done, at: F.struct((done["n"] + F.least(F.lit(k), at - done["last"])).alias("n"), at.alias("last"))
        return F.aggregate(p, begin, grown, lambda done: done["n"].cast("long"))

    hashed = F.transform(listed, lambda w: F.xxhash64(w))
    return let(hashed, lambda h: F.when(F.size(h) >= k, let(windows(h), lambda s: let(places(s), covered))).otherwise(F.lit(0).cast("long")))


def with_stats(rows: DataFrame, text_col: str) -> DataFrame:
    """Adds the columns STATS; null counts as empty.  The lists of words and lines are
    made once a row and dropped again."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(_WORD_CHAR))
    listed = rows.withColumns({"st_words": words(text), "st_lines": lines})
    w, n = F.col("st_words"), F.col("st_lines")
    stats = (
        F.size(w).cast("long"),
        F.length(F.array_join(w, "")).cast("long"),
        count_of(text, "#*$%&|<>"),
        (F.size(n) - F.size(F.array_distinct(n))).cast("long"),
        repeated_words(w),
        F.size(n).cast("long"),
        count_of(text, "A-Z"),
        count_of(text, "0-9"),
        count_of(text, ".,;:!?"),
        F.size(F.array_distinct(w)).cast("long"),
    )
    return listed.withColumns(dict(zip(STATS, stats, strict=True))).drop("st_words", "st_lines")


def ratios() -> dict[str, Column]:
    """Length-free statistics over the columns STATS."""
    per = lambda a, b: F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1))
    return {
        "symbol_ratio": per("n_symbols", "n_words"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"),
        "repeat_ratio": per("n_repeat_words", "n_words"),
        "upper_ratio": per("n_upper", "word_chars"),
        "digit_ratio": per("n_digits", "word_chars"),
        "punct_ratio": per("n_punct", "n_words"),
        "mean_word": per("word_chars", "n_words"),
        "same_ratio": 1 - per("n_distinct", "n_words"),
    }
