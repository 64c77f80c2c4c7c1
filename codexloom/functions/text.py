"""Scalar text functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as C


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row."""
    return F.transform(F.array(value), body)[0]


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def cjk_chars(text: Column) -> Column:
    return F.when(_ascii(text), F.lit(0)).otherwise(matches(text, C.CJK))


def other_chars(text: Column) -> Column:
    """Characters that are neither ideographs nor white space.  Text of ASCII alone, the most
    of it, is tried against two ranges and not against all."""
    return F.length(F.when(_ascii(text), F.regexp_replace(text, C.ASCII_SPACE, "")).otherwise(F.regexp_replace(text, f"[{C.CJK}{C.SPACE}]+", "")))


def tokens_of(cjk: Column, other: Column) -> Column:
    """Both counts add up over joined texts, so this also holds for sums of them."""
    return F.greatest(F.lit(1), cjk + F.ceil(other / 4)).cast("int")


def estimate_tokens(text: Column) -> Column:
    return tokens_of(cjk_chars(text), other_chars(text))


def casefold(text: Column) -> Column:
    """Full case folding: upper and then lower case undoes sharp s and ligatures; a final
    sigma is a sigma, and a dotless i stays."""
    # The mark stands for a dotless i; what takes it back also parts upper from lower, which
    # the optimizer would make one.
    upper = F.translate(F.upper(F.translate(text, "\u0131", "\ue131")), "\ue131", "\u0131")
    return F.translate(F.lower(upper), "\u03c2", "\u03c3")


def normal_form(text: Column) -> Column:
    return casefold(F.trim(F.regexp_replace(text, f"{C.SPACE}+", " ")))


def strip(text: Column) -> Column:
    """Without blanks at both ends.  A trim looks at the ends only; a pattern would try each
    blank of the text as the beginning of its last ones."""
    return F.trim(text, F.lit(C.BLANKS))


def tokens(text: Column) -> Column:
    """Words of two characters or more, case-folded, in order."""
    found = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.transform(F.filter(found, lambda t: F.length(t) > 1), casefold)


def _counted(left: pa.Array, right: pa.Array) -> pa.Array:
    """``_bags`` of arrow lists: words become numbers, and each row's are counted by sorting
    the pairs of row and number; a million words at a time."""
    n = len(left)
    out = np.zeros((n, 3), dtype=np.int64)
    ends = [np.asarray(x.offsets) for x in (left, right)]
    total = sum(e - e[0] for e in ends)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(total, total[at] + 1_000_000, side="right")) - 1)
        words = pa.chunked_array([x.values.slice(e[at], e[to] - e[at]) for x, e in zip((left, right), ends, strict=True)])
        coded = words.combine_chunks().dictionary_encode(null_encoding="encode")
        size, codes = len(coded.dictionary) + 1, np.asarray(coded.indices).astype(np.int64)
        rows = [np.repeat(np.arange(to - at), np.diff(e[at : to + 1])) for e in ends]
        sides = (codes[: len(rows[0])], codes[len(rows[0]) :])
        (a, na), (b, nb) = (np.unique(r * size + c, return_counts=True) for r, c in zip(rows, sides, strict=True))
        both, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        for column, keys, counts in ((0, both, na[ia] * nb[ib]), (1, a, na * na), (2, b, nb * nb)):
            np.add.at(out[at:to, column], keys // size, counts)
        at = to
    return pa.StructArray.from_arrays([pa.array(out[:, k]) for k in range(3)], ["dot", "aa", "bb"])


def _bags(left: Column, right: Column) -> Column:
    """Dot product and squared norms of two bags of words given as arrays."""
    return F.arrow_udf(_counted, "struct<dot:long,aa:long,bb:long>")(left, right)


def cosine_of(left: Column, right: Column) -> Column:
    """Cosine of two bags of words given as arrays; 0 if one is empty."""
    ratio = lambda t: F.when((t["aa"] > 0) & (t["bb"] > 0), t["dot"] / F.sqrt(t["aa"].cast("double") * t["bb"])).otherwise(F.lit(0.0))
    return let(_bags(left, right), ratio)


def lexical_cosine(left: Column, right: Column) -> Column:
    return cosine_of(tokens(left), tokens(right))


def starts_discourse(text: Column) -> Column:
    folded = casefold(strip(text))
    out = F.lit(False)
    for marker in C.DISCOURSE:
        out = out | folded.startswith(marker)
    return out


def boundary_score(left: Column, right: Column, embedding: Column | None = None) -> Column:
    lexical = lexical_cosine(left, right)
    continuity = lexical if embedding is None else 0.45 * lexical + 0.55 * embedding
    shift = F.when(starts_discourse(right), F.lit(0.12)).otherwise(F.lit(0.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - continuity + shift))


def vector_cosine(a: Column, b: Column) -> Column:
    """Cosine of two array columns of the same length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda t, v: t + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def detect_language(text: Column) -> Column:
    """Script counts first, then marker words; ties go to the earlier language."""
    head = F.substring(text, 1, 20_000)
    named = lambda codes, counts: F.element_at(F.array(*(F.lit(c) for c in codes)), F.array_position(counts, F.array_max(counts)).cast("int"))
    times = lambda t, m: (F.length(t) - F.length(F.replace(t, F.lit(m), F.lit("")))) / len(m)

    # Each list of counts is made once, and the words are counted only where scripts don't tell.
    def by_words(t: Column) -> Column:
        counts = lambda padded: F.array(*(sum((times(padded, m) for m in ms), F.lit(0)) for ms in C.MARKERS.values()))
        padded = F.concat(F.lit(" "), casefold(t), F.lit(" "))
        return let(padded, lambda p: let(counts(p), lambda n: F.when(F.array_max(n) > 0, named(C.MARKERS, n)).otherwise(F.lit("en"))))

    def decide(t: Column) -> Column:
        scripts = F.array(*(matches(t, p) for p in C.SCRIPTS.values()))
        return let(scripts, lambda n: F.when(F.array_max(n) >= 4, named(C.SCRIPTS, n)).when(matches(t, C.HAN) >= 8, F.lit("zh")).otherwise(by_words(t)))

    return let(head, decide)


def contains_formula(text: Column) -> Column:
    return text.rlike(C.FORMULA_IN_BLOCK)


def dense_references(text: Column) -> Column:
    return matches(text, C.CITATION) + matches(text, C.AUTHOR_YEAR) >= 2


def distinct_emails(text: Column) -> Column:
    return F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(C.EMAIL), F.lit(0))))


def join_sentences(sentences: Column) -> Column:
    """No blank after full-width stops, one otherwise."""
    step = lambda done, s: F.when(done == "", s).otherwise(F.concat(done, F.when(F.right(done, F.lit(1)).isin(*"。！？；"), F.lit("")).otherwise(F.lit(" ")), s))
    return strip(F.aggregate(sentences, F.lit(""), step))


def escape_markdown(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def escape_html(text: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def clean_formula(text: Column) -> Column:
    """Without the delimiters of display and inline mathematics."""
    text = strip(F.regexp_replace(strip(text), r"^\$\$\s*|\s*\$\$$", ""))
    for begin, end in ((r"\\\(", r"\\\)"), (r"\\\[", r"\\\]")):
        text = strip(F.regexp_replace(text, f"^{begin}|{end}$", ""))
    return text


def duration(milliseconds: Column) -> Column:
    s = F.greatest(F.lit(0).cast("long"), (milliseconds / 1000).cast("long"))
    minutes = F.floor(s / 60)
    short = F.concat(s, F.lit(" 秒"))
    middle = F.concat(minutes, F.lit(" 分 "), s % 60, F.lit(" 秒"))
    long = F.concat(F.floor(minutes / 60), F.lit(" 小时 "), minutes % 60, F.lit(" 分"))
    return F.when(milliseconds.isNull(), F.lit("-")).when(s < 60, short).when(minutes < 60, middle).otherwise(long)


def path_label(path: Column, title: Column, default: str = "正文") -> Column:
    return F.coalesce(F.nullif(F.array_join(path, " / "), F.lit("")), F.nullif(title, F.lit("")), F.lit(default))


def lookup(value: Column, names: dict[str, str], default: Column | None = None) -> Column:
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    found = F.element_at(F.create_map(*pairs), value)
    return found if default is None else F.coalesce(found, default)


def media_type(name: Column) -> Column:
    suffix = F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))
    return lookup(suffix, C.MEDIA_TYPES, F.lit("application/octet-stream"))


def safe_path(name: Column) -> Column:
    """Relative, without a parent step, a drive or a scheme."""
    return ~(name.startswith("/") | name.startswith("\\") | name.rlike(r"(^|[/\\])\.\.([/\\]|$)") | name.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (name == ""))
