"""Spelling variants against plain code."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codexloom.llm import spelling
from codexloom.llm.spelling import near_pairs, parity_mask, spelling_variants, words_of
from tests.test_oracle import same_rows

DOC = "doc_id long, text string, word string, n string, form string, id string"


def plain_words(doc_id, text, every, shortest):
    out = []
    for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
        run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
        h = zlib.crc32(f"{doc_id}:{run}".encode())
        if doc_id is not None and h % every == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= shortest:
            out.append(run)
    return out


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(docs, every=97, shortest=5, least=3):
    n = Counter(w for d, t in docs for w in plain_words(d, t, every, shortest))
    n = {w: k for w, k in n.items() if k >= least}
    form, near = {}, {}
    for w in n:
        others = [x for x in n if one_edit(w, x)]
        near[w] = len(others)
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], near[w], n[form[w]] if form[w] else None))
    return sorted(out)


def found(spark, docs, **settings):
    df = spark.createDataFrame([(d, t, "a", "b", "c", "d") for d, t in docs], DOC)
    out = spelling_variants(df, **settings)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in out.collect())


def some_docs(seed=1, size=60):
    rng = random.Random(seed)
    letters = "abcdeéèöß÷ÿàz"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(30)]
    common = [base[min(29, int(rng.expovariate(0.2)))] for _ in range(400)]
    near = [w[:k] + rng.choice(letters) + w[k + rng.randint(0, 1) :] for w in common for k in [rng.randrange(len(w))]]
    words = common * 4 + near
    return [(d, " ".join(rng.choice([w, w.upper(), w.capitalize()]) + rng.choice(["", ".", "-", "ā", "1"]) for w in rng.sample(words, 200))) for d in range(size)]


ODD = [(None, "Straße Straße strase STRASE"), (None, None), (900, ""), (901, None), (902, " \n"), (903, "x" * 3000 + " " + "y" * 3001), (904, "ābcde ābcde"), (905, "straße " * 5000)]


def test_query_equals_sql(spark):
    assert same_rows(spark, "op11_spelling_variants") > 500


def test_words_lose_the_letter_that_the_checksum_names():
    docs = some_docs(3, 40) + ODD
    ids, texts = [None if d is None else str(d) for d, _ in docs], [t for _, t in docs]
    for every in (97, 3):
        got = words_of(ids, pa.array(texts), every, 5)
        assert Counter(got.to_pylist()) == Counter(w for d, t in docs for w in plain_words(d, t, every, 5))


def test_masks_of_near_words_differ_in_two_bits_at_most(spark):
    letters = [chr(c) for c in (*range(0x61, 0x7B), *range(0xC0, 0x100))]
    rng = random.Random(2)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 12))) for _ in range(200)] + letters
    masks = {r["w"]: r["m"] for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", parity_mask(F.col("w")).alias("m")).collect()}
    assert len({masks[x] for x in letters}) == 63
    for w in words:
        expected = 0
        for x in w:
            expected ^= masks[x]
        assert masks[w] == expected


@pytest.mark.parametrize("block", [4096, 2])
def test_near_pairs_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK_WORDS", block)
    rng = random.Random(7)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 6))) for _ in range(250)} | {"aaaaa", "aaaaaa", "÷ÿ×z", "÷ÿ×"}
    rows = spark.createDataFrame([(w, len(w)) for w in words], "word string, n long")
    got = [(r["a"], r["b"]) for r in near_pairs(rows).collect()]
    expected = {frozenset((x, y)) for x in words for y in words if x < y and one_edit(x, y)}
    assert len(got) == len(expected) and {frozenset(p) for p in got} == expected


def test_variants_by_brute_force(spark):
    docs = some_docs() + some_docs()[:5] + ODD
    expected = plain(docs)
    assert found(spark, docs) == expected
    assert any(r[1] and r[2] != r[1] for r in expected)


def test_roots_at_the_end_of_long_chains_and_ties(spark):
    chain = ["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb", "bbbbb"]
    docs = [(None, " ".join(w for k, w in enumerate(chain) for _ in range(3 * 2**k))), (None, "ccccd ccccc cccce " * 3 + "ccccf " * 6 + "ccccg " * 6)]
    expected = plain(docs)
    assert {r[0]: r[2] for r in expected}["aaaaa"] == "bbbbb" and {r[0]: r[1] for r in expected}["cccce"] == "ccccf"
    assert found(spark, docs) == expected


def test_no_words(spark):
    assert found(spark, []) == [] and found(spark, [(1, None), (2, "a b c")]) == []


def test_words_are_sent_in_parts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD_WORDS", 10)
    docs = some_docs(5, 20)
    assert found(spark, docs, every=11, shortest=4, least=2) == plain(docs, 11, 4, 2)


def test_forms_cannot_run_in_circles(spark):
    with pytest.raises(ValueError, match="times"):
        spelling_variants(spark.createDataFrame([], DOC), times=1)
