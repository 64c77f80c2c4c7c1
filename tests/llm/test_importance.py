"""Importance resampling against plain code."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from codexloom.llm import _spans as S
from codexloom.llm import importance
from codexloom.llm.importance import resample

DOC = "doc_id long, text string, rank string, score string, id string, n_words string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, target, percent, least, n, buckets):
    def features(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    raw, wanted = Counter(b for _, t in docs for b in features(t)), Counter(b for t in target for b in features(t))
    s, t = sum(raw.values()), sum(wanted.values())
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1) * (s + buckets) / ((raw[b] + 1) * (t + buckets)))) for b in range(buckets)}
    rows = []
    for doc_id, text in docs:
        own = features(text)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{doc_id}".encode()).hexdigest()[:8], 16)
        score = None if doc_id is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc_id, len(words(text)), len(own), weight, score))
    counted = sorted((r for r in rows if r[4] is not None and r[1] >= least), key=lambda r: (-r[4], r[0], r[2], r[1]))
    out = [(*r, None) for r in rows if r[4] is None or r[1] < least]
    quota = len(counted) * percent // 100
    return sorted([*out, *((*r, k + 1 if k < quota else None) for k, r in enumerate(counted))], key=repr)


def found(spark, docs, target, percent=10, least=20, n=1, buckets=10_000):
    df = spark.createDataFrame([(d, t, "x", "y", "z", "w") for d, t in docs], DOC)
    out = resample(df, spark.createDataFrame([(t,) for t in target], "text string"), percent, least, n, buckets)
    assert out.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_checksums_of_spans():
    rng = np.random.default_rng(5)
    data = rng.integers(0, 256, 3000).astype(np.uint8)
    starts = rng.integers(0, 2700, 500)
    ends = starts + rng.integers(0, 300, 500)
    before = rng.integers(0, 1 << 32, 500, dtype=np.uint64).astype(np.uint32)
    assert S.crc32(data, starts, ends).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
    assert S.crc32(data, starts, ends, before).tolist() == [zlib.crc32(data[a:b].tobytes(), int(v)) for a, b, v in zip(starts, ends, before, strict=True)]
    assert S.crc32(data, starts[:0], ends[:0]).tolist() == []


def test_runs_stay_inside_their_text():
    data, off = np.frombuffer(b"ab-cdef", np.uint8), np.array([0, 0, 2, 5, 5, 7])
    starts, ends, first = S.runs(data != ord("-"), off)
    assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == [(0, 2), (3, 5), (5, 7)] and first.tolist() == [0, 0, 1, 2, 2, 3]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_bags_of_runs_of_words(n):
    texts = ["A b  c, d", None, "", "é", "x-y x-y", "z" * 500 + " q"]
    bags = importance.Bags(pa.array(texts), n, 97)
    expected = [[zlib.crc32(" ".join(w[i : i + k]).encode()) % 97 for k in range(1, n + 1) for i in range(len(w) - k + 1)] for w in map(words, texts)]
    assert bags.n_features.tolist() == [len(x) for x in expected] and bags.n_words.tolist() == [4, 0, 0, 1, 4, 2]
    gain = np.arange(97) ** 2 - 500
    assert bags.weights(gain).tolist() == [sum(gain[b] for b in x) // len(x) if x else 0 for x in expected]


@pytest.mark.parametrize(("n", "buckets", "percent"), [(1, 10_000, 10), (2, 300, 37), (1, 50, 100)])
def test_draw_by_brute_force(spark, n, buckets, percent):
    rng = random.Random(n)
    some = [f"w{k}" for k in range(60)]
    text = lambda k: " ".join(rng.choice(some) for _ in range(k))
    docs = [(k, text(rng.choice([3, 19, 20, 45]))) for k in range(300)]
    docs += [(7, docs[7][1])] * 3 + [(500, text(25))] * 40 + [(8, text(30)), (9, text(21)), (None, text(50)), (None, None), (600, ""), (601, None), (602, "É " * 30), (603, text(20_000))]
    target = [text(12) for _ in range(10)] + [None, "", "W1 w2"]
    assert found(spark, docs, target, percent, 20, n, buckets) == plain(docs, target, percent, 20, n, buckets)


def test_equal_rows_in_blocks_of_copies(spark, monkeypatch):
    monkeypatch.setattr(importance, "COPIES", 4)
    docs = [(1, "a b c")] * 11 + [(2, "a b")] * 5 + [(3, None)] * 2
    assert found(spark, docs, ["b"], 60, 0) == plain(docs, ["b"], 60, 0, 1, 10_000)


def test_draw_of_nothing(spark):
    docs = [(1, "a b c"), (2, None)]
    assert found(spark, [], ["a"]) == []
    assert found(spark, docs, []) == plain(docs, [], 10, 20, 1, 10_000)
    assert found(spark, docs, [None], 100, 0) == plain(docs, [None], 100, 0, 1, 10_000)
    assert found(spark, docs, ["a"], 0, 0) == plain(docs, ["a"], 0, 0, 1, 10_000)
