"""The operators for training text, against brute force on small fixtures."""

from __future__ import annotations

import hashlib
import html
import random
import re
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codexloom.llm import _kernels as K
from codexloom.llm import queries, text_stats
from codexloom.llm._shared import table
from codexloom.llm.automata import Automaton
from codexloom.llm.decontaminate import FMIndex, decontaminate
from codexloom.llm.html_text import grown, main_text
from codexloom.llm.language_id import LanguageModel, SuffixAutomaton, identify
from codexloom.llm.mixing import mix_sources
from codexloom.llm.near_dedup import near_duplicates
from codexloom.llm.quality_classifier import quality_scores
from codexloom.llm.quality_rules import apply_rules, binomial_tail
from codexloom.llm.secret_scan import Scanner, _points, find_secrets, redact
from codexloom.llm.substring_dedup import remove_repeats
from codexloom.llm.toxicity import ToxicityModel, toxicity_scores
from tests.test_oracle import same_rows

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, n_words string, spans string"
LABEL = "doc_id long, quality int, toxic int"
WORDS = [f"w{n}" for n in range(40)]


def docs(spark, texts):
    """Documents with extra columns whose names clash with results."""
    return spark.createDataFrame([(n, t, "en" if n % 2 else None, f"s{n % 3}" if n % 4 else None, 0, "x", "y") for n, t in enumerate(texts)], DOC)


ODD = [None, "", " \n\t ", "é", "one", "dup dup", "dup dup", "x " * 5000, "a b   ü"]


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


@pytest.mark.parametrize("name", ["op1_decontaminate", "op8_near_dedup", "op9_substring_dedup", "op13_importance"])
def test_query_equals_sql(spark, name):
    assert same_rows(spark, name) == 200


def test_kernel_words():
    texts = ["", None, "Ab  c\tdé", " x", "y ", "zz"]
    words = K.tokenise(pa.array(texts), K.SPACED, True)
    got = [bytes(words.buffer[s:e]).decode() for s, e in zip(words.starts, words.ends, strict=True)]
    assert got == ["ab", "c", "dé", "x", "y", "zz"] and words.offsets.tolist() == [0, 0, 0, 3, 4, 5, 6]
    same = K.tokenise(pa.array(["c ab", "q ab c"]), K.SPACED, False)
    assert same.hashes[0] == same.hashes[4] and len(set(same.hashes.tolist())) == 3


def test_fm_index_finds_every_occurrence():
    import numpy as np

    rng = random.Random(1)
    for _ in range(20):
        text = [rng.randint(1, 4) for _ in range(rng.randint(1, 200))]
        index = FMIndex(np.array(text), 5)
        patterns = np.array([[rng.randint(1, 4) for _ in range(3)] for _ in range(20)])
        lo, hi = index.search(patterns)
        for p, a, b in zip(patterns.tolist(), lo, hi, strict=True):
            assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(len(text) - 2) if text[i : i + 3] == p]


def test_decontaminate_cases(spark):
    phrase = " ".join(WORDS[:12])
    texts = [*ODD, f"zz {phrase} yy", f"{phrase.upper()}!", " ".join(WORDS[:9]), "short item", f"{phrase} {phrase}"]
    bench = spark.createDataFrame([(1, phrase), (2, "Short, item"), (3, None), (None, phrase), (10, phrase), (4, "")], "item_id long, text string")
    out = {r["doc_id"]: r for r in decontaminate(docs(spark, texts), bench).collect()}
    spans = {n: [tuple(s) for s in out[n]["spans"]] for n in out if out[n]["spans"]}
    assert spans == {9: [(1, 13)], 10: [(0, 12)], 12: [(0, 2)], 13: [(0, 24)]}
    assert out[9]["items"] == ["1", "10"] and out[7]["n_words"] == 5000 and out[0]["n_words"] == 0
    assert decontaminate(docs(spark, texts), bench.limit(0)).where(F.size("spans") > 0).count() == 0
    assert decontaminate(docs(spark, texts).limit(0), bench).count() == 0


def test_decontaminate_in_blocks_is_the_same(spark, monkeypatch):
    import codexloom.llm.decontaminate as D

    docs_, bench = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    whole = sorted((r["doc_id"], str(r["spans"]), str(r["items"])) for r in decontaminate(docs_, bench).collect())
    monkeypatch.setattr(D, "BLOCK_CHARS", 3000)
    assert sorted((r["doc_id"], str(r["spans"]), str(r["items"])) for r in decontaminate(docs_, bench).collect()) == whole


def brute_components(sets, percent=75):
    comp = {d: d for d in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    names = [d for d in sorted(sets) if sets[d]]
    for i, a in enumerate(names):
        for b in names[:i]:
            shared = len(sets[a] & sets[b])
            if 100 * shared >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return {d: root(d) for d in sets}


def test_near_duplicates_by_brute_force(spark):
    rng = random.Random(3)
    texts = list(ODD)
    for g in range(12):
        base = [rng.choice(WORDS) + str(g) for _ in range(rng.choice([4, 30, 120]))]
        for _ in range(rng.choice([1, 2, 5, 90])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                copy[rng.randrange(len(copy))] = f"n{rng.random()}"
            texts.append(" ".join(copy))
    sets = {}
    for n, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[n] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    out = {r["doc_id"]: r for r in near_duplicates(docs(spark, texts)).collect()}
    assert {d: r["component_id"] for d, r in out.items()} == brute_components(sets)
    assert all(r["kept"] == (r["component_id"] == d) and r["n_shingles"] == len(sets[d]) for d, r in out.items())


def test_near_duplicates_goes_on_for_deep_nodes(spark, monkeypatch):
    from codexloom.llm import near_dedup as N

    begun, roots = [], N._roots
    monkeypatch.setattr(N, "_roots", lambda points, trees, s: begun.append(trees) or roots(points, trees, s))
    monkeypatch.setattr(N, "LEAF", 10)
    rng = random.Random(5)
    passage = [f"p{n}" for n in range(60)]
    texts = []
    for _ in range(24):  # pairs whose common words are mostly a passage that all documents have
        own = [f"n{rng.random()}" for _ in range(30)]
        texts += [" ".join(passage + own), " ".join(passage + own[:24] + [f"n{rng.random()}" for _ in range(6)])]
    sets = {n: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for n, t in enumerate(texts)}
    out = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs(spark, texts)).collect()}
    assert out == brute_components(sets)
    last = max(t.stop for t in begun)
    assert last > N.TREES and [t.start for t in begun] == [0, *(t.stop for t in begun[:-1])]
    root = N.kept_together(N.ROOT_TOKENS, N.fan(N.ROOT_TOKENS, 0.75), 0.75)
    assert (1 - root) ** N.TREES <= N.MISSED and all(N.kept_together(k, N.fan(k, 0.75), 0.75) > 0.78 for k in range(1, N.MOST_TOKENS + 1))


def test_near_duplicates_blocks_and_nodes_that_cannot_be_branched(spark, monkeypatch):
    from codexloom.llm import near_dedup as N

    rng = random.Random(9)
    texts = []
    for g in range(6):
        base = [f"{rng.choice(WORDS)}{g}{i}" for i in range(200)]
        for _ in range(20):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 4, 9])):
                copy[rng.randrange(len(copy))] = f"n{rng.random()}"
            texts.append(" ".join(copy))
    sets = {n: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for n, t in enumerate(texts)}
    monkeypatch.setattr(N, "ROOM", 500)
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(docs(spark, texts)).collect()} == brute_components(sets)
    # Equal tokens of different sets: no branch ends, so parts are compared with all others.
    monkeypatch.setattr(N, "LEAF", 6)
    monkeypatch.setattr(N, "most_different", lambda similarity: 64)
    sign = N._signer

    def alike(k):
        def run(batches):
            for batch in sign(k)(batches):
                same = [pa.array([b"\0" * n] * batch.num_rows, pa.binary()) for n in (256, 32)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], *same], names=batch.schema.names)

        return run

    monkeypatch.setattr(N, "_signer", alike)
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(docs(spark, texts[:60])).collect()} == brute_components({n: sets[n] for n in range(60)})


def test_near_duplicates_of_an_id_with_different_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = spark.createDataFrame([(1, a), (4, a), (4, b), (3, b), (7, c), (7, c), (8, a + " z"), (9, c + " z")], "doc_id long, text string")
    out = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(rows).collect())
    assert out == [(1, 1, True), (3, 1, False), (4, 1, False), (4, 1, False), (7, 7, True), (7, 7, True), (8, 1, False), (9, 7, False)]


def test_near_duplicates_links_at_every_similarity_of_the_threshold_and_more(spark):
    rng, texts, wanted = random.Random(17), [], []
    for shared, own in ((75, 12.5), (80, 10), (85, 7.5), (90, 5), (95, 2.5)):  # shingles: J from 0.75 up
        for n in range(40):
            common = [f"c{rng.random()}" for _ in range(2 * shared + 4)]
            for _ in range(2):
                texts.append(" ".join([*common, *(f"o{rng.random()}" for _ in range(int(2 * own)))]))
            wanted.append(len(texts) - 2)
    out = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs(spark, texts)).collect()}
    assert [out[n + 1] for n in wanted] == wanted


def test_near_duplicates_edges(spark):
    rows = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "a b c"), (3, "A B C"), (None, None)], "doc_id long, text string")
    out = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in near_duplicates(rows).collect())
    assert out == [(0, 0, True), (0, 0, True), (3, 3, True), (5, 3, False), (5, 3, False)]
    assert near_duplicates(rows.limit(0)).count() == 0


def test_repeats_by_brute_force(spark):
    rng = random.Random(5)
    passage = [rng.choice(WORDS) + "p" for _ in range(60)]
    texts = [*ODD, " ".join(passage), " ".join(["q", *passage[:36], "r"]), " ".join([*passage[10:44], "s"])]
    for _ in range(30):
        words = [rng.choice(WORDS[:3]) for _ in range(rng.randint(0, 120))]
        texts.append("  ".join(words))
    words = {n: re.findall(r"[^\x20\x09-\x0D]+", t or "") for n, t in enumerate(texts)}
    seen: dict = {}
    for w in words.values():
        for i in range(len(w) - 34):
            g = tuple(w[i : i + 35])
            seen[g] = seen.get(g, 0) + 1
    want = {}
    for n, w in words.items():
        gone = {p for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for p in range(i, i + 35)}
        want[n] = (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
    out = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in remove_repeats(docs(spark, texts)).collect()}
    assert out == want and any(n for _, n, _ in want.values())
    assert remove_repeats(docs(spark, texts).limit(0)).count() == 0


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_secrets(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


def test_secrets_by_regex():
    rng, scanner, n = random.Random(1), Scanner(), 0
    parts = ["token", "secret", "api_key", "apikey", "Password", "passwd", "=", ":", '"', "'", " ", "  ", "AKIA", "abcdef0123456789", "deadbeef" * 4, "A1B2C3D4E5F6G7H8", "é", "\n", "x", "abcdefgh", "Zz9+/=", "0"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        data = text.encode()
        got = [x for x in _points(data, scanner.scan(data)) if x[1] < 3]
        assert got == plain_secrets(text)
        n += len(got)
    assert n > 300


def test_secret_query_by_plain_expressions(spark):
    out = queries.QUERIES["op7_secret_scan"](spark, "/root/testdata/sf0.01").collect()
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, "/root/testdata/sf0.01", "documents").collect()}
    assert len(out) == len(texts)
    kinds = ("assign", "access", "hex")
    for r in out:
        base = plain_secrets(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in kinds] == [sum(x[1] == k for x in base) for k in range(3)]
        own = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in base)
        assert r["base_sha256"] == hashlib.sha256(own.encode()).hexdigest()
        assert set(own.split(",")) - {""} <= set(r["spans"].split(","))
    assert sum(r["n_assign"] + r["n_access"] + r["n_hex"] for r in out) > 0
    assert find_secrets(table(spark, "/root/testdata/sf0.01", "documents").limit(0)).count() == 0


def test_quality_score_is_a_logistic_sum_of_rules(spark):
    """The compiled column against the rules one by one, in numpy."""
    import numpy as np

    from codexloom.llm import quality_classifier as Q

    rng = np.random.default_rng(4)
    x = rng.random((500, len(Q.FEATURES))).round(2)
    y = ((x[:, 0] > 0.6) & (x[:, 3] < 0.5) | (x[:, 5] > 0.9)).astype(float)
    model = Q.RuleEnsemble(x, y)
    assert model.rules and all(abs(w) > 1e-4 for _, w in model.rules)
    total = np.full(len(x), model.bias)
    for rule, weight in model.rules:
        total += weight * np.all([(x[:, c.feature] > c.cut) == c.over for c in rule], axis=0)
    rows = spark.createDataFrame([(n, *r) for n, r in enumerate(x.tolist())], "n long, " + ", ".join(f"{f} double" for f in Q.FEATURES))
    got = np.array([r["s"] for r in rows.select("n", model.column().alias("s")).orderBy("n").collect()])
    assert np.abs(got - 1 / (1 + np.exp(-total))).max() < 1e-9
    assert (np.round(got) == y).mean() > 0.95


def test_scores_of_ties_long_texts_and_repeats(spark):
    rng = random.Random(8)
    ids = [n for n in range(300) if not held_out(n)]
    texts = [(n, " ".join(rng.choice(WORDS) for _ in range(30)) + (" vermin $$$ $$$ $$$" if n % 2 else "")) for n in ids]
    long = " ".join(f"{w}{n}" for n in range(30000) for w in ("a", "b"))
    rows = spark.createDataFrame([*texts, *texts, (7000, long), (7001, long + " vermin $$$"), (7002, None), (7003, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(n, 1 - n % 2, n % 2) for n in ids] * 2, LABEL)
    for scores in (quality_scores, toxicity_scores):
        out: dict = {}
        for r in scores(rows, labels).collect():
            out.setdefault(r["doc_id"], set()).add(r["score"])
        assert len(out) == len(ids) + 4 and all(len(s) == 1 and 0 <= min(s) <= 1 for s in out.values())
        assert out[7002] == out[7003]


def test_more_secrets_and_redaction(spark):
    key = "ghp_" + "a1B2" * 9
    rows = docs(spark, [*ODD, f"é {key} end", f"token = {'0123456789abcdef' * 2} tail", "-----BEGIN RSA PRIVATE KEY-----"])
    out = {r["doc_id"]: r["secrets"] for r in find_secrets(rows).collect()}
    assert [tuple(s) for s in out[9]] == [("github", 2, 42)] and [s["kind"] for s in out[10]] == ["assign", "hex"] and not out[0]
    assert out[11][0]["kind"] == "private_key"
    clean = {r["doc_id"]: r["text"] for r in redact(rows).collect()}
    assert clean[9] == "é [SECRET] end" and clean[10] == "[SECRET] tail" and clean[0] is None and clean[8] == ODD[8]


def test_automaton_is_minimal():
    a = Automaton([("ab|cb", False)], search=False)
    assert a.longest(b"cbx".translate(a.classes)) == 2 and a.longest(b"b".translate(a.classes)) == -1
    assert len(a.outputs) == 4  # start, after a or c, accepting, dead


def test_base_statistics_by_brute_force(spark):
    rng = random.Random(9)
    texts = [*ODD, *(" ".join(rng.choice(WORDS[:4]) for _ in range(rng.randint(0, 60))).replace("w0 ", "w0\n") for _ in range(60)), "l1\nl1\n \n \nl1 $#"]
    out = {r["doc_id"]: r for r in text_stats.with_stats(docs(spark, texts).drop("n_words"), "text").collect()}
    for n, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        cover = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in (i, i + 1, i + 2)} if len(w) < 4000 else set(range(len(w)))
        r = out[n]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(cover))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", t))


def test_binomial_tail(spark):
    import math

    for k, n, p in ((0, 10, 0.1), (3, 50, 0.02), (17, 400, 0.05)):
        want = math.log(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))
        got = spark.range(1).select(binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p).alias("x")).first()["x"]
        assert abs(got - want) < 1e-9


def test_repeats_of_windows_are_exact(spark, monkeypatch):
    """A hash that tells nothing apart doesn't change what counts as equal words."""
    texts = ["a b c a b c", "a b c d a b c", "x y z t u v w", "a a a a", "p q r s p q r"]
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n long, text string")
    got = {r["n"]: r["c"] for r in rows.select("n", text_stats.repeated_words(text_stats.words(F.col("text"))).alias("c")).collect()}
    assert got == {0: 6, 1: 6, 2: 0, 3: 4, 4: 6}
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(1).cast("long"))
    got = {r["n"]: r["c"] for r in rows.where("n in (2)").select("n", text_stats.repeated_words(text_stats.words(F.col("text"))).alias("c")).collect()}
    assert got == {2: 0}


def test_rules_of_the_null_stratum_ties_and_empty_tables(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for n in range(4000):  # texts with marks are bad without a language and good in the empty one
        lang, marked = (None, "")[n % 2], n % 20 < 2
        rows.append((n, " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) + "$$$" * marked for _ in range(60)), lang))
        labels.append((n, int(not (marked and lang is None)), 0))
    table_ = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, LABEL)
    out = {r["doc_id"]: r["kept"] for r in apply_rules(table_.union(table_.limit(50)), marks.union(marks), ["doc_id"]).collect()}
    assert out == {n: label == 1 for n, label, _ in labels}
    assert apply_rules(table_.limit(0), marks, ["doc_id"]).count() == 0


def test_rules_by_brute_force(spark):
    """Cutoffs and verdicts of op6 on sf0.01 in plain Python, with exact fractions of the bound."""
    import math
    from fractions import Fraction

    from codexloom.llm.quality_rules import DELTA, GRID, RISK

    sf = "/root/testdata/sf0.01"
    stats = {r["doc_id"]: r.asDict() for r in text_stats.with_stats(table(spark, sf, "documents"), "text").withColumns(text_stats.ratios()).drop("text").collect()}
    quality = {r["doc_id"]: r["quality"] for r in table(spark, sf, "labels").collect() if r["quality"] is not None}
    learnt = [d for d in stats if d in quality and not held_out(d)]
    strata = {stats[d]["lang"] for d in learnt}
    cuts = sum(map(len, GRID.values()))
    chosen: dict = {}
    for s in strata:
        own = [d for d in learnt if stats[d]["lang"] == s]
        good = [d for d in own if quality[d] == 1]
        for name, grid in GRID.items():
            best = None
            for cut in grid:
                k = sum(stats[d][name] > cut for d in good)
                caught = sum(stats[d][name] > cut for d in own if quality[d] == 0)
                p = Fraction(RISK).limit_denominator(1000) / len(GRID)
                tail = float(sum(math.comb(len(good), i) * p**i * (1 - p) ** (len(good) - i) for i in range(k + 1))) if k < len(good) * p else 1.0
                if tail <= DELTA / (len(strata) * cuts) and caught > 10 * k and (best is None or (caught - 10 * k, cut) > best):
                    best = (caught - 10 * k, cut)
            if best:
                chosen[s, name] = best[1]
    out = queries.QUERIES["op6_quality_rules"](spark, sf).collect()
    assert len(out) == len(stats)
    for r in out:
        s = stats[r["doc_id"]]
        base = s["n_words"] < 50 or 100 * s["n_repeat_words"] > 50 * s["n_words"]
        assert r["base_failed"] == base
        assert r["kept"] == (not base and not any(s[n] > chosen[s["lang"], n] for n in GRID if (s["lang"], n) in chosen))


def test_rules_limit_false_rejections(spark):
    rng = random.Random(6)
    good = [(n, " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(60))) for n in range(3000)]
    bad = [(n, " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) + "$$$" for _ in range(60))) for n in range(3000, 3300)]
    rows = spark.createDataFrame([(n, t, "en") for n, t in good + bad] + [(9999, None, None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(n, 1, 0) for n, _ in good] + [(n, 0, 0) for n, _ in bad] + [(None, 0, 0), (5, None, 0)], LABEL)
    out = {r["doc_id"]: r["kept"] for r in apply_rules(rows, labels, ["doc_id"]).collect()}
    assert not any(out[n] for n, _ in bad) and all(out[n] for n, _ in good) and out[9999] is False
    none = {r["doc_id"]: r["kept"] for r in apply_rules(rows, labels.limit(0), ["doc_id"]).collect()}
    assert all(none[n] for n, _ in good + bad)


def test_html_cases():
    tree = grown()
    page = """<html><head><title>t</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a href=x>A</a></li></ul></nav>
    <div class="cookie-notice">We use cookies on this site for you.</div><article><header><h1>Head &amp; line</h1></header><p>One <b>bo</b>ld<br>two &eacute;<script>var x="</p>";</script></p>
    <p>Last<div class="share-box">Share this</div><p>more</article><aside>Side</aside><section id="comments"><p>A long reader comment that says a lot of words.</p></section><form>Mail <input></form><footer>&copy; F</footer>"""
    assert main_text(page, tree) == "Head & line One bold two é Last more"
    assert main_text(None, tree) == "" and main_text("", tree) == "" and main_text("<p", tree) == ""
    assert main_text("<body><p>" + "word " * 30 + "</p>", tree) == ("word " * 30).strip()


def test_html_open_head_and_empty_svg():
    tree = grown()
    text = " ".join(f"word{n}" for n in range(30))
    assert main_text(f"<head><meta charset=x><title>t</title><body><article><p>{text}</p></article>", tree) == text
    assert main_text(f"<html><head><title>t</title><link rel=x><p>{text}</p>", tree) == text
    assert main_text(f"<head><title>t</title>{text}", tree) == text
    assert main_text(f"<head><title>t</title><style>p</style></head><body><p>{text}</p>", tree) == text
    assert main_text(f"<article><p>one <svg class='i' /> {text}</p><p>more</p></article>", tree) == f"one {text} more"
    assert main_text(f"<article><p>one <svg/>{text}</p><svg><text>no</text></svg><p>more</p></article>", tree) == f"one {text} more"
    assert main_text(f"<article><script src='x'/>var x;</script><p>{text}</p></article>", tree) == text


def test_html_marked_wrappers():
    tree = grown()
    text, other = (" ".join(f"{w}{n}" for n in range(40)) for w in ("word", "other"))
    ends = "<form id='aspnetForm'>", "<div class='content has-sidebar'>", "<div class='no-comments'>", "<section id='layout-sidebar-right'><div class='no-comments'>"
    for start in ends:
        nav, side = "<nav><a href=x>Home</a></nav>", f"<div class='sidebar'><p>{other}</p></div>"
        assert main_text(f"<body>{start}{nav}<article><h1>Head</h1><p>{text}</p><div class='share'>Share {other}</div></article>{side}", tree) == f"Head {text}"
        assert main_text(f"<body>{start}{nav}<main><p>{text}</p></main>{side}", tree) == text
        assert main_text(f"<body>{start}{nav}<article><p>{text}</p></article><section id='comments'><article><p>{other} {other}</p></article></section>", tree) == text
        assert main_text(f"<body>{start}{nav}<h1>Head</h1><p>{text}</p><p>{text}</p>{side}", tree) == f"Head {text} {text}"
    # What the marks rightly name stays out.
    assert main_text(f"<body><article><p>{text}</p></article><div class='related'><article><p>{other}</p></article></div>", tree) == text
    assert main_text(f"<body><div><p>{text}</p></div><div class='related'><article><p>Read this too</p></article></div>", tree) == text
    assert main_text(f"<body><div><p>{text}</p></div><section id='comments'><p>{other} {other}</p></section>", tree) == text
    assert main_text(f"<body><aside><article><p>{other}</p></article></aside><footer><p>{other}</p></footer>", tree) == ""


def test_html_tree_uses_words_and_neighbours():
    from codexloom.llm.html_text import LABELLED

    tree = grown()
    used = {n[0] for n in tree.nodes if len(n) == 4}
    assert 2 in used and 3 in used and used & {0, 1} and used & {4, 5}  # own words and links, the block before, the one after
    assert all(tree.keep(row[:-1]) == bool(row[-1]) for row in LABELLED)
    text, link = " ".join(f"word{n}" for n in range(40)), "<p><a href=x>some other page</a></p>"
    page = f"<div>{link}<p>A headline of it</p><p>{text}</p><p>{text}</p>{link}{link}<p>All rights kept by us, the makers of this small site and others</p>{link}</div>"
    assert main_text(page, tree) == f"A headline of it {text} {text}"


def test_html_teasers_commentary_and_stray_tags():
    import time

    tree = grown()
    text, other = (" ".join(f"{w}{n}" for n in range(40)) for w in ("word", "other"))
    assert main_text(f"<body><article><p>Read this next</p></article><div><p>{text}</p><p>{other}</p></div>", tree) == f"{text} {other}"
    assert main_text(f"<body><article><p>{text}</p><p class='commentary'>{other}</p></article><p>{other}</p>", tree) == f"{text} {other}"
    began = time.perf_counter()
    for page in ("<div>" * 50_000 + "</span>" * 50_000, "<div>" * 50_000 + "<p>x</b>" * 50_000, "<div>" * 50_000 + "<li>x</i>" * 50_000):
        main_text(page, tree)
    assert time.perf_counter() - began < 20


def test_html_quotes_and_comments():
    tree = grown()
    text, other = (" ".join(f"{w}{n}" for n in range(40)) for w in ("word", "other"))
    whole = f"{text} They don't mind {other}"
    for start in ("<p data-x=it's>", '<p title="a"b">', "<p it's>", '<p title="a > b">', "<p title='x' \"y>", '<p title="never ended>', "<p =x>"):
        assert main_text(f"<article>{start}{text}</p><p>They don't mind</p><p>{other}</p></article>", tree) == whole, start
        assert main_text(f"<div>{start}{text}</p><p>They don't mind</p><p>{other}</p></div>", tree) == whole, start
    assert main_text(f"<article><!--><p>{text}</p><!-- a --!><p>They don't mind</p><!---><p>{other}</p><!-- x --></article>", tree) == whole
    assert main_text(f'<article><p class="a" class=\'b\'>{text}<p>They don\'t mind<p class="it&#39;s ad">x</p><p>{other}</article>', tree) == whole


def test_html_names_inside_the_article():
    tree = grown()
    text, other = (" ".join(f"{w}{n}" for n in range(40)) for w in ("word", "other"))
    links = "<ul>" + "".join(f"<li><a href=x{n}>Some page {n}</a></li>" for n in range(5)) + "</ul>"
    head = "<body><nav><a href=x>Home</a></nav><article>"
    cases = (
        (f"<div class='article-header'><h1>Head line</h1></div><p>{text}</p>", f"Head line {text}"),
        (f"<div class='article-header'><h1>Head line</h1><p>By Ann Lee</p></div><p>{text}</p>", f"Head line By Ann Lee {text}"),
        (f"<p>{text}</p><h2 class='section-header'>Sub head</h2><p>{other}</p>", f"{text} Sub head {other}"),
        (f"<p>{text}</p><section class='related-work'><h2>Related work</h2><p>{other}</p><p>A short line.</p><p>{text}</p></section>", f"{text} Related work {other} A short line. {text}"),
        (f"<h1>Head</h1><p>{text}</p>{links}<p>{other}</p>", f"Head {text} {other}"),  # links without a name, within the text and at its end
        (f"<h1>Head</h1><p>{text}</p><p>{other}</p>{links}", f"Head {text} {other}"),
        (f"<h1>Head</h1><p>{text}</p><div class='related'><h3>Related</h3>{links}</div>", f"Head {text}"),
        (f"<h1>Head</h1><p>{text}</p><div class='sidebar'><h3>More</h3><p>{other}</p></div><p>end of it</p>", f"Head {text} end of it"),
        (f"<h1><a href=x>Head line</a></h1><p>{text}</p><p><a href=x>One link of its own</a></p><p>{other}</p>", f"Head line {text} One link of its own {other}"),
    )
    for body, expected in cases:
        assert main_text(f"{head}{body}</article><footer>(c)</footer>", tree) == expected, body
    for linked in range(0, 21):  # paragraphs with half their words in links stay, whatever is beside them
        page = "".join(f"<p>{' '.join(f'a{n}' for n in range(40 - linked))} <a href=x>{' '.join(f'b{n}' for n in range(linked))}</a></p><p>See <a href=y>this</a></p>" for _ in range(3))
        assert len(main_text(f"<article>{page}</article>", tree).split()) == 3 * 42


def test_html_time_and_memory_grow_with_the_page():
    import time
    import tracemalloc

    tree, n = grown(), 50_000
    pages = {
        "ends": "<b><article>" + "<i>" * n + "</b>" * n,
        "nested": "<div class=nav>" * n + "x" + "</div>" * n,
        "lines": "<div class=nav>x" * n,
        "stray": "<div>" * n + "</span>" * n,
        "quotes": "<p a='" * n + "x",
        "equals": "<p " + "a= " * n,
        "raw": "<article><script>" + "</script " * n,
        "blanks": "<p a" + " " * n + "<p " * n,
        "lists": "<li><p><table>" * n + "<li>" * n,
    }
    for name, page in pages.items():
        began = time.perf_counter()
        main_text(page, tree)
        assert time.perf_counter() - began < 6, name
    tracemalloc.start()
    main_text(pages["lines"], tree)
    assert tracemalloc.get_traced_memory()[1] < 200_000_000
    tracemalloc.stop()


def test_html_without_article_equals_a_plain_parser():
    from html.parser import HTMLParser

    from codexloom.llm.html_text import BLOCK_TAGS

    class Plain(HTMLParser):
        """Blocks as (words, words in links, boilerplate) of well-formed pages."""

        def __init__(self):
            super().__init__()
            self.around, self.pieces, self.found = [], [], []

        def flush(self):
            words = "".join(text for text, _ in self.pieces).split()
            if words:
                boiler = any(t in ("nav", "footer", "aside") or c in ("sidebar", "ad") for t, c in self.around)
                self.found.append((words, sum(len(text.split()) for text, link in self.pieces if link), boiler))
            self.pieces = []

        def handle_starttag(self, tag, attrs):
            if tag in BLOCK_TAGS:
                self.flush()
            if tag != "br":
                self.around.append((tag, dict(attrs).get("class")))

        def handle_endtag(self, tag):
            if tag in BLOCK_TAGS:
                self.flush()
            assert self.around.pop()[0] == tag

        def handle_data(self, data):
            self.pieces.append((data, any(t == "a" for t, _ in self.around)))

    tree, rng = grown(), random.Random(8)

    def words(n):
        return " ".join(rng.choice(("fish", "caf&eacute;", "a&amp;b", "don't", "x")) for _ in range(n))

    def block():
        n = rng.choice((1, 2, 4, 9, 20, 30, 70))
        m = rng.randrange(0, n + 1) if rng.random() < 0.4 else 0
        inner = f"{words(n - m)} <a href='x>y' title=\"it's\">{words(m)}</a> <b>{words(1)}</b>{rng.choice(('', '<br>'))}{words(2)}"
        tag = rng.choice(("p", "h2", "div", "blockquote"))
        return f"<{tag} class={rng.choice(('plain', 'text', 'commentary'))}>{inner}</{tag}>"

    for _ in range(300):
        page = ""
        for _ in range(rng.randrange(1, 8)):
            tag, name = rng.choice((("nav", "x"), ("div", "sidebar"), ("footer", "x"), ("section", "x"), ("div", "y"), ("div", "z")))
            page += f"<{tag} class='{name}'>" + "".join(block() for _ in range(rng.randrange(1, 5))) + f"</{tag}>\n"
        # A long block outside any marked part: nothing marked is a wrapper of the page.
        page = f"<html><body>{page}<p>{words(60)}</p></body></html>"
        plain = Plain()
        plain.feed(page)
        plain.close()
        found = plain.found
        own = [(0, 0.0)] + [(len(w), k / len(w)) for w, k, _ in found] + [(0, 0.0)]
        kept = [w for i, (w, _, boiler) in enumerate(found) if tree.keep((*own[i], *own[i + 1], *own[i + 2], boiler, 0, 0, 0, 0))]
        assert main_text(page, tree) == " ".join(" ".join(w) for w in kept)


def test_html_repeated_rows_empty_tables_and_clashing_names(spark):
    from codexloom.llm.html_text import extract

    rows = spark.createDataFrame([(1, "<p>one text</p>", "t", 5), (1, "<p>one text</p>", "t", 5), (None, None, None, None)], "page_id long, html string, text string, n_chars int")
    out = extract(rows)
    assert out.columns == ["page_id", "html", "text", "n_chars"] and sorted(r["text"] for r in out.collect()) == ["", "one text", "one text"]
    assert extract(rows.limit(0)).count() == 0


def test_html_on_pages(spark):
    out = {r["page_id"]: r["text"] for r in queries.QUERIES["op3_html_text"](spark, SF).collect()}
    for r in table(spark, SF, "pages").collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>?", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)[^>]*>", body))
        assert out[r["page_id"]] == " ".join(x for x in parts if x)


def test_suffix_automaton_parses_greedily():
    rng = random.Random(2)
    text = bytes(rng.choice(b"abc") for _ in range(60))
    classes = bytes(b"abc".index(b) + 1 if b in b"abc" else 0 for b in range(256))
    auto = SuffixAutomaton(text, classes, 4)
    for _ in range(100):
        data = bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 30)))
        at = count = 0
        while at < len(data):
            n = next((k for k in range(len(data) - at, 0, -1) if data[at : at + k] in text), 1)
            at, count = at + n, count + 1
        assert auto.phrases(data.translate(classes)) == count


def test_language_cases(spark):
    model = LanguageModel({"en": b"the cat and the dog", "de": b"der hund und die katze"})
    assert model.predict("Und DER Hund!")[0] == "de" and model.predict(None) == ("und", 0.0) and model.predict("12 !?") == ("und", 0.0)
    rows = identify(docs(spark, ODD)).collect()
    assert {r["doc_id"] for r in rows if r["lang_pred"] == "und"} >= {0, 1, 2} and all(r["held_out"] == held_out(r["doc_id"]) for r in rows)
    assert identify(docs(spark, ODD).limit(0)).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    d = table(spark, sf, "documents")
    labels = table(spark, sf, "labels")
    lang = queries.QUERIES["op5_language_id"](spark, sf).where("held_out").join(d, "doc_id")
    assert lang.where("lang_pred = lang").count() >= 0.97 * lang.count()
    good = queries.QUERIES["op2_quality_classifier"](spark, sf).where("held_out").join(labels, "doc_id")
    assert good.where("predicted = quality").count() >= 0.95 * good.count()
    toxic = queries.QUERIES["op10_toxicity"](spark, sf).where("held_out").join(labels, "doc_id")
    assert toxic.where("predicted = 1 and toxic = 0").count() == 0 and toxic.where("predicted = 1 and toxic = 1").count() >= 0.6 * toxic.where("toxic = 1").count()


def test_toxicity_ignores_identity_terms():
    import numpy as np

    rng = random.Random(0)
    texts, marks = [], []
    for n in range(400):
        words = [rng.choice(WORDS) for _ in range(20)]
        if n % 4 == 0:
            words[3] = "vermin"
            words[5] = "refugee" if rng.random() < 0.6 else "x"  # mentions go with toxicity in the sample
        texts.append(" ".join(words) + ".")
        marks.append(n % 4 == 0)
    model = ToxicityModel(texts, np.array(marks, float))
    neutral, toxic = model.scores(pa.array(["the refugee came home", "vermin"])).tolist()
    assert neutral < 0.3 and toxic > 0.7


def test_toxicity_ignores_stems_of_identity_terms():
    import numpy as np

    for term in ("muslim", "transgender"):
        rng = random.Random(0)
        texts = []
        for n in range(400):
            words = [rng.choice(WORDS) for _ in range(20)]
            if n % 4 == 0:
                words[3] = "vermin" if rng.random() < 0.7 else words[3]
                words[5] = term if rng.random() < 0.6 else "x"
            texts.append(" ".join(words) + ".")
        model = ToxicityModel(texts, np.array([n % 4 == 0 for n in range(400)], float))
        long = " ".join(WORDS * 8)
        cases = [f"the {term} came home", f"the {term}s came home", f"{long} {term}", "vermin"]
        *neutral, toxic = model.scores(pa.array(cases)).tolist()
        assert max(neutral) < 0.3 and toxic > 0.7


def test_toxicity_scores_hardly_change_under_swaps():
    """A term in most of the toxic and few of the neutral texts, a planted word in half of the toxic ones."""
    import numpy as np

    for term in ("refugee", "muslim", "gay"):
        for share in (0.6, 0.9):
            rng, texts, marks = random.Random(1), [], []
            for n in range(600):
                words = [rng.choice(WORDS) for _ in range(12)]
                if n % 4 == 0 and rng.random() < 0.5:
                    words[3] = "vermin"
                if rng.random() < (share if n % 4 == 0 else 0.05):
                    words[5] = term
                texts.append(" ".join(words) + ".")
                marks.append(n % 4 == 0)
            model = ToxicityModel(texts, np.array(marks, float))
            frames = ("the {} came home", "w1 w2 w3 {} w5", "{}")
            for frame in frames:
                scores = model.scores(pa.array([frame.format(x) for x in (term, "person", "women", "")]))
                assert scores.max() - scores.min() < 0.05 and scores.max() < 0.5
            assert model.scores(pa.array(["vermin"]))[0] > 0.7


def test_toxicity_scores_hardly_change_for_forms_and_several_terms():
    """Forms that aren't listed, and sentences with several terms, as the only word that most of the toxic texts share."""
    import numpy as np

    for term, others in (("refugees", "refugee"), ("muslims", "muslim"), ("immigrants", "women"), ("lesbian", "lesbians"), ("frauen", "frau"), ("musulmans", "musulmane")):
        rng, texts, marks = random.Random(2), [], []
        for n in range(600):
            words = [rng.choice(WORDS) for _ in range(12)]
            if n % 4 == 0 and rng.random() < 0.5:
                words[3] = "vermin"
            if rng.random() < (0.9 if n % 4 == 0 else 0.05):
                words[5] = term
                if rng.random() < 0.5:
                    words[7] = others
            texts.append(" ".join(words) + ".")
            marks.append(n % 4 == 0)
        model = ToxicityModel(texts, np.array(marks, float))
        for frame in ("the {} came home", "w1 w2 w3 {} w5", "{}", "{} w1 {} and {}"):
            scores = model.scores(pa.array([frame.replace("{}", x) for x in (term, others, "person", "")]))
            assert scores.max() - scores.min() < 0.05 and scores.max() < 0.5, (term, frame, scores)
        assert model.scores(pa.array(["vermin"]))[0] > 0.7


def test_swaps_are_differences_of_all_features():
    import numpy as np

    from codexloom.llm import toxicity as X

    terms = X.Terms.known()
    texts = ["Old men walk.Muslim muslins here", "no term at all", "...", "a gay day. gay gayly gaylord"]
    words = X._tokenise(pa.array([s for t in texts for s in t.split(".")], pa.large_string()))
    vocabulary = np.union1d(np.concatenate([X.features(w, np.arange(len(w.hashes)))[1] for w in (words, terms.words)]), terms.words.hashes)
    swaps = ToxicityModel._swaps(texts, terms, vocabulary)
    levels = len(X.SHARES)
    each = levels * (6 + len(terms.group))  # five sentences with words, one with two terms, and each term against none
    groups = len(X.IDENTITY)
    assert swaps.times.sum() == each + levels * groups * max(1, int(X.SUMMED * each / groups / levels))
    forms = X.Terms.known(X._tokenise(pa.array(["Refugees refuge muslimas gays blacksmiths oldies mention"])))
    found = {forms.words.buffer[a:b].tobytes().decode() for a, b in zip(forms.words.starts, forms.words.ends, strict=True)} - {t for g in X.IDENTITY.values() for t in g}
    assert found == {"refugees", "refuge", "muslimas", "gays"}
    long = X._tokenise(pa.array(["", "a b c d e", "f"]))
    assert X.in_parts(long, 2).counts().tolist() == [2, 2, 1, 1]
    assert X.taken(X.in_parts(long, 2), np.array([1, 1, 3])).hashes.tolist() == long.hashes[[2, 3, 2, 3, 5]].tolist()
    rng = random.Random(1)
    base = X._tokenise(pa.array(["one two three", "four five"], pa.large_string()))
    for _ in range(20):
        at, term = np.array([rng.randrange(3), 3 + rng.randrange(2)]), np.array([rng.randrange(-1, len(terms.group)) for _ in range(2)])
        names = [t for g in X.IDENTITY.values() for t in g]
        plain = [["one", "two", "three"], ["four", "five"]]
        for s in range(2):
            plain[s][at[s] - 3 * s] = names[term[s]] if term[s] >= 0 else ""
        swapped, again = X.with_terms(base, at, term, terms.words), X._tokenise(pa.array([" ".join(p) for p in plain], pa.large_string()))
        pairs = [set(zip(*(x.tolist() for x in X.features(w, np.arange(len(w.hashes)))), strict=True)) for w in (swapped, again)]
        assert pairs[0] == pairs[1] and swapped.counts().tolist() == again.counts().tolist()


def test_toxicity_sample_is_bounded_by_rows(spark, monkeypatch):
    from codexloom.llm import toxicity as X

    monkeypatch.setattr(X, "SAMPLE_ROWS", 100)
    ids = [n for n in range(900) if not held_out(n)]
    texts = [(n, f"{'vermin ' if n % 2 else ''}{' '.join(random.Random(n).choices(WORDS, k=20))}") for n in ids]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(n, 1, n % 2) for n in ids], LABEL)
    taken = []
    monkeypatch.setattr(X, "ToxicityModel", lambda t, m: taken.append((t, m.tolist())) or ToxicityModel(t, m))
    for long in (0, 1, 2):  # no text, every second toxic one, or all are longer than the plain ones
        over = F.lit(False) if not long else (F.col("doc_id") % 4 == 1) | F.lit(long == 2)
        grown = rows.withColumn("text", F.when(over, F.repeat(F.concat("text", F.lit(" ")), F.lit(100))).otherwise(F.col("text")))
        clean, toxic = X.fit(grown.union(grown), labels).scores(pa.array(["w1 w2 w3", "w1 vermin w3"])).tolist()
        assert clean < 0.3 and toxic > 0.7
        assert len(taken[-1][0]) == 200 and sum(taken[-1][1]) == 100
        assert sum(len(t) > X.PLAIN_CHARS for t in taken[-1][0]) == (0 if long < 2 else 200)


def test_classifiers_on_odd_input(spark):
    none = spark.createDataFrame([], LABEL)
    for scores in (quality_scores, toxicity_scores):
        rows = scores(docs(spark, ODD), none).collect()
        assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
        assert scores(docs(spark, ODD).limit(0), none).count() == 0


CLASHES = ["kept", "n_words", "spans", "items", "secrets", "turn", "rest", "left", "passes", "cut_block", "last_key", "mx_block", "mx_source", "row", "id", "n", "path", "comp", "stratum", "st_text", "in_0", "in_1", "weight_", "upto"]


def test_pipeline_stages_on_clashing_names_nulls_and_repeats(spark):
    import corpus_pipeline

    rng = random.Random(2)
    long = [" ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(80)) for _ in range(12)]
    key = "token = " + "0123456789abcdef" * 2
    rows = [(n, t, "en", "a") for n, t in enumerate(long)]
    rows += [(3, long[3], "en", "a"), (4, long[5] + " tail", "de", None), (None, long[0], None, ""), (20, None, "", "b"), (21, "", None, "b"), (22, " ".join([key] * 600 + long), "en", "b")]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    clash = [f"{c}-x" for c in CLASHES]
    docs_ = spark.createDataFrame([(*r, 7, *clash) for r in rows], names + "".join(f", {c} string" for c in CLASHES))
    whole = ["doc_id", "text", "lang", "source", "n_chars", *CLASHES]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs_, SF)
        assert out.columns[: len(whole)] == whole if name != "mixing" else set(out.columns) >= set(whole)
        found = out.collect()
        assert all(r[c] == f"{c}-x" for r in found for c in CLASHES if c in out.columns)
        got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in found)
        every = sorted((-1 if i is None else i, t or "") for i, t, _, _ in rows)
        if name == "near_dedup":  # 3 stays once; 4 has two texts, one near 5's; null ids stay
            assert got == sorted(set(every) - {(5, long[5])})
        elif name == "quality_rules":
            assert got == [x for x in every if x[0] < 20]
        elif name == "secret_scan":
            assert [x[0] for x in got] == [x[0] for x in every] and all("0123456789abcdef" not in x[1] for x in got)
            assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in found)
        else:
            assert got == every
        assert stage(spark, docs_.limit(0), SF).count() == 0


def test_mixing_keeps_the_repetition_limit_with_a_budget(spark):
    sizes = {"a": 4000, "b": 400, "c": 40, None: 7}
    rows = [(n, "w " * (n % 3 + 1), s) for s, k in sizes.items() for n in range(k)] + [(5, "", "c"), (5, None, "c")]
    rows = spark.createDataFrame([(1000 * list(sizes).index(s) * 10 + n, t, s) for n, t, s in rows], "doc_id long, text string, source string")
    total = rows.select(F.sum(F.size(F.filter(F.split("text", " "), lambda x: x != "")))).first()[0]
    for times in (0.1, 1, 2, 3.9, 4):
        out = mix_sources(rows, budget_tokens=int(times * total)).agg(F.max("copies"), F.sum(F.expr("n_tokens * copies"))).first()
        assert out[0] <= 4 and abs(out[1] - int(times * total)) <= 16
    with pytest.raises(ValueError):
        mix_sources(rows, budget_tokens=20 * total)


def check_mix(rows, words):
    """Weights, passes, budgets and cuts of a mix by default settings, in plain Python."""
    import math

    tokens: dict = {}
    for r in rows:
        assert r["n_tokens"] == words[r["doc_id"]]
        tokens[r["source"]] = tokens.get(r["source"], 0) + r["n_tokens"]

    def entropy(a):
        p = [(t / sum(tokens.values())) ** a for t in tokens.values()]
        return -sum(x / sum(p) * math.log(x / sum(p)) for x in p)

    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if entropy(mid) >= 0.99 * math.log(len(tokens)) else (low, mid)
    a = max(low, 1 - math.log(4) / math.log(max(tokens.values()) / min(tokens.values())))
    power = {s: t**a for s, t in tokens.items()}
    for s, t in tokens.items():
        own = [r for r in rows if r["source"] == s]
        assert abs(own[0]["weight"] - power[s] / sum(power.values())) < 1e-5 and len({r["weight"] for r in own}) == 1
        budget = (max(tokens.values()) / t) ** (1 - a) * t
        passes = int(budget / t + 1e-6)
        mixed = sum(r["n_tokens"] * r["copies"] for r in own)
        assert {r["copies"] for r in own} <= {passes, passes + 1}
        # Whole blocks in one order, then documents of the cut block while they fit.
        assert budget - max(r["n_tokens"] for r in own) - 3 <= mixed <= budget + 2
        more = {r["block"] for r in own if r["copies"] > passes}
        split = [b for b in more if any(r["block"] == b and r["copies"] == passes for r in own)]
        assert len(split) <= 1 and all(0 <= r["block"] < 1024 for r in own)
    assert len({r["place"] for r in rows}) == len(rows)


def test_mixing_by_brute_force(spark):
    out = queries.QUERIES["op4_mixing"](spark, SF).collect()
    words = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in table(spark, SF, "documents").collect()}
    assert len(out) == len(words)
    check_mix(out, words)


def test_mixing_meets_its_budget(spark):
    rows = spark.createDataFrame([(n, "w " * (n % 7 + 1), "big" if n % 10 else "small" if n % 20 else None) for n in range(4000)] + [(-1, None, "none")], "doc_id long, text string, source string")
    out = mix_sources(rows).groupBy("source").agg(F.sum("n_tokens").alias("t"), F.sum(F.expr("n_tokens * copies")).alias("m"), F.min("copies").alias("least"), F.max("copies").alias("most"), F.max("weight").alias("w")).collect()
    by = {r["source"]: r for r in out}
    assert all(r["least"] >= 1 for s, r in by.items()) and by["big"]["most"] == 1 and 1 < by["small"]["most"] <= 4
    total = sum(r["m"] for r in out)
    for s in ("big", "small", None):
        assert abs(by[s]["m"] - by[s]["w"] * total) <= 8 and by[s]["most"] - by[s]["least"] <= 1
    half = mix_sources(rows, budget_tokens=1000).agg(F.sum(F.expr("n_tokens * copies"))).first()[0]
    assert 970 <= half <= 1000
    assert mix_sources(rows.limit(0)).count() == 0


def test_pipeline_keeps_one_of_each(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    rows = {r["doc_id"]: r for r in out.collect()}
    source = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    rules = {r["doc_id"] for r in queries.QUERIES["op6_quality_rules"](spark, SF).where("kept").collect()}
    sets = {}
    for d in rules:
        w = re.findall(r"[^\x20\x09-\x0D]+", source[d].lower())
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    kept = {d for d, c in brute_components(sets).items() if d == c}
    leaks = {r["doc_id"] for r in queries.QUERIES["op1_decontaminate"](spark, SF).where("contaminated").collect()}
    assert set(rows) == kept - leaks
    check_mix(list(rows.values()), {d: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for d, r in rows.items()})
    for d, r in rows.items():
        secret = plain_secrets(source[d])
        assert (r["text"] == source[d]) == (not secret) and not [x for x in plain_secrets(r["text"]) if x[1] != 0]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "benchmark_decontamination", "secret_scan", "mixing"]


def test_sample_by_a_hash_cut_is_the_first_rows(spark):
    from codexloom.llm._shared import sampled

    rows = spark.range(5000).withColumn("by", F.xxhash64("id"))
    for n in (50, 1000, 4000, 9000):
        want = [r["id"] for r in rows.orderBy("by", "id").limit(n).collect()]
        assert [r["id"] for r in sampled(rows, "by", n, "id").collect()] == want


def test_a_side_is_broadcast_by_its_bytes(spark):
    from codexloom.llm._shared import small

    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString()
    long = spark.range(20).withColumn("s", F.repeat(F.lit("x"), F.lit(1000)))
    assert hinted(small(long)) and not hinted(small(long, 19_000)) and hinted(small(spark.range(1000), 8000)) and not hinted(small(spark.range(1001), 8000))
    assert hinted(small(long.limit(0), 0)) and not hinted(small(long.select(F.array("s").alias("a")), 10_000))
