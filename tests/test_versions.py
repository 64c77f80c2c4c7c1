"""Edits, versions, leases, queue strips, model stages and packages, on small fixtures."""

from __future__ import annotations

import hashlib
import io
import json
import random
import time
import zipfile

import numpy as np
from pyspark.sql import functions as F

from codexloom.operators import chunking, models, queue, render, versions


def test_dominated_equals_pairs():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 7, 60, 200):
        a, b = rng.integers(0, 1 + n // 2, n), rng.integers(-5, 1 + n // 3, n)
        want = [int(((a < a[i]) & (b <= b[i])).sum()) for i in range(n)]
        assert queue.dominated(a, b).tolist() == want


def test_queue_positions_in_strips(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(n, "QUEUED" if rng.random() < 0.9 else "LEASED", rng.randint(0, 40), rng.randint(0, 40)) for n in range(400)]
    table = spark.createDataFrame(rows, "job_id long, status string, c int, a int")
    table = table.select("job_id", "status", F.timestamp_seconds(F.col("c") * 1000).alias("created_at"), F.timestamp_seconds(F.col("a") * 1000).alias("available_at"))
    waiting = [r for r in rows if r[1] == "QUEUED"]
    want = {m[0]: 1 + sum(o[2] < m[2] and o[3] <= m[3] for o in waiting) for m in waiting}
    for most in (1_000, 60):
        monkeypatch.setattr(queue, "STRIP_ROWS", most)
        assert {r["job_id"]: r["position"] for r in queue.queue_positions(table).collect()} == want


def test_packing_merges_as_a_fold_of_drafts(spark):
    rng = random.Random(5)
    rows = [(d, n, 0, rng.choice(["paragraph"] * 6 + ["heading", "table"]), rng.randint(0, 5), rng.randint(0, 90), rng.choice([None, None, "SPLIT", "CONTINUE"]), rng.choice("ab")) for d in range(20) for n in range(rng.randint(1, 60))]
    pieces = spark.createDataFrame(rows, "doc_id long, pos int, piece int, kind string, cjk int, other int, decision string, section string")
    out = chunking.pack(pieces, 30, 45, 8).orderBy("doc_id", "pos").collect()
    drafts: dict = {}
    section = {r[:2]: r[7] for r in rows}
    size = {r[:2]: r[4:6] for r in rows}
    for r in out:
        d = drafts.setdefault((r["doc_id"], r["draft"]), [section[r["doc_id"], r["pos"]], r["role"] != "A", 0, 0, r["chunk_index"]])
        assert d[4] == r["chunk_index"]
        d[2] += size[r["doc_id"], r["pos"]][0]
        d[3] += size[r["doc_id"], r["pos"]][1]
    flat = spark.createDataFrame([(doc, n, d[1], d[0], d[2], d[3]) for (doc, n), d in drafts.items()], "doc_id long, draft int, is_text boolean, section string, cjk int, other int")
    merged = {(r["doc_id"], r["draft"]): r["chunk_index"] for r in chunking.merge_small(flat, 30, 8).collect()}
    assert merged == {k: d[4] for k, d in drafts.items()} and len(out) == len(rows)


class Slow:
    def chat(self, task, payload):
        time.sleep(0.05)
        return payload["sourceChunk"] + "|" + ",".join(sorted(payload))


class Down:
    def chat(self, task, payload):
        raise models.Rejected if payload["sourceChunk"] == "bad" else models.Transient


def test_translation_payload_threads_and_fail_over(spark, monkeypatch):
    rows = spark.createDataFrame([(1, n, "TEXT", f"t{n}", False) for n in range(64)], "job_id long, chunk_index int, chunk_type string, source_text string, protected boolean").coalesce(1)
    models.translate(rows.limit(1), Slow).collect()
    began = time.perf_counter()
    out = {r["chunk_index"]: r["translated_text"] for r in models.translate(rows, Slow).collect()}
    assert time.perf_counter() - began < 64 * 0.05  # several calls wait at a time
    keys = "confirmedTerms,previousChunkSummary,sectionSummary,sourceChunk,storyMemory,stylePrompt,targetLanguage,translationProfile"
    assert out == {n: f"t{n}|{keys}" for n in range(64)}
    monkeypatch.setattr(models, "with_retries", lambda call, **options: call())
    call = models._asker(lambda: [Down(), Slow()])
    assert call("translation", {"sourceChunk": "x"}) == "x|sourceChunk"


def test_packages_hold_all_files(spark):
    files = spark.createDataFrame([(1, "a.md", b"x"), (1, "b/c.md", b"y" * 999), (2, "d.md", b""), (2, "../e", b"no")], "job_id long, name string, content binary")
    out = {r["job_id"]: zipfile.ZipFile(io.BytesIO(r["package"])) for r in render.packages(files).collect()}
    assert out[1].namelist() == ["a.md", "b/c.md", "manifest.json"] and out[2].namelist() == ["d.md", "manifest.json"]
    listed = json.loads(out[1].read("manifest.json"))["files"]
    assert listed[1] == {"path": "b/c.md", "bytes": 999, "sha256": hashlib.sha256(b"y" * 999).hexdigest()}


def test_edit_of_a_chunk_that_is_not_there(spark):
    chunks = spark.createDataFrame([(1, "c", "COMPLETED", "old", 0)], "job_id long, chunk_id string, status string, translated_text string, revision_count long")
    jobs = spark.createDataFrame([(1, "COMPLETED"), (2, "TRANSLATING")], "job_id long, status string")
    edits = spark.createDataFrame([(1, "c", " new "), (1, "x", "new"), (9, "c", "new")], "job_id long, chunk_id string, new_text string")
    out = {(r["job_id"], r["chunk_id"]): (r["refused"], r["translated_text"], r["revision_count"]) for r in versions.edited(chunks, jobs, edits).collect()}
    assert out == {(1, "c"): (None, "new", 1), (1, "x"): ("NOT_FOUND", None, None), (9, "c"): ("NOT_FOUND", None, None)}
