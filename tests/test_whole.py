"""Queries cover all of their rows, not a first part of them."""

from __future__ import annotations

from codexloom import plans
from codexloom.functions import fixed as C
from codexloom.plans import adapters as A

SF = "/root/testdata/sf0.001"


def test_suspicion_looks_at_every_line(spark):
    pieces: dict = {}
    for r in A.cut_lines(spark, SF).select("doc_id", "pos", "text").collect():
        pieces.setdefault(r["doc_id"], []).append((r["pos"], r["text"]))
    space = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    expected = set()
    for doc, rows in pieces.items():
        rows.sort()
        for k in range(1, len(rows)):
            left, right = rows[k - 1][1].rstrip(space), rows[k][1].lstrip(space)
            if right[:1].islower() or (left and left[-1] not in C.CLOSERS and rows[k][0] % 3):
                expected.add((doc, k, left[-800:], right[:800]))
    found = plans.QUERIES["cross_chunk_suspicion"](spark, SF).collect()
    assert len(found) == len(expected)
    assert {(r["doc_id"], r["chunk_index"], r["left"], r["right"]) for r in found} == expected


def test_renderings_hold_every_chunk_of_the_job(spark):
    chunks: dict = {}
    for r in A.chunks(spark, SF).collect():
        chunks.setdefault(r["job_id"], []).append(r)
    assert max(map(len, chunks.values())) > 3
    both = {r["job_id"]: r["markdown"] for r in plans.QUERIES["bilingual_markdown"](spark, SF).collect()}
    one = {r["job_id"]: r["markdown"] for r in plans.QUERIES["translated_markdown"](spark, SF).collect()}
    report = {r["job_id"]: r["report"] for r in plans.QUERIES["job_report"](spark, SF).collect()}
    glossary = {r["job_id"]: r["glossary"] for r in plans.QUERIES["glossary_confirmed"](spark, SF).collect()}
    assert set(both) == set(one) == set(report) == set(chunks)
    for job, rows in chunks.items():
        rows.sort(key=lambda r: r["chunk_index"])
        assert [x.split(" -->")[0] for x in both[job].split("<!-- chunk:")[1:]] == [r["chunk_id"] for r in rows]
        shown = [(r["source_text"] if r["protected"] else r["translated"] or "").strip() for r in rows]
        assert one[job] == "\n\n".join(shown).strip() + "\n"
        assert sum(line.startswith("| part ") for line in report[job].split("\n")) == len(rows)
        terms: dict = {}
        for r in rows:
            if r["status"] == "COMPLETED":
                terms[r["source_text"]] = max(terms.get(r["source_text"], ""), r["section"])
        assert glossary.get(job) == (";".join(f"{k}={v}" for k, v in sorted(terms.items())) or None)
