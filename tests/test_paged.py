"""The paged source: ranges, pages, pictures, formats, files that are written."""

from __future__ import annotations

import base64
import random

import pytest
from pyspark.sql import functions as F

from codexloom.sources import files, paged
from codexloom.sources.paged import Piece, asset_files, numbered, page_blocks, paged_blocks, pages_of, read_pages


def split(tmp_path, data: bytes, size: int) -> list[bytes]:
    (tmp_path / "x.txt").write_bytes(data)
    out = []
    for n, a in enumerate(range(0, max(1, len(data)), size)):
        out += pages_of(Piece(str(tmp_path / "x.txt"), "text", n, a, min(a + size, len(data))))
    return out


@pytest.mark.parametrize("chunk", [3, 1 << 20])
def test_pages_of_ranges_are_the_pages_of_the_file(tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(paged, "CHUNK", chunk)
    rng = random.Random(1)
    for _ in range(60):
        data = bytes(rng.choice(b"ab\f\fcd") for _ in range(rng.randint(0, 40)))
        expected = data.split(b"\f")
        if not data or data.endswith(b"\f"):
            expected.pop()  # a form feed at the end begins no page
        for size in (1, 2, 5, 13, 100):
            assert split(tmp_path, data, size) == expected


def test_blocks_of_a_page():
    png = base64.b64encode(b"\x89PNG").decode()
    found = page_blocks(f"# A\n\ntext\n![one](data:image/png;base64,{png})\nmore\n\n![two](data:image/png;base64,!!)\n![three](http://x/y.png)\n", "markdown")
    assert [(b["kind"], b["text"]) for b in found] == [("title", "A"), ("paragraph", "text"), ("picture", "one"), ("paragraph", "more"), ("picture", "two"), ("paragraph", "![three](http://x/y.png)")]
    assert found[2]["image"] == b"\x89PNG" and "image" not in found[4] and found[4]["image_error"]
    assert [b["text"] for b in page_blocks("a\r\n\r\n # b \n\n\n", "text")] == ["a", "# b"] and page_blocks("", "markdown") == []


def test_one_file_spreads_over_tasks_and_small_ones_share(spark, tmp_path):
    (tmp_path / "long.md").write_text("\f".join(f"# Page {n}\n\ntext {n}\n\n- entry" for n in range(300)))
    for n in range(40):
        (tmp_path / f"s{n}.txt").write_text(f"one {n}\n\ntwo")
    (tmp_path / "empty.md").write_text("")
    (tmp_path / "bad.txt").write_bytes(b"good\fb\xff\fgood")
    (tmp_path / "a.pdf").write_bytes(b"%PDF")
    (tmp_path / "b.docx").write_bytes(b"x")
    (tmp_path / ".hidden.md").write_text("no")
    pages = read_pages(spark, f"file://{tmp_path}", range_bytes=1000)
    assert 5 < pages.rdd.getNumPartitions() < 20
    assert pages.where("path like '%long.md'").select("part").distinct().count() > 5
    told = {r["path"].rsplit("/", 1)[1]: r["parse_error"] for r in pages.where("parse_error is not null").collect()}
    assert told.pop("bad.txt").startswith("'utf-8' codec") and told == {"a.pdf": "PARSER_MISSING", "b.docx": "UNSUPPORTED_FILE"}
    rows = numbered(pages)
    long = sorted((r["pos"], r["page_no"], r["text"]) for r in rows.where("path like '%long.md'").collect())
    assert [x[0] for x in long] == list(range(900)) and [x[1] for x in long] == [1 + n // 3 for n in range(900)] and long[301][2] == "text 100"
    kinds = [r["kind"] for r in paged_blocks(rows).where(F.col("doc_id") == F.xxhash64(F.lit(f"file://{tmp_path}/long.md"))).orderBy("pos").collect()]
    assert kinds[:4] == ["title", "paragraph", "list_item", "heading"] and kinds.count("title") == 1
    assert rows.where("path like '%/s%.txt'").count() == 80 and rows.where("path like '%empty.md'").count() == 0
    assert [r["page_no"] for r in rows.where("path like '%bad.txt'").orderBy("pos").collect()] == [1, 3]


def test_pictures_are_written_and_damaged_ones_told(spark, tmp_path):
    png = base64.b64encode(b"\x89PNG").decode()
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text(f"![one](data:image/png;base64,{png})\f![two](data:image/png;base64,!)\n\nend")
    rows = numbered(read_pages(spark, str(tmp_path / "in")))
    blocks = paged_blocks(rows).orderBy("pos").collect()
    assert [(b["kind"], b["page_no"], b["metadata"]["source_asset_path"]) for b in blocks] == [("picture", 1, "assets/figures/block_000000.png"), ("picture", 2, None), ("paragraph", 2, None)]
    found = asset_files(rows).collect()
    assert sorted((r["block_id"], r["image_error"] is None) for r in found) == [("block_000000", True), ("block_000001", False)]
    out = files.write_files(asset_files(rows).where("path is not null"), f"file://{tmp_path}/out").collect()
    assert [(r["bytes"], r["error"]) for r in out] == [(4, None)] and (tmp_path / "out" / out[0]["path"]).read_bytes() == b"\x89PNG"


def test_files_that_cannot_be_written_are_told(spark, tmp_path):
    (tmp_path / "d").write_text("a file where a folder should be")
    rows = spark.createDataFrame([("d/x", b"1"), ("e/y", b"22"), ("e/z", None)], "path string, content binary")
    told = {r["path"]: (r["bytes"], r["error"] is None) for r in files.write_files(rows, str(tmp_path)).collect()}
    assert told == {"d/x": (None, False), "e/y": (2, True), "e/z": (0, True)}
    assert sorted(p.name for p in (tmp_path / "e").iterdir()) == ["y", "z"]


def test_a_query_fails_with_a_file_that_cannot_be_written(spark, tmp_path, monkeypatch):
    from codexloom.plans import files as plans

    (tmp_path / "d").write_text("a file where a folder should be")
    monkeypatch.setattr(plans, "folder", lambda _: str(tmp_path))
    rows = spark.createDataFrame([("d/x", b"1"), ("e/y", b"22")], "path string, content binary")
    with pytest.raises(Exception, match=r"/d'"):
        plans._written(rows)
    assert plans._written(rows.where("path <> 'd/x'")) == str(tmp_path) and (tmp_path / "e/y").read_bytes() == b"22"
    (tmp_path / "e/bad.txt").write_bytes(b"good\fb\xff")
    with pytest.raises(Exception, match="utf-8"):
        plans._pages(spark, f"{tmp_path}/e").count()


def test_unknown_modes_are_refused(spark, tmp_path):
    with pytest.raises(Exception, match="unknown mode"):
        read_pages(spark, str(tmp_path), ocr_mode="never").count()
    (tmp_path / "a.txt").write_text("x")
    assert read_pages(spark, str(tmp_path), ocr_mode="force").count() == 1


def test_files_are_listed_in_tasks_and_not_planned_one_by_one(spark, tmp_path):
    for n in range(12):
        (tmp_path / f"{n % 3}").mkdir(exist_ok=True)
        (tmp_path / f"{n % 3}/{n}.txt").write_text(f"a {n}\fb")
    (tmp_path / "long.txt").write_text("\f".join(f"page {n}" for n in range(2_000)))
    pages = read_pages(spark, f"file://{tmp_path}", range_bytes=500)
    assert "paged" not in pages._jdf.queryExecution().executedPlan().toString().lower()
    told = {(r["path"], r["pages"]) for r in numbered(pages).groupBy("path").agg(F.max("page_no").alias("pages")).collect()}
    assert told == {(f"file://{tmp_path}/{n % 3}/{n}.txt", 2) for n in range(12)} | {(f"file://{tmp_path}/long.txt", 2_000)}
    with pytest.raises(FileNotFoundError):
        read_pages(spark, f"file://{tmp_path}/none")


def test_no_files(spark, tmp_path):
    assert numbered(read_pages(spark, str(tmp_path))).count() == 0
