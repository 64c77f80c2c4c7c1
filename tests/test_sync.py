"""Two trees made equal."""

from __future__ import annotations

import hashlib
from pathlib import Path

import pytest

from codexloom.sources import sync as Y


def write(root: Path, files: dict[str, bytes]) -> str:
    for name, data in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    return str(root)


def read(root: Path) -> dict[str, bytes]:
    return {p.relative_to(root).as_posix(): p.read_bytes() for p in root.rglob("*") if p.is_file()}


NEW = {"a.txt": b"one", "b/c d.txt": b"two", "b/é%20.bin": b"\x00\xff" * 40, "empty": b"", "_x/.hidden": b"h", "p=1/x.md": b"new!"}
OLD = {"a.txt": b"one", "b/c d.txt": b"owt", "gone/deep/y.txt": b"old", "p=1/x.md": b"older"}


@pytest.mark.parametrize("chunk", [7, 8 << 20])
def test_a_tree_becomes_equal_and_a_second_run_moves_nothing(spark, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(Y, "CHUNK", chunk)
    a, b = write(tmp_path / "a", NEW), write(tmp_path / "b", OLD)
    done = {r["path"]: (r["bytes"], r["action"], r["error"]) for r in Y.sync(spark, a, b).collect()}
    assert done == {
        "a.txt": (3, "keep", None), "b/c d.txt": (3, "upload", None), "b/é%20.bin": (80, "upload", None), "empty": (0, "upload", None), "_x/.hidden": (1, "upload", None), "gone/deep/y.txt": (3, "delete", None), "p=1/x.md": (4, "upload", None),
    }
    assert read(tmp_path / "b") == NEW and read(tmp_path / "a") == NEW
    times = {p: p.stat().st_mtime_ns for p in (tmp_path / "b").rglob("*") if p.is_file()}
    assert {r["action"] for r in Y.sync(spark, a, b).collect()} == {"keep"}
    assert times == {p: p.stat().st_mtime_ns for p in (tmp_path / "b").rglob("*") if p.is_file()}
    assert {r["path"]: r["sha256"] for r in Y.hashed(spark, b).collect()} == {k: hashlib.sha256(v).hexdigest() for k, v in NEW.items()}


def test_without_delete_more_files_stay(spark, tmp_path):
    a, b = write(tmp_path / "a", NEW), write(tmp_path / "b", OLD)
    assert "delete" not in {r["action"] for r in Y.sync(spark, a, b, delete=False).collect()}
    assert read(tmp_path / "b")["gone/deep/y.txt"] == b"old"


def test_missing_and_empty_folders(spark, tmp_path):
    a = write(tmp_path / "a", NEW)
    assert {r["action"] for r in Y.sync(spark, a, str(tmp_path / "none")).collect()} == {"upload"} and read(tmp_path / "none") == NEW
    (tmp_path / "empty").mkdir()
    assert {r["action"] for r in Y.sync(spark, str(tmp_path / "empty"), a).collect()} == {"delete"} and read(tmp_path / "a") == {}
    assert Y.sync(spark, str(tmp_path / "empty"), str(tmp_path / "nowhere")).count() == 0


def test_a_file_that_cannot_be_written_is_told(spark, tmp_path):
    a, b = write(tmp_path / "a", NEW), write(tmp_path / "b", {"b": b"a file where a folder belongs"})
    done = {r["path"]: r["error"] for r in Y.sync(spark, a, b, delete=False).collect()}
    assert done["b/c d.txt"] and done["a.txt"] is None
    assert read(tmp_path / "b")["a.txt"] == b"one"
