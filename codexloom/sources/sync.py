"""Two folder trees made equal: listings compared as tables, contents in tasks.

Folders are named by any URI that Spark and ``opened`` know (local, HDFS, object stores).
All files count, empty and hidden ones, too."""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import saved
from .files import Folder, opened

#: Bytes of a file that a task holds at a time.
CHUNK = 8 << 20


def _spread(rows: DataFrame) -> DataFrame:
    """Rows over as many tasks as a shuffle has partitions: names are far smaller than what
    they name, so their sizes mustn't decide."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes) of all files under a folder, with paths relative to it; none if it
    isn't there.  Folders of one depth are listed in tasks, one depth after the other."""
    uri = Folder(spark, folder).uri

    def run(batches):
        fs, root = opened(uri)
        for batch in batches:
            for name in batch.column("path").to_pylist():
                inside = fs.get_file_info(pafs.FileSelector(f"{root}/{name}" if name else root, allow_not_found=True))
                names = [f"{name}/{i.base_name}" if name else i.base_name for i in inside]
                folders = [i.type == pafs.FileType.Directory for i in inside]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([i.size for i in inside], pa.int64()), pa.array(folders, pa.bool_())], ["path", "bytes", "folder"])

    level = spark.createDataFrame([("",)], "path string")
    found = spark.createDataFrame([], "path string, bytes long")
    while not level.isEmpty():
        rows = saved(_spread(level).mapInArrow(run, "path string, bytes long, folder boolean"))
        found = found.unionByName(rows.where("not folder").select("path", "bytes"))
        level = rows.where("folder").select("path")
    return found


def _chunks(fs, path: str):
    with fs.open_input_stream(path, compression=None) as source:
        while piece := source.read(CHUNK):
            yield piece


def _digest(fs, path: str) -> str:
    found = hashlib.sha256()
    for piece in _chunks(fs, path):
        found.update(piece)
    return found.hexdigest()


def hashed(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, sha256) of all files under a folder."""
    uri = Folder(spark, folder).uri

    def run(batches):
        fs, root = opened(uri)
        for batch in batches:
            digests = [_digest(fs, f"{root}/{p}") for p in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("bytes"), pa.array(digests, pa.string())], ["path", "bytes", "sha256"])

    return _spread(listing(spark, folder)).mapInArrow(run, "path string, bytes long, sha256 string")


def compared(spark: SparkSession, source: str, target: str) -> DataFrame:
    """(path, bytes, action) that make the target equal to the source: ``upload`` what is
    missing there or differs, ``delete`` what the source doesn't have, ``keep`` the rest.
    Contents are read only where both files have the same length."""
    a, b = (Folder(spark, f).uri for f in (source, target))
    there = listing(spark, target).select("path", F.col("bytes").alias("old"))
    rows = _spread(listing(spark, source).join(there, "path", "full_outer"))

    def run(batches):
        (fs, root), (to, base) = opened(a), opened(b)
        for batch in batches:
            names, new, old = (batch.column(c).to_pylist() for c in ("path", "bytes", "old"))
            actions = []
            for name, n, m in zip(names, new, old, strict=True):
                same = n == m and _digest(fs, f"{root}/{name}") == _digest(to, f"{base}/{name}")
                actions.append("delete" if n is None else "keep" if same else "upload")
            sizes = [m if n is None else n for n, m in zip(new, old, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(actions, pa.string())], ["path", "bytes", "action"])

    return rows.select("path", "bytes", "old").mapInArrow(run, "path string, bytes long, action string")


def sync(spark: SparkSession, source: str, target: str, delete: bool = True) -> DataFrame:
    """Makes the target equal to the source and gives (path, bytes, action, error) of each
    file; without ``delete``, files that only the target has stay (``keep``).

    A file is written under a name of its own and then moved, so nobody reads half of it and
    a repeated task does no harm; one that can't be carried is told in ``error`` and doesn't
    stop the others.  The comparison is stored before anything moves."""
    plan = saved(compared(spark, source, target))
    if not delete:
        plan = plan.withColumn("action", F.when(F.col("action") == "delete", "keep").otherwise(F.col("action")))
    a, b = (Folder(spark, f).uri for f in (source, target))

    def carry(fs, root: str, to, base: str, name: str, action: str) -> str | None:
        at = f"{base}/{name}"
        parent, _, own = at.rpartition("/")
        temporary = f"{parent}/.{own}.{uuid.uuid4().hex}"
        try:
            if action == "upload":
                to.create_dir(parent, recursive=True)
                with to.open_output_stream(temporary, compression=None) as sink:
                    for piece in _chunks(fs, f"{root}/{name}"):
                        sink.write(piece)
                to.move(temporary, at)
            elif action == "delete":
                to.delete_file(at)
        except FileNotFoundError as error:
            return None if action == "delete" else str(error)  # an earlier try of this task was there
        except OSError as error:
            return str(error)
        return None

    def run(batches):
        (fs, root), (to, base) = opened(a), opened(b)
        for batch in batches:
            errors = [carry(fs, root, to, base, n, w) for n, w in zip(batch.column("path").to_pylist(), batch.column("action").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(errors, pa.string())], ["path", "bytes", "action", "error"])

    return saved(_spread(plan.select("path", "bytes", "action")).mapInArrow(run, "path string, bytes long, action string, error string"))
