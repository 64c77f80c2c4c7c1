"""Byte files where Spark's tables lie, as Python tasks and the driver open them."""

from __future__ import annotations

import os
import re
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI as Spark writes it, and the path in it."""
    if uri.startswith("/"):
        return pafs.LocalFileSystem(), uri
    uri = re.sub(r"^file:/+", "file:///", uri)
    uri = re.sub(r"^s3[an]://", "s3://", uri)
    return pafs.FileSystem.from_uri(uri)


class Folder:
    """A folder of Spark's file system, as the driver sees it."""

    def __init__(self, spark: SparkSession, uri: str) -> None:
        self.spark, self.hadoop = spark, spark._jvm.org.apache.hadoop.fs
        path = self.hadoop.Path(uri)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.uri = self.fs.makeQualified(path).toString().rstrip("/")
        self.local = self.uri.startswith("file:")

    def path(self, name: str = ""):
        return self.hadoop.Path(f"{self.uri}/{name}" if name else self.uri)

    def names(self, name: str = "") -> list[str]:
        at = self.path(name)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> bytes:
        source = self.fs.open(self.path(name))
        try:
            return bytes(source.readAllBytes())
        finally:
            source.close()

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def create(self, name: str, data: bytes) -> bool:
        """Makes a file with all of its content at once, unless there is one of this name:
        of several writers exactly one is told True.

        A local file is linked to its name, any other renamed without overwriting, which
        the file system has to do in one step (HDFS does; for an object store the name
        has to go through a file system that does)."""
        temporary = f".{name.rsplit('/', 1)[-1]}-{uuid.uuid4().hex}"
        out = self.fs.create(self.path(temporary))
        out.write(data)
        out.close()
        self.fs.mkdirs(self.path(name).getParent())
        try:
            if self.local:
                os.link(*(self.fs.pathToFile(self.path(x)).getPath() for x in (temporary, name)))
            else:
                context = self.hadoop.FileContext.getFileContext(self.path().toUri(), self.spark._jsc.hadoopConfiguration())
                context.rename(self.path(temporary), self.path(name), self.spark._sc._gateway.new_array(self.hadoop.Options.Rename, 0))
            return True
        except FileExistsError:
            return False
        except Exception as error:  # py4j gives the class as text
            if "FileAlreadyExistsException" in str(error):
                return False
            raise
        finally:
            self.delete(temporary)


def write_files(rows: DataFrame, folder: str, tell: bool = True) -> DataFrame:
    """Writes each row (path, content) to a file under the folder: to a name of its own
    first, which is then moved to the path, so nobody reads half a file and a repeated task
    does no harm.  Gives (path, bytes, error); a file that can't be written is told there
    or, without ``tell``, fails its task, which Spark repeats before it fails the job.
    Runs with the action on what it returns."""

    def write(batches):
        fs, root = opened(folder)
        parents: set[str] = set()
        for batch in batches:
            out = []
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                at = f"{root}/{name}"
                parent, _, base = at.rpartition("/")
                temporary = f"{parent}/.{base}.{uuid.uuid4().hex}"
                try:
                    if parent not in parents:
                        fs.create_dir(parent, recursive=True)
                        parents.add(parent)
                    with fs.open_output_stream(temporary, compression=None) as sink:
                        sink.write(content or b"")
                    fs.move(temporary, at)
                    out.append((name, len(content or b""), None))
                except OSError as error:
                    if not tell:
                        raise
                    out.append((name, None, str(error)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))], ["path", "bytes", "error"])

    return rows.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(write, "path string, bytes long, error string")
