"""Paged text files as a data source: ``spark.read.format("paged")``.

Files are Markdown or plain text whose pages are parted by form feeds; a line that is an
image with its data inside (``![caption](data:image/png;base64,...)``) is a picture with an
asset.  A partition is a list of byte ranges, so one long file spreads over many tasks and
many small ones share a task; planning reads names and sizes only.  ``read_pages`` gives the
same pages where files are too many to be planned in one process.  A page belongs to the
range that it begins in, and pages are numbered inside their range; ``numbered`` puts on the
numbers in the file by prefix sums of the counts of each range.

Files of another suffix, and pages that aren't UTF-8, are rows with ``parse_error``.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import schemas
from ..functions import fixed as C
from ..functions import ids
from ..runtime import saved
from .files import Folder, opened
from .sync import listing
from .text import completed, lex_markdown

#: Bytes of a range, and of small files that share a task: at most, and at least where the
#: range is left to the size of all files.
RANGE_BYTES = 32 << 20
LEAST_BYTES = 20_000
CHUNK = 1 << 20
#: Files that share a task at most, whatever their bytes.
FILES = 20_000

_BLOCK = "kind string, text string, markdown string, heading_level int, image binary, image_error string"
_FORMATS = {".pdf": "pdf", ".md": "markdown", ".txt": "text"}
_ARROW_BLOCK = pa.struct([("kind", pa.string()), ("text", pa.string()), ("markdown", pa.string()), ("heading_level", pa.int32()), ("image", pa.binary()), ("image_error", pa.string())])
_ARROW = pa.schema([("path", pa.string()), ("part", pa.int64()), ("page", pa.int64()), ("blocks", pa.list_(_ARROW_BLOCK)), ("parse_error", pa.string())])
SCHEMA = f"path string, part long, page long, blocks array<struct<{_BLOCK.replace(' ', ':').replace(',:', ',')}>>, parse_error string"

_PICTURE = re.compile(r"^[^\S\n]*!\[([^\]\n]*)\]\(data:image/[a-z+.-]+;base64,([^)\n]*)\)[^\S\n]*$", re.M)


class Piece(NamedTuple):
    uri: str
    format: str
    part: int
    start: int
    end: int


def _picture(caption: str, data: str) -> dict:
    try:
        return {"kind": "picture", "text": caption, "markdown": caption, "image": base64.b64decode(data, validate=True)}
    except binascii.Error as error:
        return {"kind": "picture", "text": caption, "markdown": caption, "image_error": str(error)}


def page_blocks(text: str, kind: str) -> list[dict]:
    """Blocks of a page of Markdown or plain text."""
    if kind == "text":
        parts = (x.strip() for x in re.split(r"\n\s*\n", text.replace("\r\n", "\n")))
        return [{"kind": "paragraph", "text": x, "markdown": x} for x in parts if x]
    out, at = [], 0
    for found in _PICTURE.finditer(text):
        out += [*lex_markdown(text[at : found.start()]), _picture(*found.groups())]
        at = found.end()
    return out + lex_markdown(text[at:])


def pages_of(piece: Piece) -> Iterator[bytes]:
    """The pages that begin in the range; the last one is read to its end behind it."""
    fs, path = opened(piece.uri)
    with fs.open_input_file(path) as source:
        size = source.size()
        at = max(0, piece.start - 1)  # where the page begins that is being read
        source.seek(at)
        held, read = [], at

        def chunk() -> bytes:
            nonlocal read
            data = source.read(min(CHUNK, size - read)) if read < size else b""
            read += len(data)
            return data

        skip = piece.start > 0  # what stands before the range's first form feed isn't its own
        if not skip and size == 0:
            return
        while True:
            data = chunk()
            if not data:
                if not skip:
                    yield b"".join(held)
                return
            rest = data
            while True:
                head, found, tail = rest.partition(b"\f")
                if not skip:
                    held.append(head)
                if not found:
                    break
                if not skip:
                    yield b"".join(held)
                    held = []
                at = read - len(tail)
                if at >= piece.end:
                    return
                skip, rest = False, tail


class _Pieces(InputPartition):
    def __init__(self, pieces: list[Piece]) -> None:
        super().__init__(pieces)
        self.pieces = pieces


class PagedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"].rstrip("/")
        self.range, self.tasks = int(options.get("range_bytes", 0)), int(options.get("tasks", 1))
        if options.get("ocr_mode", "auto") not in C.OCR_MODES:
            raise ValueError(f"unknown mode {options['ocr_mode']!r}")

    def partitions(self) -> list[_Pieces]:
        fs, path = opened(self.root)
        found = fs.get_file_info(pafs.FileSelector(path, recursive=True))
        head = self.root[: len(self.root) - len(path)] if self.root.endswith(path) else ""
        found = sorted((f for f in found if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_"))), key=lambda f: f.path)
        most = self.range or min(RANGE_BYTES, max(LEAST_BYTES, -(-sum(f.size for f in found) // self.tasks)))
        out, held, size = [], [], 0
        for info in found:
            kind = _FORMATS.get(f".{info.extension.lower()}", "")
            uri = head + info.path
            if kind not in ("markdown", "text"):
                pieces = [Piece(uri, kind, 0, 0, 0)]
            else:
                pieces = [Piece(uri, kind, n, a, min(a + most, info.size)) for n, a in enumerate(range(0, max(info.size, 1), most))]
            for piece in pieces:
                held.append(piece)
                size += max(1, piece.end - piece.start)
                if size >= most:
                    out.append(_Pieces(held))
                    held, size = [], 0
        return [*out, _Pieces(held)] if held else out or [_Pieces([])]

    def read(self, partition: _Pieces) -> Iterator[pa.RecordBatch]:
        return _rows(partition.pieces)


def _rows(pieces: Iterable[Piece]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0  # of several small files at once
    for piece in pieces:
        if piece.format not in ("markdown", "text"):
            error = "PARSER_MISSING" if piece.format else "UNSUPPORTED_FILE"
            rows.append({"path": piece.uri, "part": 0, "page": 0, "blocks": [], "parse_error": error})
            size += len(piece.uri)
            continue
        for n, page in enumerate(pages_of(piece), 1):
            row = {"path": piece.uri, "part": piece.part, "page": n, "blocks": [], "parse_error": None}
            try:
                row["blocks"] = page_blocks(page.decode(), piece.format)
            except UnicodeDecodeError as error:
                row["parse_error"] = str(error)
            rows.append(row)
            size += len(page) + len(piece.uri)
            if size > CHUNK:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)
                rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _ARROW)


class PagedSource(DataSource):
    """Options: path (a folder), range_bytes or tasks (as many ranges as these, within bounds of
    their size), ocr_mode (checked; text needs no recognition)."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader(dict(self.options))


def read_pages(spark: SparkSession, folder: str, range_bytes: int = 0, ocr_mode: str = "auto") -> DataFrame:
    """Pages of a folder's files: path, part, page (inside the part), blocks, parse_error.
    Without ``range_bytes``, the ranges grow with the files, so that tasks don't get many
    and tiny.

    Files are listed and cut into ranges in tasks, and the ranges dealt out; the driver sees
    their number and their bytes.  (The source of the format plans all ranges in one process.)"""
    if ocr_mode not in C.OCR_MODES:
        raise ValueError(f"unknown mode {ocr_mode!r}")
    if not (at := Folder(spark, folder)).fs.exists(at.path()):
        raise FileNotFoundError(folder)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    kind = F.coalesce(*(F.when(suffix == s, f) for s, f in _FORMATS.items()), F.lit(""))
    files = listing(spark, folder).where(~F.regexp_extract("path", "([^/]*)$", 1).rlike("^[._]")).withColumn("format", kind)
    total = files.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count(F.lit(1))).first()
    most = range_bytes or min(RANGE_BYTES, max(LEAST_BYTES, -(-total[0] // (4 * spark.sparkContext.defaultParallelism))))
    cut = F.when(F.col("format").isin("markdown", "text"), F.greatest(F.col("bytes"), F.lit(1)) - 1).otherwise(0)
    ranges = files.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor(cut / most))))
    ranges = ranges.withColumns({"start": F.col("part") * most, "end": F.least((F.col("part") + 1) * most, "bytes")})
    root, tasks = folder.rstrip("/"), max(1, -(-total[0] // most), -(-total[1] // FILES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _rows(Piece(f"{root}/{name}", *rest) for batch in batches for name, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True))

    dealt = ranges.select("path", "format", "part", "start", "end").repartition(int(tasks), "path", "part")
    return dealt.mapInArrow(run, SCHEMA)


def numbered(pages: DataFrame) -> DataFrame:
    """Blocks of pages: path, pos and page_no in the file, and those of the page.

    The pages are written once; each range's counts of pages and blocks, a row a range, are
    summed up along the file, so that no task holds more than the pages of one range."""
    pages = saved(pages.where("page > 0"))
    sizes = pages.groupBy("path", "part").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.size("blocks")).alias("n"))
    ahead = Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("path", "part", *(F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}_before") for c in ("pages", "n")))
    inside = Window.partitionBy("path", "part").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    rows = pages.join(before, ["path", "part"]).withColumn("first", F.col("n_before") + F.coalesce(F.sum(F.size("blocks")).over(inside), F.lit(0)))
    rows = rows.select("path", (F.col("page") + F.col("pages_before")).cast("int").alias("page_no"), "first", F.posexplode("blocks").alias("nth", "b"))
    return rows.select("path", (F.col("first") + F.col("nth")).cast("int").alias("pos"), "page_no", "b.*")


def paged_blocks(rows: DataFrame) -> DataFrame:
    """Blocks of the document model of ``numbered`` rows; doc_id is the hash of the path.  Only
    the first block of a file is its title.  Pictures with an image name their asset."""
    kind = F.when((F.col("kind") == "title") & (F.col("pos") > 0), "heading").otherwise(F.col("kind"))
    path = F.when(F.col("image").isNotNull(), asset_path())
    meta = F.from_json(F.lit("{}"), schemas.METADATA).withField("source_asset_path", path)
    return completed(rows.withColumns({"doc_id": F.xxhash64("path"), "kind": kind, "block_id": ids.block_id(F.col("pos")), "metadata": meta}))


def asset_path() -> Column:
    return F.concat(F.lit("assets/figures/"), ids.block_id(F.col("pos")), F.lit(".png"))


def asset_files(rows: DataFrame) -> DataFrame:
    """What ``write_files`` takes to store the pictures of ``numbered`` rows, with the block
    and, for a picture whose data can't be read, the error."""
    found = rows.where("image is not null or image_error is not null")
    folder = F.concat(F.xxhash64("path").cast("string"), F.lit("/"))
    return found.select(F.when(F.col("image").isNotNull(), F.concat(folder, asset_path())).alias("path"), F.col("image").alias("content"), F.xxhash64("path").alias("doc_id"), ids.block_id(F.col("pos")).alias("block_id"), "image_error")
