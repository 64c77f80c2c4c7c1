"""Paged files through a layout parser that is plugged in; none comes with this package.

A parser reads a range of pages of one file and gives items (see ``ITEM``).  Pages are
parsed in batches, so a worker holds the items of a few pages of one file at a time, and
blocks are numbered on from batch to batch."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple, Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import fixed as C
from ..functions import ids
from ..functions import text as X
from .text import parser_items


class Options(NamedTuple):
    ocr: bool
    full_page: bool
    images_scale: float = 2.0


def ocr_options(mode: str) -> Options:
    """off: no recognition; auto: where a page has no text; force: whole pages."""
    if mode not in C.OCR_MODES:
        raise ValueError(f"unknown mode {mode!r}")
    return Options(mode != "off", mode == "force")


class Parser(Protocol):
    def page_count(self, content: bytes) -> int: ...

    def items(self, content: bytes, first: int, last: int) -> Iterable[dict]:
        """Items of the pages first to last, as dictionaries with the keys of ``ITEM``; a
        picture that can't be cut out has ``image_error`` instead of ``image``."""
        ...


ITEM = schemas.struct(
    label=T.StringType(), text=T.StringType(), level=T.IntegerType(), marker=T.StringType(), page_no=T.IntegerType(), bbox=schemas.BBOX, self_ref=T.StringType(), caption_refs=T.ArrayType(T.StringType()), confidence=T.DoubleType(), image=T.BinaryType(), image_error=T.StringType()
)
_BOX = pa.struct([(f.name, pa.float64()) for f in schemas.BBOX.fields])
_KINDS = {"level": pa.int32(), "page_no": pa.int32(), "bbox": _BOX, "caption_refs": pa.list_(pa.string()), "confidence": pa.float64(), "image": pa.binary()}


def parse(files: DataFrame, make: Callable[[Options], Parser], mode: str = "auto", batch_pages: int = 1) -> DataFrame:
    """Items (doc_id, pos and those of ``ITEM``) of files (doc_id, content).  Null and empty
    files have none."""
    options = ocr_options(mode)
    names = [f.name for f in ITEM.fields]
    schema = T.StructType([files.schema["doc_id"], T.StructField("pos", T.IntegerType()), *ITEM.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = make(options)
        for batch in batches:
            key = batch.column("doc_id")
            for n, content in enumerate(batch.column("content").to_pylist()):
                pos = 0
                for first in range(1, (parser.page_count(content) if content else 0) + 1, batch_pages):
                    rows = list(parser.items(content, first, min(first + batch_pages - 1, parser.page_count(content))))
                    if rows:
                        columns = [pa.array([r.get(c) for r in rows], _KINDS.get(c, pa.string())) for c in names]
                        yield pa.RecordBatch.from_arrays([pa.array([key[n].as_py()] * len(rows), key.type), pa.array(range(pos, pos + len(rows)), pa.int32()), *columns], names=schema.names)
                    pos += len(rows)

    return files.select("doc_id", "content").mapInArrow(run, schema)


_SHOWN = ("table", "formula", "picture")


def _asset_path() -> Column:
    kind = X.lookup(F.col("label"), C.LABEL_KINDS, F.lit("other"))
    return F.when(kind.isin(*_SHOWN) & F.col("image").isNotNull(), F.concat(F.lit("assets/"), ids.block_id(F.col("pos")), F.lit(".png")))


def item_blocks(items: DataFrame) -> DataFrame:
    """Blocks of parsed items, with references, confidence and the path of their asset."""
    meta = F.from_json(F.lit("{}"), schemas.METADATA)
    for name in ("self_ref", "caption_refs", "confidence"):
        meta = meta.withField(name, F.col(name))
    return parser_items(items.withColumn("metadata", meta.withField("source_asset_path", _asset_path())).drop("image", "image_error", "self_ref", "caption_refs", "confidence"))


def item_assets(items: DataFrame) -> DataFrame:
    """Cut-out images (doc_id, block_id, relative_path, content) of tables, formulas and
    pictures; one that failed has no path, and the parser's error."""
    kind = X.lookup(F.col("label"), C.LABEL_KINDS, F.lit("other"))
    rows = items.where(kind.isin(*_SHOWN) & (F.col("image").isNotNull() | F.col("image_error").isNotNull()))
    return rows.select("doc_id", ids.block_id(F.col("pos")).alias("block_id"), _asset_path().alias("relative_path"), F.col("image").alias("content"), "image_error")
