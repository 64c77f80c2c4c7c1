"""Plain-text, Markdown and pre-parsed sources."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import fixed as C
from ..functions import ids
from ..functions import text as X


def completed(rows: DataFrame) -> DataFrame:
    """Block rows with every column of the model, absent ones null or empty."""
    defaults = {"text": F.lit(""), "risks": F.array().cast(T.ArrayType(schemas.RISK))}
    for field in schemas.BLOCK.fields:
        if field.name not in rows.columns:
            value = F.from_json(F.lit("{}"), schemas.METADATA) if field.name == "metadata" else defaults.get(field.name, F.lit(None))
            rows = rows.withColumn(field.name, value.cast(field.dataType))
    return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.BLOCK.fields))


def text_blocks(documents: DataFrame) -> DataFrame:
    """Paragraphs of (doc_id, text): cut at blank lines; ids count the empty ones, too."""
    parts = F.split(F.replace("text", F.lit("\r\n"), F.lit("\n")), r"\n\s*\n")
    rows = documents.select("doc_id", F.posexplode(parts).alias("pos", "text")).withColumn("text", X.strip(F.col("text"))).where("text <> ''")
    return completed(rows.withColumns({"kind": F.lit("paragraph"), "markdown": F.col("text"), "block_id": ids.block_id(F.col("pos"))}))


def line_blocks(documents: DataFrame) -> DataFrame:
    """One block a line that isn't blank, one line a page."""
    rows = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).where(X.strip(F.col("text")) != "")
    return completed(rows.withColumns({"kind": F.lit("paragraph"), "markdown": F.col("text"), "block_id": ids.block_id(F.col("pos")), "page_no": F.col("pos")}))


# The lexer is one pattern: at a position, the first alternative that matches names the
# block and how far it goes.  A paragraph ends before a blank line, a heading, a fence, a
# display formula or the first line of a table, but not before a caption or a list item.
_EOL = r"(?:\n|\Z)"
_RULE = r"[^\S\n]*\|?[^\S\n]*:?-{3}"
_TABLE_START = rf"[^\n]*\|[^\n]*\n{_RULE}"
_STOP = rf"(?:[^\S\n]*{_EOL}|\#{{1,6}}[^\S\n]|[^\S\n]*```|[^\S\n]*\$\$|{_TABLE_START})"
_LEXER = re.compile(
    rf"""
    (?P<blank>[^\S\n]*\n|[^\S\n]+\Z)
    |(?P<heading>(?P<marks>\#{{1,6}})[^\S\n]+(?P<title>[^\n]+){_EOL})
    |(?P<code>[^\S\n]*```[^\n]*{_EOL}(?:(?![^\S\n]*```)[^\n]*\n|(?![^\S\n]*```)[^\n]+\Z)*(?:[^\S\n]*```[^\n]*{_EOL})?)
    |(?P<formula>[^\S\n]*\$\$(?:[^\n]*\$\$[^\n]*{_EOL}|[^\n]*{_EOL}(?:(?![^\n]*\$\$)[^\n]*\n|(?![^\n]*\$\$)[^\n]+\Z)*(?:[^\n]*\$\$[^\n]*{_EOL})?))
    |(?P<table>(?={_TABLE_START})(?:(?![^\S\n]*{_EOL})[^\n]*\|[^\n]*{_EOL})+)
    |(?P<caption>[^\S\n]*(?:(?:Table|Figure|Fig\.)[^\S\n]+\d+[^\S\n]*[.:]|[表图][^\S\n]*\d+[^\S\n]*[：:.])[^\S\n]*[^\n]+{_EOL})
    |(?P<list_item>[^\S\n]*(?:[-*+]|\d+\.)[^\S\n]+(?P<entry>[^\n]+){_EOL})
    |(?P<paragraph>[^\n]+{_EOL}(?:(?!{_STOP})[^\n]+{_EOL})*)
    """,
    re.X | re.I,
)


def lex_markdown(content: str) -> list[dict]:
    """Blocks of one Markdown text."""
    content = content.replace("\r\n", "\n")
    out: list[dict] = []
    at = 0
    while at < len(content):
        found = _LEXER.match(content, at)
        if found is None:
            raise ValueError(f"no block at {at}")
        at = found.end()
        kind = found.lastgroup if found.lastgroup not in ("marks", "title", "entry") else "heading"
        kind = next(k for k in ("blank", "heading", "code", "formula", "table", "caption", "list_item", "paragraph") if found[k] is not None)
        if kind == "blank":
            continue
        markdown = found[0].removesuffix("\n")
        level, text = None, markdown
        if kind == "heading":
            level, text = len(found["marks"]), found["title"].strip()
            kind = "title" if level == 1 and not out else "heading"
        elif kind == "code":
            text = "\n".join(markdown.split("\n")[1:-1])
        elif kind == "list_item":
            text = found["entry"]
        elif kind in ("caption", "paragraph"):
            text = markdown = markdown.strip()
        out.append({"kind": kind, "text": text, "markdown": markdown, "heading_level": level})
    return out


_MARKDOWN = "doc_id long, pos int, kind string, text string, markdown string, heading_level int"


def markdown_blocks(documents: DataFrame) -> DataFrame:
    """Blocks of Markdown texts (doc_id, text).  Scanning a text is sequential, so it is a
    Python lexer over Arrow batches; it keeps the partitioning, nothing is shuffled."""

    def scan(batches):
        for batch in batches:
            rows = [(d, n, *b.values()) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for n, b in enumerate(lex_markdown(t or ""))]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "pos", "kind", "text", "markdown", "heading_level"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, _MARKDOWN)
    return completed(rows.withColumn("block_id", ids.block_id(F.col("pos"))))


def parser_items(items: DataFrame) -> DataFrame:
    """Blocks of a layout parser's items: doc_id, pos, label, text, level, marker, page_no, and
    a box with a bottom-left origin (left, top, right, bottom, page_width, page_height)."""
    kind = X.lookup(F.col("label"), C.LABEL_KINDS, F.lit("other"))
    level = F.when(kind == "title", 1).when(kind == "heading", F.coalesce("level", F.lit(1)))
    text = F.coalesce("text", F.lit(""))
    markdown = (
        F.when(kind == "title", F.concat(F.lit("# "), text))
        .when(kind == "heading", F.concat(F.repeat(F.lit("#"), F.least(level, F.lit(6))), F.lit(" "), text))
        .when(kind == "list_item", F.concat(F.coalesce("marker", F.lit("-")), F.lit(" "), text))
        .when((kind == "formula") & ~text.startswith("$"), F.concat(F.lit("$$\n"), text, F.lit("\n$$")))
        .otherwise(text)
    )
    b = F.col("bbox")
    flipped = F.when(b.isNotNull(), F.struct(b["left"].alias("left"), (b["page_height"] - b["top"]).alias("top"), b["right"].alias("right"), (b["page_height"] - b["bottom"]).alias("bottom"), b["page_width"].alias("page_width"), b["page_height"].alias("page_height")))
    rows = items.withColumns({"kind": kind, "heading_level": level, "markdown": markdown, "bbox": flipped, "block_id": ids.block_id(F.col("pos"))})
    rows = rows.withColumn("text", F.coalesce(F.nullif(text, F.lit("")), F.col("markdown")))
    if "metadata" not in rows.columns:
        rows = rows.withColumn("metadata", F.from_json(F.lit("{}"), schemas.METADATA))
    return completed(rows.withColumn("metadata", F.col("metadata").withField("label", F.col("label"))))


def dispatch(files: DataFrame) -> DataFrame:
    """Adds the format of each file by its suffix, and parse_error where there is none."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./\\]+)$", 1))
    return files.withColumns({"format": X.lookup(suffix, {".pdf": "pdf", ".md": "markdown", ".txt": "text"}), "parse_error": F.when(~suffix.isin(*C.UPLOAD_SUFFIXES), "UNSUPPORTED_FILE")})


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of the .txt and .md files of a folder; doc_id is the hash of the path."""
    files = dispatch(spark.read.format("binaryFile").load(path).select("path", "content"))
    rows = files.select(F.xxhash64("path").alias("doc_id"), "format", F.decode("content", "UTF-8").alias("text"))
    return text_blocks(rows.where("format = 'text'")).unionByName(markdown_blocks(rows.where("format = 'markdown'")))


def read_ir(spark: SparkSession, path: str) -> DataFrame:
    """Documents written by ``ir_json``; any other version is an error."""
    rows = spark.read.schema(schemas.IR_DOCUMENT).json(path)
    checked = F.when(F.col("version") == schemas.IR_VERSION, F.col("version")).otherwise(F.raise_error(F.concat(F.lit("unsupported version "), F.coalesce("version", F.lit("null")))).cast("string"))
    return rows.withColumn("version", checked)


def ir_blocks(documents: DataFrame) -> DataFrame:
    """Blocks of documents, with the path of their section."""
    # Explode lets Spark filter documents by their blocks first, so that a document made by
    # from_json is parsed once more for each condition; the outer one has no such filter.
    b = documents.select(F.col("docId").alias("doc_id"), "sections", F.posexplode_outer("blocks").alias("nth", "b")).where("nth is not null")
    section = F.get(F.filter("sections", lambda s: s["sectionId"] == F.col("b.sectionId")), F.lit(0))
    meta = F.from_json(F.lit("{}"), schemas.METADATA).withField("section_path", section["path"])
    return completed(b.select("doc_id", F.col("b.order").alias("pos"), F.col("b.blockId").alias("block_id"), "b.kind", "b.text", "b.markdown", F.col("b.pageNo").alias("page_no"), F.col("b.headingLevel").alias("heading_level"), meta.alias("metadata")))


def _ir_block() -> Column:
    return F.struct(F.col("block_id").alias("blockId"), "kind", "text", "markdown", F.col("pos").alias("order"), F.col("page_no").alias("pageNo"), F.col("heading_level").alias("headingLevel"), F.col("section_id").alias("sectionId"))


def _ir_value(blocks: Column) -> Column:
    return F.to_json(F.struct(F.lit(schemas.IR_VERSION).alias("version"), F.col("doc_id").alias("docId"), "sections", F.transform(blocks, lambda x: x["b"]).alias("blocks")))


def ir_json(blocks: DataFrame, section_rows: DataFrame) -> DataFrame:
    """One JSON document a row (doc_id, value), of blocks that carry section_id."""
    listed = blocks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", _ir_block().alias("b")))).alias("bs"))
    s = section_rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(F.col("section_id").alias("sectionId"), "title", "level", "path"))).alias("sections"))
    return listed.join(s, "doc_id", "left").select("doc_id", _ir_value(F.col("bs")).alias("value"))


def sectioned_json(blocks: DataFrame) -> DataFrame:
    """Documents as ``ir_json`` gives them, of blocks that ``sections`` has given ids: the
    sections are those of the headings, so blocks are made and gathered once."""
    section = F.struct(F.col("section_id").alias("sectionId"), X.strip(F.col("text")).alias("title"), F.col("section_level").alias("level"), F.col("section_path").alias("path"))
    both = F.struct("pos", _ir_block().alias("b"), F.when(F.col("kind").isin("title", "heading"), section).alias("s"))
    listed = blocks.groupBy("doc_id").agg(F.sort_array(F.collect_list(both)).alias("bs"))
    found = F.sort_array(F.transform(F.filter("bs", lambda x: x["s"].isNotNull()), lambda x: x["s"]))
    listed = listed.withColumn("sections", F.when(F.size(found) > 0, found))
    return listed.select("doc_id", _ir_value(F.col("bs")).alias("value"))


def write_ir(documents: DataFrame, path: str, most: int = 20_000) -> None:
    """Writes documents (doc_id, value) as ``read_ir`` reads them: one a line, ``most`` in a
    file, so that files are as many as tasks need and not as documents."""
    documents.select("value").write.mode("overwrite").option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


def read_replay(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.REPLAY).json(path).where("recordType is not null")
