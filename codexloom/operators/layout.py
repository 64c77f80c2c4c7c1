"""Reading order: furniture, columns and risk tags of positioned blocks.

Blocks have doc_id, pos, kind, text, page_no, bbox, risks and metadata.  Everything is
windows by document or page; a document's blocks are the largest group of a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as C
from ..functions import text as X


def _at_edge() -> Column:
    b = F.col("bbox")
    inside = (b["top"] <= 0.1 * b["page_height"]) | (b["bottom"] >= 0.9 * b["page_height"])
    return F.coalesce((b["page_height"] > 0) & inside, F.lit(False))


def remove_furniture(blocks: DataFrame) -> DataFrame:
    """Without labelled headers and footers, and without texts at page edges that are on
    at least half of the pages (two at least), counted as different pages."""
    rows = blocks.withColumns({"lx_edge": _at_edge() & F.col("page_no").isNotNull(), "lx_norm": X.normal_form(F.col("text"))})
    pages = rows.groupBy("doc_id").agg(F.countDistinct("page_no").alias("pages"))
    seen = rows.where("lx_edge and lx_norm <> ''").groupBy("doc_id", "lx_norm").agg(F.countDistinct("page_no").alias("on"))
    repeated = seen.join(pages, "doc_id").where(F.col("on") >= F.greatest(F.lit(2), F.floor((F.col("pages") + 1) / 2)))
    repeated = repeated.select("doc_id", "lx_norm", F.lit(True).alias("lx_edge"))
    rows = rows.where(~F.coalesce(F.col("metadata.label").isin(*C.FURNITURE_LABELS), F.lit(False)))
    return rows.join(repeated, ["doc_id", "lx_norm", "lx_edge"], "left_anti").select(blocks.columns)


def column_side(bbox: Column) -> Column:
    """left, right, or null for wide and centred blocks."""
    centre = (bbox["left"] + bbox["right"]) / 2
    width = bbox["right"] - bbox["left"]
    side = F.when(centre < 0.48 * bbox["page_width"], F.lit("left")).when(centre > 0.52 * bbox["page_width"], F.lit("right"))
    return F.when((bbox["page_width"] > 0) & (width <= 0.6 * bbox["page_width"]), side)


def two_column_pages(blocks: DataFrame) -> DataFrame:
    """Pages with both sides present and their vertical ranges overlapping."""
    side = column_side(F.col("bbox"))
    span = {f"{s}_{n}": f(F.when(side == s, F.col(f"bbox.{c}"))) for s in ("left", "right") for n, f, c in (("top", F.min, "top"), ("bottom", F.max, "bottom"))}
    ranges = blocks.where(F.col("page_no").isNotNull()).groupBy("doc_id", "page_no").agg(*(c.alias(n) for n, c in span.items()))
    overlap = F.least("left_bottom", "right_bottom") > F.greatest("left_top", "right_top")
    both = F.col("left_top").isNotNull() & F.col("right_top").isNotNull()
    return ranges.select("doc_id", "page_no", F.coalesce(both & overlap, F.lit(False)).alias("two_columns"))


def reading_order(blocks: DataFrame) -> DataFrame:
    """Blocks with ``pos`` renumbered and ``metadata.layout_adjusted`` set.

    Blocks without a page come first; on two-column pages, full-width blocks cut the
    page into segments, each read left column first."""
    page = Window.partitionBy("doc_id", "page_no")
    side = column_side(F.col("bbox"))
    b = F.col("bbox")
    rows = blocks.withColumns({"lx_side": side, "lx_top": F.coalesce(b["top"], F.lit(float("inf"))), "lx_left": F.coalesce(b["left"], F.lit(float("inf")))})
    edge = lambda f, s, c: f(F.when(F.col("lx_side") == s, F.col(f"bbox.{c}"))).over(page)
    least = F.least(edge(F.max, "left", "bottom"), edge(F.max, "right", "bottom"))
    most = F.greatest(edge(F.min, "left", "top"), edge(F.min, "right", "top"))
    sides = F.max((F.col("lx_side") == "left").cast("int")).over(page) + F.max((F.col("lx_side") == "right").cast("int")).over(page)
    rows = rows.withColumn("lx_two", F.col("page_no").isNotNull() & F.coalesce((sides == 2) & (least > most), F.lit(False)))
    placed = F.col("bbox").isNotNull()
    down = page.orderBy("lx_top", "lx_left", "pos").rowsBetween(Window.unboundedPreceding, 0)
    cut = (placed & F.col("lx_side").isNull()).cast("int")
    rows = rows.withColumn("lx_cut", cut).withColumn("lx_segment", 2 * F.sum("lx_cut").over(down) - F.col("lx_cut"))
    segment = Window.partitionBy("doc_id", "page_no", "lx_segment")
    has = lambda s: F.max((F.col("lx_side") == s).cast("int")).over(segment)
    rows = rows.withColumn("lx_moved", F.coalesce(F.col("lx_two") & F.col("lx_side").isNotNull() & (has("left") + has("right") == 2), F.lit(False)))
    rank = F.when(F.col("lx_side") == "right", 1).otherwise(0)
    two = lambda c: F.when(F.col("lx_two"), c)
    paged = lambda c: F.when(F.col("page_no").isNotNull(), c)
    order = Window.partitionBy("doc_id").orderBy(
        F.col("page_no").isNotNull(), "page_no", paged((~placed).cast("int")), two(F.col("lx_segment")), two(rank), paged(F.col("lx_top")), paged(F.col("lx_left")), "pos"
    )
    out = rows.withColumn("lx_pos", F.row_number().over(order) - 1)
    adjusted = F.col("metadata").withField("layout_adjusted", F.col("lx_moved") | F.coalesce(F.col("metadata.layout_adjusted"), F.lit(False)))
    return out.select(*(F.col("lx_pos").cast("int").alias("pos") if c == "pos" else adjusted.alias("metadata") if c == "metadata" else F.col(c) for c in blocks.columns))


def block_risks(kind: Column, text: Column, adjusted: Column) -> Column:
    """Risk tags of one block, in fixed order."""
    tests = {
        "TABLE": kind == "table",
        "FORMULA": (kind == "formula") | X.contains_formula(text),
        "REFERENCE": (kind == "reference") | X.dense_references(text),
        "LONG_PARAGRAPH": (kind == "paragraph") & (F.length(text) > C.LONG_PARAGRAPH),
        "STRUCTURE": F.coalesce(adjusted, F.lit(False)),
    }
    one = lambda k: F.struct(F.lit(k).alias("risk_type"), F.lit(C.RISK_MESSAGES[k]).alias("message"))
    return F.array_compact(F.array(*(F.when(test, one(k)) for k, test in tests.items())))


def mark_risks(blocks: DataFrame) -> DataFrame:
    tags = block_risks(F.col("kind"), F.col("text"), F.col("metadata.layout_adjusted"))
    return blocks.withColumn("risks", F.array_distinct(F.concat(F.coalesce("risks", F.array().cast("array<struct<risk_type:string,message:string>>")), tags)))


def normalize(blocks: DataFrame) -> DataFrame:
    """Furniture out, reading order fixed, blocks numbered and tagged."""
    return blocks.transform(remove_furniture).transform(reading_order).transform(mark_risks)
