"""Packing of blocks into chunks of bounded token counts.

The fold over a document's blocks carries two integers, not text: separators are white
space, which the token estimate doesn't count, so (ideographs, other characters) add
up.  Documents are dealt out once and sorted inside their partition, and one pass gives
each piece its draft, the reason for which that closed, and its chunk; it holds the
pieces of the open draft or chunk only, whatever the length of the document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed as C
from ..functions import ids
from ..functions import text as X
from ..runtime import saved
from .structure import is_separator_row, referenced_captions, sections


def sentences(text: Column) -> Column:
    """Sentences of a text without formulas or citations (see ``split_sentences``)."""
    parts = F.split(text, C.SENTENCE_BREAK)
    return F.filter(F.transform(parts, X.strip), lambda s: s != "")


def split_sentences(text: Column) -> Column:
    """Sentences, with formulas and citations kept whole.

    Each protected span stands as one noncharacter while the text is cut; the sentences,
    joined by another one, take all their spans back at once, by their order."""
    mark, between = "\ufdd0", "\ufdd1"

    def cut(spans: Column) -> Column:
        found = sentences(F.regexp_replace(text, C.PROTECTED, mark))

        def restore(cuts: Column) -> Column:
            pieces = F.transform(F.split(F.array_join(cuts, between), mark), lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.get(spans, i - 1), p)))
            return F.when(F.size(cuts) == 0, cuts).otherwise(F.split(F.array_join(pieces, ""), between))

        return X.let(found, restore)

    return X.let(F.regexp_extract_all(text, F.lit(C.PROTECTED), F.lit(0)), cut)


def greedy_cuts(counts: Column, limit: int, most: int | None = None, base_cjk: Column | None = None, base_other: Column | None = None) -> Column:
    """Where groups of (cjk, other) items begin: a group closes before the item with which it
    would exceed ``limit`` tokens (with the base) or ``most`` items.  The fold carries the
    begins only, which grow with a group and not with an item."""
    zero = F.lit(0).cast("int")
    bc, bo = (base_cjk if base_cjk is not None else zero).cast("int"), (base_other if base_other is not None else zero).cast("int")
    begin = F.struct(zero.alias("at"), zero.alias("n"), zero.alias("cjk"), zero.alias("other"), F.array(zero).alias("begins"))

    def step(done: Column, item: Column) -> Column:
        cjk, other = done["cjk"] + item["cjk"], done["other"] + item["other"]
        full = X.tokens_of(bc + cjk, bo + other) > limit
        if most is not None:
            full = full | (done["n"] >= most)
        close = full & (done["n"] > 0)
        keep = lambda old, new: F.when(close, new).otherwise(old + new).cast("int")
        begins = F.when(close, F.concat(done["begins"], F.array(done["at"]))).otherwise(done["begins"])
        return F.struct((done["at"] + 1).cast("int").alias("at"), keep(done["n"], F.lit(1)).alias("n"), keep(done["cjk"], item["cjk"]).alias("cjk"), keep(done["other"], item["other"]).alias("other"), begins.alias("begins"))

    return F.aggregate(counts, begin, step, lambda done: done["begins"])


def _groups(items: Column, begins: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` of the items of each group and its number."""
    return F.transform(begins, lambda at, g: body(F.slice(items, at + 1, F.coalesce(F.get(begins, g + 1), F.size(items)) - at), g))


def _counts(text: Column) -> Column:
    return F.struct(X.cjk_chars(text).cast("int").alias("cjk"), X.other_chars(text).cast("int").alias("other"))


def split_blocks(blocks: DataFrame, hard: int = C.HARD_TOKENS) -> DataFrame:
    """Adds ``piece_id``, ``source_id`` and the counts ``cjk`` and ``other``; text blocks over the
    hard limit become several rows of whole sentences.  Other blocks are passed through."""
    text = F.col("markdown")
    rows = blocks.withColumns({"cx_c": X.cjk_chars(text).cast("int"), "cx_o": X.other_chars(text).cast("int")})
    big = (X.tokens_of(F.col("cx_c"), F.col("cx_o")) > hard) & F.col("kind").isin("paragraph", "list_item", "reference", "caption", "other")
    rows = rows.withColumn("cx_s", F.when(big, split_sentences(text)))
    rows = rows.withColumn("cx_g", F.when(F.size("cx_s") > 1, greedy_cuts(F.transform("cx_s", _counts), hard)))
    several = F.col("cx_g").isNotNull()
    grouped = _groups(F.col("cx_s"), F.col("cx_g"), lambda some, _: X.join_sentences(some))
    parts = rows.select(*blocks.columns, "cx_c", "cx_o", several.alias("cx_cut"), F.posexplode(F.when(several, grouped).otherwise(F.array("markdown"))).alias("piece", "cx_text"))
    of = lambda cut, whole: F.when(F.col("cx_cut"), cut).otherwise(whole)
    piece = F.col("cx_text")
    body = {"text": of(piece, F.col("text")), "source_id": F.col("block_id"), "piece_id": of(F.concat("block_id", F.lit("_part_"), "piece"), F.col("block_id"))}
    counts = {"cjk": of(X.cjk_chars(piece).cast("int"), F.col("cx_c")), "other": of(X.other_chars(piece).cast("int"), F.col("cx_o"))}
    return parts.withColumns({**body, **counts, "markdown": piece}).drop("cx_c", "cx_o", "cx_cut", "cx_text")


def _tokens(cjk: int, other: int) -> int:
    """``X.tokens_of`` of two numbers."""
    return max(1, cjk - -other // 4)


Step = Callable[[tuple], list[tuple]]
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}


def folded(rows: DataFrame, order: list[str], make: Callable[[], tuple[Step, Callable[[], list[tuple]]]], fields: str) -> DataFrame:
    """One pass over the rows of each doc_id in order: ``make`` gives a step, called with the
    values of a row, and an end; both return rows without doc_id, of ``fields``."""
    key = rows.schema["doc_id"]
    schema = T.StructType([key, *T.StructType.fromDDL(fields).fields])
    names = [c for c in rows.columns if c != "doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None
        doc, step, end, begun = None, None, None, False
        for batch in batches:
            if kinds is None:
                kinds = [batch.schema.field("doc_id").type, *(_ARROW[f.dataType.simpleString()] for f in schema.fields[1:])]
            docs, out = batch.column("doc_id").to_pylist(), []
            for now, values in zip(docs, zip(*(batch.column(c).to_pylist() for c in names), strict=True), strict=True):
                if not begun or now != doc:
                    if begun:
                        out += [(doc, *r) for r in end()]
                    (step, end), doc, begun = make(), now, True
                out += [(doc, *r) for r in step(values)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=schema.names)
        last = [(doc, *r) for r in end()] if begun else []
        if last:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*last, strict=True), kinds, strict=True)], names=schema.names)

    return rows.repartition("doc_id").sortWithinPartitions("doc_id", *order).mapInArrow(run, schema)


def _merger(soft: int, least: int) -> Callable[[bool, str, int, int], int]:
    """Chunk number of each draft in turn (text or not, section, counts)."""
    n, was_text, was_in, cjk, other = -1, False, None, 0, 0

    def place(is_text: bool, section: str, c: int, o: int) -> int:
        nonlocal n, was_text, was_in, cjk, other
        own = _tokens(c, o)
        if n >= 0 and is_text and was_text and section == was_in and own < least and own + _tokens(cjk, other) <= soft:
            cjk, other = cjk + c, other + o
        else:
            n, cjk, other = n + 1, c, o
        was_text, was_in = is_text, section
        return n

    return place


def _drafter(soft: int, hard: int, least: int) -> tuple[Callable[..., list[tuple]], Callable[[str], list[tuple]]]:
    """A step for each piece (role, section, counts, decision and a row to be kept) and a close
    with a reason; both return the drafts that closed: number, reason, chunk and rows."""
    place = _merger(soft, least)
    draft, cjk, other = -1, 0, 0
    held: list[tuple] = []  # of the open draft: role, section, cjk, other, row

    def close(why: str) -> list[tuple]:
        nonlocal held
        if not held:
            return []
        atomic = any(r[0] == "A" for r in held)
        chunk = place(not atomic, held[0][1], sum(r[2] for r in held), sum(r[3] for r in held))
        out = [(draft, "ATOMIC_BLOCK" if atomic else why, chunk, [r[4] for r in held])]
        held = []
        return out

    def step(role: str, section: object, c: int, o: int, decision: str | None, row: tuple) -> list[tuple]:
        nonlocal draft, cjk, other
        why = None
        if held:
            now, then = _tokens(cjk, other), _tokens(cjk + c, other + o)
            if role == "H":
                why = "SECTION_BOUNDARY"
            elif role == "A":
                why = "ATOMIC_BLOCK"
            elif then > hard:
                why = "TOKEN_HARD_LIMIT"
            elif decision == "SPLIT" and now >= least:
                why = "LLM_SEMANTIC_SPLIT"
            elif then > soft and decision != "CONTINUE":
                why = "TOKEN_SOFT_LIMIT"
        out = close(why) if why else []
        if not held:
            draft, cjk, other = draft + 1, 0, 0
        held.append((role, section, c, o, row))
        cjk, other = cjk + c, other + o
        return out + close("") if role == "A" else out

    return step, close


def _role() -> Column:
    return F.when(F.col("kind").isin("title", "heading"), "H").when(F.col("kind").isin("table", *C.ATOMIC_KINDS), "A").otherwise("T")


def pack(pieces: DataFrame, soft: int = C.SOFT_TOKENS, hard: int = C.HARD_TOKENS, least: int = C.LEAST_TOKENS) -> DataFrame:
    """(doc_id, draft, pos, piece, role, reason, chunk_index) of each piece.

    Pieces have doc_id, pos, piece, kind, cjk, other, decision (of the boundary before
    them, or null) and, for drafts to be merged, section (a comparable path).  Headings
    close the draft before; atomic kinds stand alone; small text drafts join the chunk
    before in the same section."""
    section = F.col("section") if "section" in pieces.columns else F.lit(None).cast("string")

    def make() -> tuple[Step, Callable[[], list[tuple]]]:
        step, close = _drafter(soft, hard, least)
        spread = lambda drafts: [(draft, *row, why, chunk) for draft, why, chunk, rows in drafts for row in rows]
        return lambda v: spread(step(v[2], v[6], v[3], v[4], v[5], v[:3])), lambda: spread(close("END_OF_DOCUMENT"))

    rows = pieces.select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("piece").cast("int").alias("piece"), _role().alias("role"), "cjk", "other", "decision", section.alias("section"))
    return folded(rows, ["pos", "piece"], make, "draft int, pos long, piece int, role string, reason string, chunk_index int")


def merge_small(drafts: DataFrame, soft: int = C.SOFT_TOKENS, least: int = C.LEAST_TOKENS) -> DataFrame:
    """(doc_id, draft, chunk_index): small text drafts join the one before in the same section.

    Drafts have doc_id, draft, is_text, section (a comparable path), cjk and other."""

    def make() -> tuple[Step, Callable[[], list[tuple]]]:
        place = _merger(soft, least)
        return lambda v: [(v[0], place(*v[1:]))], list

    rows = drafts.select("doc_id", F.col("draft").cast("long").alias("draft"), "is_text", "section", "cjk", "other")
    return folded(rows, ["draft"], make, "draft long, chunk_index int")


def _packed_texts(pieces: DataFrame, soft: int, hard: int, least: int) -> DataFrame:
    """Chunks of pieces that are packed as by ``pack``, in the same pass: it holds the texts of
    one chunk.  ``bodies`` are the texts of a block that stands alone (a table's groups);
    those that are blank make no chunk."""

    def make() -> tuple[Step, Callable[[], list[tuple]]]:
        step, close = _drafter(soft, hard, least)
        n, at = 0, None
        drafts: list[list[tuple]] = []  # of the open chunk
        why = ""

        def emit() -> list[tuple]:
            nonlocal n, drafts
            rows = [r for d in drafts for r in d]
            if not rows:
                return []
            path, kind, _, bodies, _, _, caption, contact = rows[0]
            if bodies is None:
                bodies = ["\n\n".join("\n\n".join(r[2] for r in d if r[2]) for d in drafts)]
            sources = [*([caption] if caption is not None else []), *dict.fromkeys(r[4] for r in rows)]
            pages = sorted({r[5] for r in rows if r[5] is not None})
            out = []
            for group, body in enumerate(bodies):
                if body.strip(C.BLANKS):
                    out.append((n, kind, path, body, sources, "TABLE_GROUP" if len(bodies) > 1 else why, pages, group, contact))
                    n += 1
            drafts = []
            return out

        def chunks(closed: list[tuple]) -> list[tuple]:
            nonlocal at, why
            out = []
            for _, reason, chunk, rows in closed:
                if chunk != at:
                    out += emit()
                drafts.append(rows)
                at, why = chunk, reason
            return out

        def end() -> list[tuple]:
            out = chunks(close("END_OF_DOCUMENT"))
            return out + emit()

        return lambda v: chunks(step(v[2], v[6], v[3], v[4], v[5], v[6:])), end

    fields = "chunk_index int, kind string, section_path array<string>, source_text string, block_ids array<string>, boundary_reason string, pages array<int>, table_group int, contact boolean"
    return folded(pieces, ["pos", "piece"], make, fields)


def _captioned(blocks: DataFrame) -> DataFrame:
    """Blocks with ``caption_id`` and ``caption``, without the captions that became those: the
    one right before a table or picture, else the one a block refers to."""
    texts = blocks.where("kind = 'caption'").select("doc_id", F.col("block_id").alias("caption_id"), F.trim("markdown").alias("caption"))
    refs = referenced_captions(blocks).join(texts, ["doc_id", "caption_id"]).select("doc_id", "block_id", F.struct("caption_id", "caption").alias("cp_ref"), F.lit(False).alias("cp_used"))
    gone = refs.select("doc_id", F.col("cp_ref.caption_id").alias("block_id"), F.lit(None).cast(refs.schema["cp_ref"].dataType).alias("cp_ref"), F.lit(True).alias("cp_used"))
    # Stored, so that the join knows how little there is.
    marks = saved(refs.unionByName(gone).groupBy("doc_id", "block_id").agg(F.max("cp_ref").alias("cp_ref"), F.max("cp_used").alias("cp_used")))
    rows = blocks.join(marks, ["doc_id", "block_id"], "left").withColumn("cp_used", F.coalesce("cp_used", F.lit(False)))
    order = Window.partitionBy("doc_id").orderBy("pos")
    shown = F.col("kind").isin("table", "picture")
    free = (F.col("kind") == "caption") & ~F.col("cp_used")
    before = F.lag(F.when(free, F.struct(F.col("block_id").alias("caption_id"), F.trim("markdown").alias("caption")))).over(order)
    rows = rows.withColumns({"cp_before": before, "cp_next": F.coalesce(F.lead(shown).over(order), F.lit(False))})
    rows = rows.where(~(free & F.col("cp_next")) & ~F.col("cp_used")).withColumn("cp_own", F.coalesce(F.when(shown, F.col("cp_before")), "cp_ref"))
    return rows.withColumns({"caption_id": F.col("cp_own.caption_id"), "caption": F.col("cp_own.caption")}).drop("cp_used", "cp_before", "cp_next", "cp_ref", "cp_own")


def build_chunks(blocks: DataFrame, decisions: DataFrame | None = None, soft: int = C.SOFT_TOKENS, hard: int = C.HARD_TOKENS, least: int = C.LEAST_TOKENS, rows_per_table: int = C.TABLE_ROWS) -> DataFrame:
    """Chunks of documents: doc_id, chunk_index, chunk_type, section_path, source_text,
    block_ids, boundary_reason, tokens, pages, table_group and protected.

    ``decisions`` has doc_id, right_id and decision; they hold for whole blocks only."""
    pieces = split_blocks(_captioned(sections(blocks)), hard)
    if decisions is None:
        pieces = pieces.withColumn("decision", F.lit(None).cast("string"))
    else:
        pieces = pieces.join(decisions.select("doc_id", F.col("right_id").alias("piece_id"), "decision"), ["doc_id", "piece_id"], "left")
    kind, text, caption = F.col("kind"), F.col("cx_text"), F.col("caption")
    pieces = pieces.withColumn("cx_text", X.strip(F.coalesce("markdown", F.lit(""))))
    with_caption = F.when(caption.isNotNull() & (caption != ""), F.concat(caption, F.lit("\n\n"), text)).otherwise(text)
    bodies = F.when(kind == "table", table_groups(text, caption, hard, rows_per_table)).when(kind.isin(*C.ATOMIC_KINDS), F.array(with_caption))
    contact = (kind == "table") & (F.coalesce("page_no", F.lit(1)) == 1) & (X.distinct_emails(text) >= 2)
    rows = pieces.select(
        "doc_id", F.col("pos").cast("long").alias("pos"), F.col("piece").cast("int").alias("piece"), _role().alias("role"), "cjk", "other", "decision", "section_path", "kind", F.when(~kind.isin("table", *C.ATOMIC_KINDS), text).alias("text"), bodies.alias("bodies"), "source_id", "page_no", "caption_id", contact.alias("contact")
    )
    return _finished(_packed_texts(rows, soft, hard, least))


def table_groups(markdown: Column, caption: Column, hard: int = C.HARD_TOKENS, rows_per_table: int = C.TABLE_ROWS) -> Column:
    """Texts that a table is cut into: the header in each, the caption marked from the
    second on.  Sizing charges that mark to the first group, too."""
    lines = F.filter(F.split(markdown, "\r?\n"), lambda x: X.strip(x) != "")
    caption = F.coalesce(caption, F.lit(""))

    def render(head: Column, body: Column, name: Column) -> Column:
        return F.concat(F.when(name != "", F.concat(name, F.lit("\n\n"))).otherwise(F.lit("")), F.array_join(F.concat(head, body), "\n"))

    def cut(ls: Column) -> Column:
        head, rows = F.slice(ls, 1, 2), F.slice(ls, F.lit(3), F.greatest(F.lit(0), F.size(ls) - 2))
        whole = render(head, rows, caption)
        fits = lambda text: (F.size(rows) <= rows_per_table) & (X.estimate_tokens(text) <= hard)
        sized = F.concat(F.when(caption != "", F.concat(caption, F.lit(" (continued)"))).otherwise(F.lit("")), F.array_join(head, ""))
        begins = greedy_cuts(F.transform(rows, _counts), hard, rows_per_table, X.cjk_chars(sized), X.other_chars(sized))
        named = lambda g: F.when((caption != "") & (g > 0), F.concat(caption, F.lit(" (continued)"))).otherwise(caption)
        several = X.let(F.struct(rows.alias("rows"), begins.alias("begins")), lambda x: _groups(x["rows"], x["begins"], lambda some, g: render(head, some, named(g))))
        plain = F.concat(F.when(caption != "", F.concat(caption, F.lit("\n\n"))).otherwise(F.lit("")), X.strip(markdown))
        table = (F.size(ls) >= 2) & is_separator_row(F.get(ls, F.lit(1)))
        return F.when(~F.coalesce(table, F.lit(False)), F.array(plain)).otherwise(X.let(whole, lambda text: F.when(fits(text), F.array(text)).otherwise(several)))

    return X.let(lines, cut)


def _finished(made: DataFrame) -> DataFrame:
    kind = F.col("kind")
    chunk_type = F.when(kind == "table", "TABLE").when(kind.isin(*C.ATOMIC_KINDS), F.upper(kind)).otherwise("TEXT")
    return made.select(
        "doc_id", "chunk_index", chunk_type.alias("chunk_type"), "section_path", "source_text", "block_ids", "boundary_reason", X.estimate_tokens(F.col("source_text")).alias("tokens"), "pages", "table_group", (kind.isin(*C.ATOMIC_KINDS) | F.col("contact")).alias("protected")
    )


def chunk_ids(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("chunk_id", ids.name_uuid("chunk", F.col("doc_id"), F.col("chunk_index")))


def chunk_risks(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """Risk rows of chunks: those of their blocks, once each by type and message, in the order
    of the blocks; a table always carries its own."""
    of = chunks.select("doc_id", "chunk_index", F.posexplode("block_ids").alias("at", "block_id"))
    own = blocks.select("doc_id", "block_id", F.posexplode("risks").alias("nth", "r")).select("doc_id", "block_id", "nth", "r.risk_type", "r.message")
    found = of.join(own, ["doc_id", "block_id"]).select("doc_id", "chunk_index", "at", "nth", "risk_type", "message")
    table = chunks.where("chunk_type = 'TABLE'").select("doc_id", "chunk_index", F.lit(1 << 30).alias("at"), F.lit(0).alias("nth"), F.lit("TABLE").alias("risk_type"), F.lit(C.RISK_MESSAGES["TABLE"]).alias("message"))
    rows = found.unionByName(table).groupBy("doc_id", "chunk_index", "risk_type", "message").agg(F.min(F.struct("at", "nth")).alias("first"))
    return rows.withColumn("risk_id", ids.name_uuid("risk", F.col("doc_id"), F.col("chunk_index"), F.col("risk_type"), F.col("message")))


def risk_summaries(risks: DataFrame) -> DataFrame:
    """Messages of each chunk's risks, in their order (rows of ``chunk_risks``)."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("first", "message"))), lambda r: r["message"])
    return risks.groupBy("doc_id", "chunk_index").agg(F.array_join(F.array_distinct(listed), "；").alias("risk_summary"))


def locations(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """Sorted pages of each chunk, and (block, page, box) of its blocks in their order."""
    of = chunks.select("doc_id", "chunk_index", F.posexplode("block_ids").alias("at", "block_id"))
    rows = of.join(blocks.select("doc_id", "block_id", "page_no", "bbox"), ["doc_id", "block_id"])
    place = F.struct("at", F.struct("block_id", "page_no", "bbox").alias("place"))
    listed = F.transform(F.array_sort(F.collect_list(place)), lambda x: x["place"])
    return rows.groupBy("doc_id", "chunk_index").agg(F.sort_array(F.collect_set("page_no")).alias("pages"), listed.alias("places"))


def upsert_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Outcome by (job_id, chunk_index): INSERT, UPDATE, DELETE, or REJECT where a chunk that
    is no longer PENDING would change.  The rows of a job with a REJECT must not be applied."""
    o, n = old.alias("o"), new.alias("n")
    rows = o.join(n, F.expr("o.job_id = n.job_id and o.chunk_index = n.chunk_index"), "full_outer")
    action = F.when(F.col("o.job_id").isNull(), "INSERT").when(F.col("o.status") != "PENDING", "REJECT").when(F.col("n.job_id").isNull(), "DELETE").otherwise("UPDATE")
    return rows.select(F.coalesce("o.job_id", "n.job_id").alias("job_id"), F.coalesce("o.chunk_index", "n.chunk_index").alias("chunk_index"), action.alias("action"), F.coalesce("n.source_text", "o.source_text").alias("source_text"))


def pack_lines(lines: DataFrame, limit: int) -> DataFrame:
    """Chunks of plain lines: doc_id, chunk_index, n_lines, tokens.  A line that would lift a
    chunk over ``limit`` tokens begins the next one."""

    def make() -> tuple[Step, Callable[[], list[tuple]]]:
        chunk, n, cjk, other = 0, 0, 0, 0

        def step(values: tuple) -> list[tuple]:
            nonlocal chunk, n, cjk, other
            _, c, o = values
            out = []
            if n and _tokens(cjk + c, other + o) > limit:
                out = [(chunk, n, _tokens(cjk, other))]
                chunk, n, cjk, other = chunk + 1, 0, 0, 0
            n, cjk, other = n + 1, cjk + c, other + o
            return out

        return step, lambda: [(chunk, n, _tokens(cjk, other))]

    rows = lines.select("doc_id", "pos", X.cjk_chars(F.col("text")).cast("int").alias("cjk"), X.other_chars(F.col("text")).cast("int").alias("other"))
    return folded(rows, ["pos"], make, "chunk_index int, n_lines long, tokens int")
