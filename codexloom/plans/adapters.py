"""Tables of the document model made from the test tables, so that every rule has rows.

Each adapter has a DataFrame form and the same construction as a DuckDB table expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import ids
from ..sources.text import completed, line_blocks

NOW = "1997-06-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as blocks, one line a page."""
    return line_blocks(documents(spark, sf_dir))


LINES = "(select doc_id, pos - 1 pos, x as text from (select doc_id, unnest(string_split(text, chr(10))) x, generate_subscripts(string_split(text, chr(10)), 1) pos from documents) where regexp_replace(x, '^\\s+|\\s+$', '', 'g') <> '')"


def cut_lines(spark: SparkSession, sf_dir: str, width: int = 60) -> DataFrame:
    """Lines cut every 60 characters, with a hyphen where that parts a word; a piece a page."""
    rows = lines(spark, sf_dir).select("doc_id", F.col("pos").alias("line"), "text")
    n = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / width).cast("int"))
    rows = rows.select("doc_id", "line", "text", F.explode(n).alias("k"))
    piece, after = F.substring("text", F.col("k") * width + 1, F.lit(width)), F.substring("text", F.col("k") * width + width + 1, F.lit(1))
    hyphen = F.when(piece.rlike("[A-Za-z]$") & after.rlike("^[A-Za-z]"), "-").otherwise("")
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("line", "k")) - 1
    rows = rows.select("doc_id", pos.alias("pos"), F.concat(piece, hyphen).alias("text"), "k")
    return completed(rows.withColumns({"kind": F.lit("paragraph"), "markdown": F.col("text"), "block_id": ids.block_id(F.col("pos")), "page_no": F.col("k")}))


CUT_LINES = f"""(select doc_id, n pos, k page_no, 'block_' || lpad(cast(n as varchar), cast(greatest(6, length(cast(n as varchar))) as int), '0') block_id,
  p || case when regexp_matches(p, '[A-Za-z]$') and regexp_matches(a, '^[A-Za-z]') then '-' else '' end as text
  from (select doc_id, row_number() over (partition by doc_id order by pos, k) - 1 n, k, substr(text, k * 60 + 1, 60) p, substr(text, k * 60 + 61, 1) a from (select doc_id, pos, text, unnest(generate_series(0, cast(floor((length(text) - 1) / 60) as bigint))) k from {LINES})))"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*(F.lit(s) for s in ("STARTED", "COMPLETED", "FAILED", "INTERRUPTED"))), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("event_seq"), F.col("user_id").alias("job_id"), F.col("event_type").alias("node"), F.lit("node").alias("event_type"), status.alias("status"), F.col("value").alias("elapsed_ms"), F.col("ts").alias("created_at")
    )


EVENTS = "(select event_id event_seq, user_id job_id, event_type node, case event_id % 4 when 0 then 'STARTED' when 1 then 'COMPLETED' when 2 then 'FAILED' else 'INTERRUPTED' end status, value elapsed_ms, ts created_at from events)"

_STATUS = ["UPLOADED", "PARSED", "WAITING_TERM_REVIEW", "WAITING_STYLE_REVIEW", "WAITING_RISK_REVIEW", "WAITING_CHAPTER_REVIEW", "TRANSLATING", "COMPLETED", "FAILED", "CANCELLED"]
_STAGE = ["parse_document", "split_sections", "extract_terms", "translate_chunk", "generate_outputs"]


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names, n: F.element_at(F.array(*(F.lit(s) for s in names)), (n % len(names) + 1).cast("int"))
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("job_id"), (F.col("o_custkey") % 300).alias("user_id"), pick(_STATUS, k).alias("status"), pick(_STAGE, k).alias("stage"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderdate") + F.make_dt_interval((k % 90).cast("int"))).alias("expires_at"), (k % 400).alias("max_tokens"), F.when(k % 3 == 0, 0.0).otherwise(F.col("o_totalprice")).alias("max_cost"), F.concat(F.lit("file"), k, F.lit(".md")).alias("filename")
    )


_pick = lambda names, n: "(case (" + n + f") % {len(names)} " + " ".join(f"when {i} then '{s}'" for i, s in enumerate(names)) + " end)"
JOBS = f"(select o_orderkey job_id, o_custkey % 300 user_id, {_pick(_STATUS, 'o_orderkey')} status, {_pick(_STAGE, 'o_orderkey')} stage, o_orderdate created_at, o_orderdate + to_days(cast(o_orderkey % 90 as int)) expires_at, o_orderkey % 400 max_tokens, case when o_orderkey % 3 = 0 then 0.0 else o_totalprice end max_cost, 'file' || o_orderkey || '.md' filename from orders)"


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders wait, pending ones are leased, some until now, finished ones have left the queue."""
    k, at = F.col("o_orderkey"), F.col("o_orderdate")
    rows = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'")
    return rows.select(
        k.alias("job_id"), F.when(F.col("o_orderstatus") == "O", "QUEUED").otherwise("LEASED").alias("status"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), at.alias("created_at"), (at + F.make_dt_interval((k % 5).cast("int"))).alias("available_at"), F.when(F.col("o_orderstatus") == "P", F.when(k % 60 == 7, F.lit(NOW).cast("timestamp_ntz")).otherwise(at + F.make_dt_interval((k % 60).cast("int")))).alias("lease_expires_at"), F.when(F.col("o_orderstatus") == "P", "worker").alias("lease_owner")
    )


QUEUE = "(select o_orderkey job_id, case when o_orderstatus = 'O' then 'QUEUED' else 'LEASED' end status, cast(substr(o_orderpriority, 1, 1) as int) priority, o_orderdate created_at, o_orderdate + to_days(cast(o_orderkey % 5 as int)) available_at, case when o_orderstatus = 'P' then case when o_orderkey % 60 = 7 then timestamp '1997-06-01' else o_orderdate + to_days(cast(o_orderkey % 60 as int)) end end lease_expires_at, case when o_orderstatus = 'P' then 'worker' end lease_owner from orders where o_orderstatus <> 'F')"


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("job_id"), F.when(c("l_suppkey") % 4 != 0, c("l_partkey")).alias("chunk_id"), c("l_quantity").cast("long").alias("prompt_tokens"), c("l_linenumber").cast("long").alias("completion_tokens"), (c("l_quantity").cast("long") + c("l_linenumber")).alias("total_tokens"), c("l_extendedprice").alias("cost"), (c("l_suppkey") * 10 % 700).alias("elapsed_ms"), (c("l_linenumber") % 3).cast("long").alias("retry_count")
    )


METRICS = "(select l_orderkey job_id, case when l_suppkey % 4 <> 0 then l_partkey end chunk_id, cast(l_quantity as bigint) prompt_tokens, cast(l_linenumber as bigint) completion_tokens, cast(l_quantity as bigint) + l_linenumber total_tokens, l_extendedprice cost, l_suppkey * 10 % 700 elapsed_ms, cast(l_linenumber % 3 as bigint) retry_count from lineitem)"


def translated() -> Column:
    """The translation of a chunk, of the columns of its line item."""
    return F.when(F.col("l_suppkey") % 5 != 0, F.concat(F.lit("text "), F.repeat(F.concat("l_partkey", F.lit(" ")), F.lit(250))))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their place ``chunk_index`` in their order."""
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")) - 1
    return table(spark, sf_dir, "lineitem").withColumn("chunk_index", n)


def chunks(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Line items as the chunks of their order, numbered by (line, part, supplier); ``more``
    columns of the items are kept."""
    return chunks_of(items(spark, sf_dir), *more)


def chunks_of(rows: DataFrame, *more: str) -> DataFrame:
    """The chunks of ``items``."""
    c = F.col
    status = F.when(c("l_returnflag") == "R", "FAILED").when(c("l_returnflag") == "A", "COMPLETED").otherwise("PENDING")
    return rows.select(
        c("l_orderkey").alias("job_id"), "chunk_index", F.concat(F.lit("S"), F.floor(c("chunk_index") / 3)).alias("section"), status.alias("status"), F.when(c("l_suppkey") % 3 != 0, F.concat(F.lit("sum "), "l_partkey")).alias("summary"), translated().alias("translated"), F.when(c("l_suppkey") % 7 == 0, "TABLE").otherwise("TEXT").alias("chunk_type"), F.concat(F.lit("part "), "l_partkey", F.lit(" of "), "l_quantity").alias("source_text"), (c("l_partkey") % 11 == 0).alias("protected"), F.concat(c("l_orderkey"), F.lit("-"), "chunk_index").alias("chunk_id"), (c("l_linenumber") % 2).cast("long").alias("revision_count"), *more
    )


CHUNKS = """(select l_orderkey job_id, n chunk_index, 'S' || cast(n // 3 as varchar) section, case l_returnflag when 'R' then 'FAILED' when 'A' then 'COMPLETED' else 'PENDING' end status,
  case when l_suppkey % 3 <> 0 then 'sum ' || l_partkey end summary, case when l_suppkey % 5 <> 0 then 'text ' || repeat(l_partkey || ' ', 250) end translated, case when l_suppkey % 7 = 0 then 'TABLE' else 'TEXT' end chunk_type,
  'part ' || l_partkey || ' of ' || l_quantity source_text, l_partkey % 11 = 0 protected, l_orderkey || '-' || n chunk_id, cast(l_linenumber % 2 as bigint) revision_count
  from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 n from lineitem))"""


def risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risks of chunks, by line item."""
    return risks_of(chunks(spark, sf_dir))


def risks_of(rows: DataFrame) -> DataFrame:
    """The risks of ``chunks``."""
    kinds = ["NUMBER_MISMATCH", "OMISSION", "TABLE", "NUMBER_MISMATCH"]
    one = F.explode(F.sequence(F.lit(0), (F.length("source_text") % 4).cast("int")))
    rows = rows.select("job_id", "chunk_id", "chunk_index", one.alias("k"))
    kind = F.element_at(F.array(*(F.lit(k) for k in kinds)), ((F.col("job_id") + F.col("k")) % 4 + 1).cast("int"))
    return rows.select("job_id", "chunk_id", "chunk_index", kind.alias("risk_type"), F.lit("m").alias("message"), F.when(F.col("k") == 0, "HIGH").otherwise("MEDIUM").alias("severity"), (10 - F.col("k")).alias("created_at"), F.col("k").alias("risk_id"))


RISKS = f"(select job_id, chunk_id, chunk_index, case (job_id + k) % 4 when 0 then 'NUMBER_MISMATCH' when 1 then 'OMISSION' when 2 then 'TABLE' else 'NUMBER_MISMATCH' end risk_type, 'm' message, case when k = 0 then 'HIGH' else 'MEDIUM' end severity, 10 - k created_at, k risk_id from (select job_id, chunk_id, chunk_index, unnest(generate_series(0, length(source_text) % 4)) k from {CHUNKS}))"


def markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of one document a customer: a title, and for each order a heading, a paragraph,
    a caption and a table of its items.  Which paragraph shows what goes by the key."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    k = F.col("o_orderkey").cast("string")
    row = lambda x: F.concat(F.lit("| "), x["l_partkey"], F.lit(" | "), x["n"], F.lit(" |"))
    listed = F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("n")))
    ordered = F.sort_array(F.transform(listed, lambda x: F.struct(x["l_linenumber"], x["l_partkey"], x["l_suppkey"], row(x).alias("r"))))
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.transform(ordered, lambda x: x["r"]), "\n").alias("rows"))
    # Blocks of a customer are numbered by order, before their texts are made.
    has, even = F.col("rows").isNotNull(), F.col("o_orderkey") % 2 == 0
    by_order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    before = F.sum(2 + F.when(has, 1 + even.cast("int")).otherwise(0)).over(by_order.rowsBetween(Window.unboundedPreceding, -1))
    each = o.join(items, "o_orderkey", "left").select("o_custkey", "o_orderkey", "rows", F.coalesce(before + 1, F.lit(0)).cast("int").alias("start"))
    block = lambda kind, markdown, level=None: F.struct(F.lit(kind).alias("kind"), markdown.alias("markdown"), (F.lit(None) if level is None else level).cast("int").alias("level"))
    mails = F.when(F.col("o_orderkey") % 13 == 0, F.concat(F.lit("\n| a"), k, F.lit("@x.org | b"), k, F.lit("@y.org |"))).otherwise("")
    extra = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("See [1] and [2, 3] for "), k)).when(F.col("o_orderkey") % 7 == 1, F.concat(F.lit("The sum $x+"), k, F.lit("$ holds. It does."))).when(F.col("o_orderkey") % 7 == 2, F.concat(F.lit("However, order "), k, F.lit(" differs"))).otherwise(F.concat(F.lit("Order "), k, F.lit(" is plain.")))
    level = (2 + F.col("o_orderkey") % 3).cast("int")
    blocks = F.array(
        F.when(F.col("start") == 0, block("title", F.concat(F.lit("# Customer "), "o_custkey"), F.lit(1))),
        block("heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" Order "), k), level),
        block("paragraph", extra),
        F.when(has & even, block("caption", F.concat(F.lit("Table "), k, F.lit(". Items")))),
        F.when(has, block("table", F.concat(F.lit("| part | quantity |\n| --- | --- |\n"), "rows", mails))),
    )
    rows = each.select("o_custkey", "start", F.posexplode(F.array_compact(blocks)).alias("nth", "b")).select("o_custkey", F.col("start") + F.col("nth"), "b.*").toDF("doc_id", "pos", "kind", "markdown", "heading_level")
    text = F.when(F.col("heading_level").isNotNull(), F.regexp_replace("markdown", "^#+ ", "")).otherwise(F.col("markdown"))
    return completed(rows.withColumns({"text": text, "block_id": ids.block_id(F.col("pos"))}))


MARKUP = """(select doc_id, pos, kind, markdown, level heading_level, 'block_' || lpad(cast(pos as varchar), 6, '0') block_id, case when level is not null then regexp_replace(markdown, '^#+ ', '') else markdown end as text from (
  select o_custkey doc_id, row_number() over (partition by o_custkey order by o_orderkey, part) - 1 pos, kind, markdown, level from (
    select distinct o_custkey, -1 o_orderkey, 0 part, 'title' kind, '# Customer ' || o_custkey markdown, 1 as level from orders
    union all select o_custkey, o_orderkey, 0, 'heading', repeat('#', cast(2 + o_orderkey % 3 as int)) || ' Order ' || o_orderkey, 2 + o_orderkey % 3 from orders
    union all select o_custkey, o_orderkey, 1, 'paragraph', case o_orderkey % 7 when 0 then 'See [1] and [2, 3] for ' || o_orderkey when 1 then 'The sum $x+' || o_orderkey || '$ holds. It does.' when 2 then 'However, order ' || o_orderkey || ' differs' else 'Order ' || o_orderkey || ' is plain.' end, null from orders
    union all select o_custkey, o_orderkey, 2, 'caption', 'Table ' || o_orderkey || '. Items', null from orders where o_orderkey % 2 = 0 and o_orderkey in (select l_orderkey from lineitem)
    union all select o_custkey, o_orderkey, 3, 'table', '| part | quantity |' || chr(10) || '| --- | --- |' || chr(10) || rows || case when o_orderkey % 13 = 0 then chr(10) || '| a' || o_orderkey || '@x.org | b' || o_orderkey || '@y.org |' else '' end, null
      from orders join (select l_orderkey, string_agg('| ' || l_partkey || ' | ' || cast(l_quantity as bigint) || ' |', chr(10) order by l_linenumber, l_partkey, l_suppkey, '| ' || l_partkey || ' | ' || cast(l_quantity as bigint) || ' |') rows from lineitem group by 1) on l_orderkey = o_orderkey)))"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as positioned blocks: an order a document of pages by supplier, sides by part;
    edge texts repeat over pages."""
    c = F.col
    side = c("l_partkey") % 5
    left = F.when(side == 0, 50.0).when(side < 3, 60.0).otherwise(320.0)
    width = F.when(side == 0, 500.0).otherwise(200.0)
    top = (c("l_linenumber") * 90 + c("l_suppkey") % 37 - 60).cast("double")
    bbox = F.struct(left.alias("left"), top.alias("top"), (left + width).alias("right"), (top + 30.0).alias("bottom"), F.lit(600.0).alias("page_width"), F.lit(800.0).alias("page_height"))
    text = F.when(top <= 80, F.concat(F.lit("Running  head "), c("l_orderkey") % 2)).otherwise(F.concat(F.lit("item "), "l_partkey", F.lit(" "), "l_suppkey"))
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")) - 1
    rows = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("doc_id"), pos.cast("int").alias("pos"), text.alias("text"), text.alias("markdown"), F.lit("paragraph").alias("kind"), (c("l_suppkey") % 3 + 1).cast("int").alias("page_no"), bbox.alias("bbox"))
    return completed(rows.withColumn("block_id", ids.block_id(F.col("pos"))))


BOXES = """(select l_orderkey doc_id, row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) - 1 pos, cast(l_suppkey % 3 + 1 as int) page_no, l, t top, l + w r, t + 30.0 b, case when t <= 80 then 'Running  head ' || l_orderkey % 2 else 'item ' || l_partkey || ' ' || l_suppkey end as text
  from (select *, case when l_partkey % 5 = 0 then 50.0 when l_partkey % 5 < 3 then 60.0 else 320.0 end l, case when l_partkey % 5 = 0 then 500.0 else 200.0 end w, cast(l_linenumber * 90 + l_suppkey % 37 - 60 as double) t from lineitem))"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and the text of the id before them, as source and translation."""
    d = table(spark, sf_dir, "documents")
    before = d.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("translated_text"))
    rows = d.select("doc_id", F.col("text").alias("source_text")).join(before, "doc_id").where("translated_text is not null")
    return rows.select(F.col("doc_id").cast("string").alias("chunk_id"), F.lit("TEXT").alias("chunk_type"), "source_text", "translated_text")


PAIRS = "(select cast(d.doc_id as varchar) chunk_id, d.text source_text, b.text translated_text from documents d join documents b on b.doc_id + 1 = d.doc_id where b.text is not null)"


def damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markup blocks and copies with every other citation, table row or formula mark gone."""
    rows = markup(spark, sf_dir).where("kind in ('paragraph', 'table')")
    k = F.col("pos")
    text = F.col("markdown")
    broken = F.when(k % 2 == 0, text).when(F.col("kind") == "table", F.regexp_replace(text, r"\n[^\n]*$", "")).otherwise(F.replace(F.replace(text, F.lit("[1]"), F.lit("")), F.lit("$"), F.lit("")))
    kind = F.when(F.col("kind") == "table", "TABLE").when(F.contains(text, F.lit("$")), "FORMULA").otherwise("TEXT")
    return rows.select(F.concat("doc_id", F.lit("-"), "pos").alias("chunk_id"), kind.alias("chunk_type"), text.alias("source_text"), broken.alias("translated_text"))


DAMAGED = f"(select doc_id || '-' || pos chunk_id, case when kind = 'table' then 'TABLE' when contains(markdown, '$') then 'FORMULA' else 'TEXT' end chunk_type, markdown source_text, case when pos % 2 = 0 then markdown when kind = 'table' then regexp_replace(markdown, '\\n[^\\n]*$', '') else replace(replace(markdown, '[1]', ''), '$', '') end translated_text from {MARKUP} where kind in ('paragraph', 'table'))"


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored versions of translated chunks: the translation, and a revision of revised ones."""
    rows = chunks(spark, sf_dir).where("translated is not null").select("job_id", "chunk_id", "source_text", F.explode(F.sequence(F.lit(1).cast("long"), F.col("revision_count") + 1)).alias("version_no"))
    kind = F.when(F.col("version_no") == 1, "LLM_TRANSLATION").otherwise("AUTO_REVISION")
    return rows.select("job_id", "chunk_id", "version_no", kind.alias("source_type"), F.concat("source_text", F.lit(" v"), "version_no").alias("translated_text"))


VERSIONS = f"(select job_id, chunk_id, version_no, case version_no when 1 then 'LLM_TRANSLATION' else 'AUTO_REVISION' end source_type, source_text || ' v' || version_no translated_text from (select job_id, chunk_id, source_text, unnest(generate_series(1, revision_count + 1)) version_no from {CHUNKS} where translated is not null))"


def shown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as blocks with a parser's metadata: pictures, tables and formulas, some with an
    asset, and captions that others refer to."""
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*(F.lit(x) for x in ("picture", "table", "formula", "caption"))), (k % 4 + 1).cast("int"))
    path = F.when((k % 4 != 3) & (k % 3 != 0), F.concat(F.lit("assets/"), k, F.lit(".png")))
    # The block before a caption names it, and one that isn't there first.
    refs = F.when(k % 4 == 2, F.array(F.lit("#/none"), F.concat(F.lit("#/texts/"), k + 1))).when(k % 4 == 0, F.array(F.lit(None).cast("string"), F.concat(F.lit("#/texts/"), k), F.lit(""))).otherwise(F.array().cast("array<string>"))
    own = F.when(k % 4 == 3, F.concat(F.lit("#/texts/"), k))
    meta = F.from_json(F.lit("{}"), schemas.METADATA).withField("source_asset_path", path).withField("caption_refs", refs).withField("self_ref", own)
    text = F.when(k % 8 != 0, F.col("p_name")).otherwise("")
    rows = table(spark, sf_dir, "part").select(F.floor(k / 40).cast("long").alias("doc_id"), (k % 40).cast("int").alias("pos"), kind.alias("kind"), text.alias("text"), text.alias("markdown"), meta.alias("metadata"))
    return completed(rows.withColumn("block_id", ids.block_id(F.col("pos"))))


SHOWN = "(select p_partkey k, cast(p_partkey // 40 as bigint) doc_id, p_partkey % 40 pos, 'block_' || lpad(cast(p_partkey % 40 as varchar), 6, '0') block_id, case p_partkey % 4 when 0 then 'picture' when 1 then 'table' when 2 then 'formula' else 'caption' end kind, case when p_partkey % 8 <> 0 then p_name else '' end as text, case when p_partkey % 4 <> 3 and p_partkey % 3 <> 0 then 'assets/' || p_partkey || '.png' end path from part)"
