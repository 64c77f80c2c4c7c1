"""Queries over blocks: layout, structure, chunking, Markdown, streams and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as C
from ..functions import text as X
from ..operators import chunking as K
from ..operators import layout as L
from ..operators import models as M
from ..operators import render as R
from ..operators import structure as S
from ..runtime import saved, shared_dir
from ..sources import text as T
from . import adapters as A
from .registry import query

_EDGE = "(top <= 80 or b >= 720)"
_NORM = "replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'ß', 'ss')"
_KEPT = f"""(select x.* from (select *, {_EDGE} edge, {_NORM} norm from {A.BOXES}) x left join (
 select doc_id, norm, true edge from (select doc_id, norm, count(distinct page_no) n from (select *, {_NORM} norm from {A.BOXES}) where {_EDGE} group by 1, 2) join (select doc_id, count(distinct page_no) p from {A.BOXES} group by 1) using (doc_id) where n >= greatest(2, (p + 1) // 2)) r
 on x.doc_id = r.doc_id and x.norm = r.norm and x.edge where r.norm is null)"""


@query(f"select doc_id, pos::bigint pos, text, page_no::bigint page_no from {_KEPT}")
def furniture_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.remove_furniture(A.boxes(spark, sf_dir)).select("doc_id", "pos", "text", "page_no")


_SIDE = "case when r - l <= 360 then case when (l + r) / 2 < 288 then 'left' when (l + r) / 2 > 312 then 'right' end end"


@query(f"select doc_id, pos::bigint pos, {_SIDE} side from {A.BOXES}")
def column_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.boxes(spark, sf_dir).select("doc_id", "pos", L.column_side(F.col("bbox")).alias("side"))


_PAGES = f"(select doc_id, page_no, min(top) filter (side = 'left') lt, max(b) filter (side = 'left') lb, min(top) filter (side = 'right') rt, max(b) filter (side = 'right') rb from (select *, {_SIDE} side from {{t}}) group by 1, 2)"


@query(f"select doc_id, page_no::bigint page_no, lt is not null and rt is not null and least(lb, rb) > greatest(lt, rt) two_columns from {_PAGES.format(t=A.BOXES)}")
def two_column_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.two_column_pages(A.boxes(spark, sf_dir))


@query(f"""with p as (select k.*, {_SIDE} side, coalesce(lt is not null and rt is not null and least(lb, rb) > greatest(lt, rt), false) two from {_KEPT} k join {_PAGES.format(t=_KEPT)} g using (doc_id, page_no)),
 s as (select *, 2 * sum(case when side is null then 1 else 0 end) over (partition by doc_id, page_no order by top, l, pos rows unbounded preceding) - case when side is null then 1 else 0 end seg from p),
 m as (select *, two and side is not null and count(*) filter (side = 'left') over g > 0 and count(*) filter (side = 'right') over g > 0 moved from s window g as (partition by doc_id, page_no, seg))
 select doc_id, text, page_no::bigint page_no, row_number() over (partition by doc_id order by page_no, case when two then seg end, case when two then case when side = 'right' then 1 else 0 end end, top, l, pos) - 1 pos, moved adjusted from m""")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = L.normalize(A.boxes(spark, sf_dir))
    return out.select("doc_id", "text", "page_no", "pos", F.col("metadata.layout_adjusted").alias("adjusted"))


@query(f"""select doc_id, pos, concat_ws(',', case when kind = 'table' then 'TABLE' end, case when regexp_matches(text, '(?s)\\$[^$]+\\$') then 'FORMULA' end, case when len(regexp_extract_all(text, '\\[\\d+(?:\\s*[-,]\\s*\\d+)*\\]')) >= 2 then 'REFERENCE' end, case when kind = 'paragraph' and length(text) > 2000 then 'LONG_PARAGRAPH' end) risks
 from (select doc_id, pos, kind, text from {A.MARKUP} union all select doc_id, pos, 'paragraph', text from {A.LINES})""")
def block_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.mark_risks(A.markup(spark, sf_dir).unionByName(A.lines(spark, sf_dir)))
    return rows.select("doc_id", "pos", F.array_join(F.transform("risks", lambda r: r["risk_type"]), ",").alias("risks"))


@query(f"""select doc_id, block_id, f risk_type from (select doc_id, block_id, unnest(list_filter([case when kind = 'table' then 'TABLE' end, case when regexp_matches(text, '(?s)\\$[^$]+\\$') then 'FORMULA' end, case when len(regexp_extract_all(text, '\\[\\d+(?:\\s*[-,]\\s*\\d+)*\\]')) >= 2 then 'REFERENCE' end], lambda x: x is not null)) f from {A.MARKUP})""")
def document_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.document_risks(L.mark_risks(A.markup(spark, sf_dir))).select("doc_id", "block_id", "risk_type")


_LEVELS = [f"max(pos) filter (heading_level = {k}) over w p{k}, arg_max(text, pos) filter (heading_level = {k}) over w t{k}" for k in range(1, 5)]
_SECTIONS = f"""(select doc_id, pos, kind, block_id, concat_ws(' / ', t1, case when p2 > coalesce(p1, -1) then t2 end, case when p3 > greatest(coalesce(p1, -1), coalesce(p2, -1)) then t3 end, case when p4 > greatest(coalesce(p1, -1), coalesce(p2, -1), coalesce(p3, -1)) then t4 end) path
 from (select *, {', '.join(_LEVELS)} from {A.MARKUP} window w as (partition by doc_id order by pos rows unbounded preceding)))"""


@query(f"select doc_id, pos, path from {_SECTIONS}")
def section_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sections(A.markup(spark, sf_dir)).select("doc_id", "pos", F.array_join("section_path", " / ").alias("path"))


@query(f"select doc_id, 'section_' || substr(sha256(replace(path, ' / ', ':') || ':' || block_id), 1, 24) section_id, path from {_SECTIONS} where kind in ('title', 'heading')")
def section_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.section_rows(A.markup(spark, sf_dir)).select("doc_id", "section_id", F.array_join("path", " / ").alias("path"))


_ROWS = f"(select doc_id, block_id, n, l, row_number() over (partition by doc_id, block_id order by n) - 1 as \"row\" from (select doc_id, block_id, unnest(string_split(markdown, chr(10))) l, generate_subscripts(string_split(markdown, chr(10)), 1) n from {A.MARKUP} where kind = 'table') where n <> 2)"
_TID = "'table_' || substr(sha256(block_id), 1, 24)"


@query(f"""select doc_id, {_TID} table_id, "row", j - 1 "column", trim(c) text, "row" = 0 is_header from (select *, unnest(string_split(trim(l, '|'), '|')) c, generate_subscripts(string_split(trim(l, '|'), '|'), 1) j from {_ROWS})""")
def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table_cells(A.markup(spark, sf_dir)).drop("block_id")


@query(f"select doc_id, {_TID} table_id, count(*) n_rows, 2::bigint n_columns, 'GFM' render_mode from {_ROWS} group by doc_id, block_id")
def table_render_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.tables(A.markup(spark, sf_dir)).select("doc_id", "table_id", "n_rows", "n_columns", "render_mode")


_SAID = "case o_orderkey % 6 when 0 then '0.4' when 1 then '0.6' when 2 then 'high' when 4 then '0.59' when 5 then '1' end"


@query(f"""select doc_id, {_TID} table_id, case when n > 0 then 2 else 0 end n_rows, n n_columns, confidence, case when confidence < 0.6 then 'IMAGE' when n between 1 and 8 then 'GFM' else 'HTML' end render_mode
 from (select o_orderkey doc_id, 'block_000000' block_id, case when o_orderkey % 7 = 0 then 0 else 1 + o_orderkey % 11 end n, try_cast({_SAID} as double) confidence from orders)""")
def table_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of one to eleven columns, or that can't be read as one, with what a parser says
    of its confidence (a number, a word or nothing)."""
    n = (F.col("o_orderkey") % 11 + 1).cast("int")
    names = F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("c"), i)), " | ")
    values = F.array_join(F.array_repeat(F.col("o_orderkey").cast("string"), n), " | ")
    rule = F.concat(F.repeat(F.lit("| --- "), n), F.lit("|"))
    table = F.concat(F.lit("| "), names, F.lit(" |\n"), rule, F.lit("\n| "), values, F.lit(" |"))
    markdown = F.when(F.col("o_orderkey") % 7 == 0, F.lit("Totals by order")).otherwise(table)
    rows = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("table").alias("kind"), F.lit("block_000000").alias("block_id"), markdown.alias("markdown"), F.struct(S.confidence(F.expr(_SAID)).alias("confidence")).alias("metadata"))
    return S.tables(rows).drop("block_id")


@query("""select k chunk_id, case when k % 10 = 0 and k % 20 = 0 then '<figure class="formula-asset"><img src="a/' || k || '.png" alt="公式原图"><figcaption>公式由原文截图保留，请对照原始 PDF 复核。</figcaption></figure>'
 when k % 10 = 0 then '<pre class="formula">公式解析为空，请对照原始 PDF 复核。</pre>' when k % 4 = 3 then '<pre><code>if a &lt; ' || k || ' &amp;&amp; b:' || chr(10) || '  c</code></pre>'
 else '<pre class="formula">a_' || k || ' &lt; b &amp; c</pre>' end html from (select o_orderkey k from orders)""")
def atomic_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code, and formulas in each pair of delimiters, some of them empty, with a picture or without."""
    k = F.col("o_orderkey")
    empty = k % 10 == 0
    body = F.concat(F.lit("a_"), k, F.lit(" < b & c"))
    code = F.concat(F.lit("if a < "), k, F.lit(" && b:\n  c"))
    inside = lambda a, b: F.concat(F.lit(a), body, F.lit(b))
    formula = F.when(empty, F.lit("$$ $$")).when(k % 4 == 0, inside("$$\n", "\n$$")).when(k % 4 == 1, inside("\\( ", " \\)")).otherwise(inside(" \\[", "\\] "))
    is_code = ~empty & (k % 4 == 3)
    asset = F.when(k % 20 == 0, F.concat(F.lit("a/"), k, F.lit(".png")))
    rows = A.table(spark, sf_dir, "orders").select(k.alias("chunk_id"), F.when(is_code, "CODE").otherwise("FORMULA").alias("type"), F.when(is_code, code).otherwise(formula).alias("text"), asset.alias("asset"))
    return rows.select("chunk_id", R.chunk_html(F.col("type"), F.col("text"), F.col("asset")).alias("html"))


def _formula_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.table(spark, sf_dir, "orders")
    tail = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" ("), F.col("o_orderkey") % 9, F.lit(".2)"))).otherwise("")
    body = F.concat(F.lit("$$\na + "), "o_orderkey", tail, F.lit("\n$$"))
    return T.completed(o.select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("pos"), F.lit("formula").alias("kind"), body.alias("text"), body.alias("markdown"), F.lit("block_000000").alias("block_id")))


@query("select o_orderkey doc_id, 'a + ' || o_orderkey || case when o_orderkey % 2 = 0 then ' (' || o_orderkey % 9 || '.2)' else '' end latex, case when o_orderkey % 2 = 0 then o_orderkey % 9 || '.2' end number from orders")
def formula_ir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.formulas(_formula_blocks(spark, sf_dir)).select("doc_id", "latex", "number")


_ADJACENT = f"(select doc_id, block_id caption_id, nb block_id from (select *, lead(kind) over w nk, lead(block_id) over w nb from {A.MARKUP} window w as (partition by doc_id order by pos)) where kind = 'caption' and nk in ('table', 'picture'))"


@query(f"select doc_id, block_id, caption_id from {_ADJACENT}")
def caption_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = A.markup(spark, sf_dir)
    return S.adjacent_captions(blocks, S.referenced_captions(blocks))


@query(f"select doc_id, block_id from {A.MARKUP} where kind = 'table' and len(list_distinct(regexp_extract_all(markdown, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9_.-]+\\.[A-Za-z]{{2,}}'))) >= 2")
def author_contact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.author_contacts(A.markup(spark, sf_dir)).select("doc_id", "block_id")


# Chunks of the markup blocks.  Sections never pass the limits there, so the packing of a
# section is one draft before its caption and table, and one draft for the table.
_CHUNKS = f"""(select doc_id, min(pos) p, string_agg(markdown, chr(10) || chr(10) order by pos) source_text, 'TEXT' chunk_type from (
  select *, sum(case when kind in ('title', 'heading') then 1 else 0 end) over (partition by doc_id order by pos) sec from {A.MARKUP} where kind <> 'caption') where kind <> 'table' group by doc_id, sec
 union all select t.doc_id, t.pos, coalesce(c.markdown || chr(10) || chr(10), '') || t.markdown, 'TABLE' from {A.MARKUP} t left join {_ADJACENT} a using (doc_id, block_id) left join {A.MARKUP} c on c.doc_id = t.doc_id and c.block_id = a.caption_id where t.kind = 'table')"""


@query(f"select doc_id, row_number() over (partition by doc_id order by p) - 1 chunk_index, chunk_type, source_text from {_CHUNKS}")
def section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.build_chunks(saved(A.markup(spark, sf_dir))).select("doc_id", "chunk_index", "chunk_type", "source_text")

_SP = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_SPAN = "(?s)\\$\\$.*?\\$\\$|\\$[^$\\n]+\\$|\\\\\\(.*?\\\\\\)|\\\\\\[.*?\\\\\\]|\\[\\d+(?:\\s*[-,]\\s*\\d+)*\\]"


def _stripped(t: str) -> str:
    return f"regexp_replace({t}, '^{_SP}+|{_SP}+$', '', 'g')"


def _cut(t: str) -> str:
    """Spans become a private-use character, a break one control character."""
    return f"regexp_replace(regexp_replace(regexp_replace({t}, '{_SPAN}', chr(57344), 'g'), '([.!?。！？；;؟؛])[\\s\\x0b]+', '\\1' || chr(1), 'g'), '([。！？；])', '\\1' || chr(1), 'g')"


def _sentences(rows: str, key: str) -> str:
    """(key columns, n, sentence) of rows with a text."""
    marks = "length({0}) - length(replace({0}, chr(57344), ''))"
    return f"""(select {key}, n, array_to_string(list_transform(string_split(s, chr(57344)), lambda p, i: case when i = 1 then p else spans[used + i - 1] || p end), '') sentence from (
  select *, coalesce(sum({marks.format('s')}) over (partition by {key} order by n rows between unbounded preceding and 1 preceding), 0)::bigint used from (
   select {key}, spans, s, row_number() over (partition by {key} order by k) - 1 n from (
    select {key}, spans, {_stripped('x')} s, k from (select {key}, regexp_extract_all(text, '{_SPAN}') spans, unnest(string_split({_cut('text')}, chr(1))) x, generate_subscripts(string_split({_cut('text')}, chr(1)), 1) k from {rows})) where s <> '')))"""


_CJK = "[\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}]"


def _sizes(t: str) -> str:
    return f"len(regexp_extract_all({t}, '{_CJK}')) cjk, length(regexp_replace({t}, '(?:{_CJK}|{_SP})+', '', 'g')) other"


_TOK = "greatest(1, {0} + cast(ceil(({1}) / 4) as bigint))"
_SOFT, _HARD, _LEAST = 150, 220, 40
# Lines; those over the hard limit as pieces of whole sentences; drafts; drafts merged.
_LINE_CHUNKS = f"""with recursive l as materialized (select *, {_TOK.format('cjk', 'other')} t from (select doc_id, pos, text, {_sizes('text')} from (select doc_id, pos, {_stripped('text')} as text from {A.LINES}))),
 s as materialized (select *, {_sizes('sentence')}, max(n) over (partition by doc_id, pos) last from {_sentences(f"(select doc_id, pos, text from l where t > {_HARD})", 'doc_id, pos')}),
 g(doc_id, pos, n, g, cjk, other) as (select doc_id, pos, n, 0, cjk, other from s where n = 0
  union all select s.doc_id, s.pos, s.n, case when c then g.g + 1 else g.g end, case when c then s.cjk else g.cjk + s.cjk end, case when c then s.other else g.other + s.other end
  from g join s on s.doc_id = g.doc_id and s.pos = g.pos and s.n = g.n + 1, lateral (select {_TOK.format('g.cjk + s.cjk', 'g.other + s.other')} > {_HARD} c)),
 b as materialized (select doc_id, pos, g piece, {_stripped("string_agg(sentence || case when right(sentence, 1) in ('。', '！', '？', '；') then '' else ' ' end, '' order by n)")} as text from s join g using (doc_id, pos, n) where last > 0 group by 1, 2, 3
  union all select doc_id, pos, 0, text from l where t <= {_HARD} or (doc_id, pos) in (select (doc_id, pos) from s where last = 0)),
 p as materialized (select *, {_sizes('text')}, row_number() over (partition by doc_id order by pos, piece) n from b),
 f(doc_id, n, draft, why, cjk, other) as (select doc_id, n, 0, null::varchar, cjk, other from p where n = 1
  union all select p.doc_id, p.n, case when w is null then f.draft else f.draft + 1 end, w, case when w is null then f.cjk + p.cjk else p.cjk end, case when w is null then f.other + p.other else p.other end
  from f join p on p.doc_id = f.doc_id and p.n = f.n + 1, lateral (select case when {_TOK.format('f.cjk + p.cjk', 'f.other + p.other')} > {_HARD} then 'TOKEN_HARD_LIMIT' when {_TOK.format('f.cjk + p.cjk', 'f.other + p.other')} > {_SOFT} then 'TOKEN_SOFT_LIMIT' end w)),
 d as materialized (select f.doc_id, f.draft, string_agg(p.text, chr(10) || chr(10) order by f.n) as text, sum(p.cjk)::bigint cjk, sum(p.other)::bigint other from f join p using (doc_id, n) group by 1, 2),
 r as (select doc_id, draft - 1 draft, why from f where why is not null),
 m(doc_id, draft, k, cjk, other) as (select doc_id, draft, 0, cjk, other from d where draft = 0
  union all select d.doc_id, d.draft, case when j then m.k else m.k + 1 end, case when j then m.cjk + d.cjk else d.cjk end, case when j then m.other + d.other else d.other end
  from m join d on d.doc_id = m.doc_id and d.draft = m.draft + 1, lateral (select {_TOK.format('d.cjk', 'd.other')} < {_LEAST} and {_TOK.format('d.cjk', 'd.other')} + {_TOK.format('m.cjk', 'm.other')} <= {_SOFT} j)),
 x as (select m.doc_id, m.k, string_agg(d.text, chr(10) || chr(10) order by d.draft) as text, arg_max(coalesce(r.why, 'END_OF_DOCUMENT'), d.draft) why from m join d using (doc_id, draft) left join r using (doc_id, draft) group by 1, 2)
 select doc_id, k::bigint chunk_index, why boundary_reason, {_TOK.format('cjk', 'other')} tokens, sha256(text) sha256 from (select *, {_sizes('text')} from x)"""


# Blocks with the place of their chunk: the table for a table and its caption, else the first of the section.
_MEMBERS = f"""(select b.doc_id, b.block_id, b.pos, case when b.kind = 'table' then b.pos when b.kind = 'caption' then t.pos else min(b.pos) filter (b.kind not in ('table', 'caption')) over (partition by b.doc_id, b.sec) end p
 from (select *, sum(case when kind in ('title', 'heading') then 1 else 0 end) over (partition by doc_id order by pos) sec from {A.MARKUP}) b
 left join {_ADJACENT} a on a.doc_id = b.doc_id and a.caption_id = b.block_id left join {A.MARKUP} t on t.doc_id = b.doc_id and t.block_id = a.block_id)"""
_RISK_ROWS = f"(select doc_id, block_id, unnest(list_filter([case when kind = 'table' then 'TABLE' end, case when regexp_matches(text, '(?s)\\$[^$]+\\$') then 'FORMULA' end, case when len(regexp_extract_all(text, '\\[\\d+(?:\\s*[-,]\\s*\\d+)*\\]')) >= 2 then 'REFERENCE' end], lambda x: x is not null)) risk_type from {A.MARKUP})"
_NUMBERED = f"(select *, row_number() over (partition by doc_id order by p) - 1 chunk_index from {_CHUNKS})"
_MESSAGE = "case risk_type " + " ".join(f"when '{k}' then '{v}'" for k, v in C.RISK_MESSAGES.items()) + " end"


def _risky(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    blocks = saved(A.markup(spark, sf_dir))
    return K.build_chunks(blocks), L.mark_risks(blocks)


@query(f"select distinct c.doc_id, c.chunk_index, risk_type, {_MESSAGE} message from {_RISK_ROWS} r join {_MEMBERS} m using (doc_id, block_id) join {_NUMBERED} c on c.doc_id = m.doc_id and c.p = m.p")
def chunk_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.chunk_risks(*_risky(spark, sf_dir)).select("doc_id", "chunk_index", "risk_type", "message")


@query(f"""with r as (select distinct c.doc_id, c.chunk_index, first_value(m.pos) over (partition by c.doc_id, c.chunk_index, risk_type order by m.pos) f, risk_type, {_MESSAGE} message from {_RISK_ROWS} r join {_MEMBERS} m using (doc_id, block_id) join {_NUMBERED} c on c.doc_id = m.doc_id and c.p = m.p)
 select doc_id, chunk_index, string_agg(message, '；' order by f, case risk_type when 'TABLE' then 0 when 'FORMULA' then 1 else 2 end) risk_summary from r group by 1, 2""")
def chunk_risk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.risk_summaries(K.chunk_risks(*_risky(spark, sf_dir)))


@query(f"""select doc_id, pos // 3 chunk_index, list_sort(list(distinct page_no))::varchar pages, string_agg('block_' || lpad(cast(pos as varchar), 6, '0') || '@' || page_no || ':' || cast(l as bigint), ';' order by pos) places from {A.BOXES} group by 1, 2""")
def chunk_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of three boxes each: their pages, and block, page and left edge of each box."""
    b = A.boxes(spark, sf_dir)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "block_id"))), lambda x: x["block_id"])
    found = K.locations(b.groupBy("doc_id", F.floor(F.col("pos") / 3).alias("chunk_index")).agg(listed.alias("block_ids")), b)
    place = F.transform("places", lambda x: F.concat(x["block_id"], F.lit("@"), x["page_no"], F.lit(":"), x["bbox"]["left"].cast("long")))
    return found.select("doc_id", "chunk_index", F.col("pages").cast("string").alias("pages"), F.array_join(place, ";").alias("places"))


@query(_LINE_CHUNKS)
def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full packing of lines under low limits: every closing reason and the merge fire."""
    out = K.build_chunks(saved(A.lines(spark, sf_dir)), soft=_SOFT, hard=_HARD, least=_LEAST)
    return out.select("doc_id", "chunk_index", "boundary_reason", "tokens", F.sha2("source_text", 256).alias("sha256"))


_KINDS = "case (pos + doc_id) % 29 when 3 then 'formula' when 5 then 'picture' when 7 then 'code' when 20 then 'heading' else 'paragraph' end"
_DECISIONS = "case when (cast(floor(pos / 9) as bigint) + doc_id) % 3 = 1 then 'CONTINUE' when (pos + doc_id) % 5 = 0 then 'SPLIT' end"


@query(f"""with recursive p as materialized (select doc_id, pos, case when kind = 'heading' then 'H' when kind = 'paragraph' then 'T' else 'A' end as part, pos // 40 section, decision, {_sizes('text')}, row_number() over (partition by doc_id order by pos) n
  from (select *, {_KINDS} kind, {_DECISIONS} decision from {A.CUT_LINES})),
 f(doc_id, n, draft, part, why, cjk, other) as (select doc_id, n, 0, part, null::varchar, cjk, other from p where n = 1
  union all select p.doc_id, p.n, case when w is null then f.draft else f.draft + 1 end, p.part, w, case when w is null then f.cjk + p.cjk else p.cjk end, case when w is null then f.other + p.other else p.other end
  from f join p on p.doc_id = f.doc_id and p.n = f.n + 1, lateral (select case when f.part = 'A' or p.part = 'A' then 'ATOMIC_BLOCK' when p.part = 'H' then 'SECTION_BOUNDARY' when {_TOK.format('f.cjk + p.cjk', 'f.other + p.other')} > 80 then 'TOKEN_HARD_LIMIT'
   when decision = 'SPLIT' and {_TOK.format('f.cjk', 'f.other')} >= 25 then 'LLM_SEMANTIC_SPLIT' when {_TOK.format('f.cjk + p.cjk', 'f.other + p.other')} > 50 and coalesce(decision, '') <> 'CONTINUE' then 'TOKEN_SOFT_LIMIT' end w)),
 d as materialized (select f.doc_id, f.draft, bool_and(p.part <> 'A') is_text, arg_min(p.section, p.n) section, sum(p.cjk)::bigint cjk, sum(p.other)::bigint other from f join p using (doc_id, n) group by 1, 2),
 m(doc_id, draft, k, is_text, section, cjk, other) as (select doc_id, draft, 0, is_text, section, cjk, other from d where draft = 0
  union all select d.doc_id, d.draft, case when j then m.k else m.k + 1 end, d.is_text, d.section, case when j then m.cjk + d.cjk else d.cjk end, case when j then m.other + d.other else d.other end
  from m join d on d.doc_id = m.doc_id and d.draft = m.draft + 1, lateral (select d.is_text and m.is_text and d.section = m.section and {_TOK.format('d.cjk', 'd.other')} < 25 and {_TOK.format('d.cjk', 'd.other')} + {_TOK.format('m.cjk', 'm.other')} <= 50 j)),
 r as (select doc_id, draft - 1 draft, why from f where why is not null)
 select f.doc_id, p.pos, f.draft::bigint draft, case when d.is_text then coalesce(r.why, 'END_OF_DOCUMENT') else 'ATOMIC_BLOCK' end reason, m.k::bigint chunk_index
 from f join p using (doc_id, n) join d using (doc_id, draft) join m using (doc_id, draft) left join r using (doc_id, draft)""")
def packed_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packing with headings, blocks that stand alone and decisions about boundaries: the
    draft, closing reason and chunk of each piece."""
    rows = A.cut_lines(spark, sf_dir).select("doc_id", "pos", "text")
    rows = rows.select("doc_id", "pos", F.lit(0).alias("piece"), F.expr(_KINDS).alias("kind"), F.expr(_DECISIONS).alias("decision"), F.floor(F.col("pos") / 40).cast("string").alias("section"), X.cjk_chars(F.col("text")).cast("int").alias("cjk"), X.other_chars(F.col("text")).cast("int").alias("other"))
    return K.pack(rows, soft=50, hard=80, least=25).select("doc_id", "pos", "draft", "reason", "chunk_index")


_SPLIT_ROWS = f"(select 0 kind, doc_id, pos, markdown as text from {A.MARKUP} where kind = 'paragraph' union all select 1, doc_id, pos, text from {A.LINES})"


@query(f"select doc_id, pos, n, sentence from {_sentences(_SPLIT_ROWS, 'kind, doc_id, pos')}")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.markup(spark, sf_dir).where("kind = 'paragraph'").select("doc_id", "pos", F.col("markdown").alias("text")).unionByName(A.lines(spark, sf_dir).select("doc_id", "pos", "text"))
    return rows.select("doc_id", "pos", F.posexplode(K.split_sentences(F.col("text"))).alias("n", "sentence"))


@query(f"""with r as (select doc_id, block_id, n, l, markdown from (select doc_id, block_id, markdown, unnest(string_split(markdown, chr(10))) l, generate_subscripts(string_split(markdown, chr(10)), 1) n from {A.MARKUP} where kind = 'table')),
 g as (select doc_id, block_id, (n - 3) // 3 g, string_agg(l, chr(10) order by n) body from r where n > 2 group by 1, 2, 3), c as (select doc_id, block_id, count(*) n from r where n > 2 group by 1, 2)
 select doc_id, block_id, (case when c.n <= 3 then 0 else g end)::bigint g, 'T' || case when g > 0 then ' (continued)' else '' end || chr(10) || chr(10) || '| part | quantity |' || chr(10) || '| --- | --- |' || chr(10) || body as text from g join c using (doc_id, block_id)""")
def table_row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.markup(spark, sf_dir).where("kind = 'table'")
    return rows.select("doc_id", "block_id", F.posexplode(K.table_groups(F.col("markdown"), F.lit("T"), rows_per_table=3)).alias("g", "text"))


def _merge_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.chunks(spark, sf_dir)
    return c.select(F.col("job_id").alias("doc_id"), F.col("chunk_index").alias("draft"), (F.col("chunk_type") == "TEXT").alias("is_text"), "section", F.lit(0).alias("cjk"), (F.length("source_text") * 8).alias("other"))


@query(f"""with recursive d as (select job_id doc_id, chunk_index draft, chunk_type = 'TEXT' is_text, section, length(source_text) * 8 other from {A.CHUNKS}),
 f(doc_id, draft, n, is_text, section, other) as (select doc_id, draft, 0, is_text, section, other from d where draft = 0
  union all select d.doc_id, d.draft, case when j then f.n else f.n + 1 end, d.is_text, d.section, case when j then f.other + d.other else d.other end
  from f join d on d.doc_id = f.doc_id and d.draft = f.draft + 1, lateral (select d.is_text and f.is_text and d.section = f.section and ceil(d.other / 4) < 40 and ceil(d.other / 4) + ceil(f.other / 4) <= 90 j))
 select doc_id, draft, n::bigint chunk_index from f""")
def merge_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.merge_small(_merge_input(spark, sf_dir), soft=90, least=40)


def _markdown_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.parsed_markdown(A.markup(spark, sf_dir)).select("doc_id", F.col("markdown").alias("text"))


@query(f"select doc_id, pos, kind, trim(text, ' ' || chr(10)) as text, heading_level::bigint heading_level from {A.MARKUP}")
def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks rendered to Markdown and scanned again: the round trip gives the same blocks."""
    return T.markdown_blocks(_markdown_texts(spark, sf_dir)).select("doc_id", "pos", "kind", "text", "heading_level")


@query(f"select doc_id, string_agg(markdown, chr(10) || chr(10) order by pos) || chr(10) markdown from {A.MARKUP} group by 1")
def render_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.parsed_markdown(A.markup(spark, sf_dir))


@query("select doc_id, p - 1 pos, trim(x, ' ' || chr(10)) as text from (select doc_id, unnest(x) x, generate_subscripts(x, 1) p from (select doc_id, regexp_split_to_array(replace(text, '. ', '.' || chr(10) || chr(10)), '\\n\\s*\\n') x from documents)) where trim(x, ' ' || chr(10)) <> ''")
def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.documents(spark, sf_dir).select("doc_id", F.replace("text", F.lit(". "), F.lit(".\n\n")).alias("text"))
    return T.text_blocks(d).select("doc_id", "pos", "text")


_TABLE_HTML = f"""with c as (select doc_id, block_id, r, unnest(string_split(trim(l, '|'), '|')) c, generate_subscripts(string_split(trim(l, '|'), '|'), 1) j from (select doc_id, block_id, "row" r, l from {_ROWS})),
 s as (select doc_id, block_id, r, j, replace(replace(replace(trim(c), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') x from c),
 t as (select doc_id, block_id, r, string_agg(case when r = 0 then '<th>' || x || '</th>' else '<td>' || x || '</td>' end, '' order by j) h from s group by 1, 2, 3),
 f as (select doc_id, block_id, count(*) filter (x <> '') n, count(*) filter (regexp_matches(x, '@[a-z.]+')) m, string_agg('<div class="author-card">' || x || '</div>', '' order by r, j) filter (x <> '') cards from s group by 1, 2)
 select doc_id, block_id, case when m >= 2 and n <= 16 then '<div class="author-grid">' || cards || '</div>' else '<div class="table-wrap"><table><thead><tr>' || string_agg(h, '' order by r) filter (r = 0) || '</tr></thead><tbody>' || coalesce(string_agg('<tr>' || h || '</tr>', '' order by r) filter (r > 0), '') || '</tbody></table></div>' end html
 from t join f using (doc_id, block_id) group by doc_id, block_id, m, n, cards"""


@query(_TABLE_HTML)
def table_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.markup(spark, sf_dir).where("kind = 'table'")
    return rows.select("doc_id", "block_id", R.table_html(F.col("markdown")).alias("html"))


_SAFE = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;')"
_TITLE = "regexp_extract(p, '^#+[ ]+([^\\n]+)$', 1)"
_LEVEL = "length(regexp_extract(p, '^(#+)', 1))"
_PART = f"""case when regexp_matches(p, '^#{{1,6}}[ ]+[^\\n]+$') then '<h' || {_LEVEL} || '>' || {_SAFE.format(_TITLE)} || '</h' || {_LEVEL} || '>'
 else '<p>' || replace(regexp_replace({_SAFE.format('p')}, '\\$([^$\\n]+)\\$', '<code class="inline-math">\\1</code>', 'g'), chr(10), '<br>') || '</p>' end"""


@query(f"""with h as ({_TABLE_HTML}), n as (select *, row_number() over (partition by doc_id order by p) - 1 chunk_index from {_CHUNKS})
 select n.doc_id, chunk_index, case chunk_type when 'TABLE' then h.html else array_to_string(list_transform(string_split(source_text, chr(10) || chr(10)), lambda p: {_PART}), chr(10)) end html
 from n left join h on h.doc_id = n.doc_id and n.chunk_type = 'TABLE' and h.block_id = 'block_' || lpad(cast(n.p as varchar), 6, '0')""")
def chunk_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = K.build_chunks(saved(A.markup(spark, sf_dir)))
    return c.select("doc_id", "chunk_index", R.chunk_html(F.col("chunk_type"), F.col("source_text"), F.lit(None).cast("string")).alias("html"))


@query("select doc_id || '.txt' name, 'text/plain' media_type, octet_length(encode(text)) bytes, sha256(text) sha256 from documents")
def manifest_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.documents(spark, sf_dir)
    files = d.select(F.concat(F.lit("/out/"), "doc_id", F.lit(".txt")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    return R.manifest(files).drop("type")


@query(f"select doc_id, pos, path from {_SECTIONS}")
def ir_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks to JSON documents and back, with their sections."""
    from .. import schemas

    docs = T.sectioned_json(S.sections(A.markup(spark, sf_dir), ids_too=True)).select(F.from_json("value", schemas.IR_DOCUMENT).alias("d")).select("d.*")
    return T.ir_blocks(docs).select("doc_id", "pos", F.array_join("metadata.section_path", " / ").alias("path"))


@query(f"select job_id, chunk_index::bigint chunk_index, case when protected or chunk_type in ('FORMULA', 'PICTURE', 'CODE') then source_text else '[zh] ' || source_text end translated_text from {A.CHUNKS}")
def translate_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model stage with a deterministic client; its output is no translation."""
    return M.translate(A.chunks(spark, sf_dir), M.EchoClient)


@query("""with b as (select doc_id job_id, k batch, substr(text, k * 12000 + 1, 12000) as text from (select doc_id, text, unnest(generate_series(0, cast(floor((greatest(length(text), 1) - 1) / 12000) as bigint))) k from documents where text is not null)),
 w as (select job_id, batch, w, min(p) p from (select job_id, batch, unnest(x) w, generate_subscripts(x, 1) p from (select job_id, batch, regexp_extract_all(text, '\\S+') x from b)) where regexp_matches(w, '^\\p{Lu}') and length(w) > 3 group by 1, 2, 3),
 n as (select *, row_number() over (partition by job_id, batch order by p) - 1 nth from w)
 select job_id, batch::bigint batch, nth, w source_term, upper(replace(w, 'ß', 'ss')) suggested from n where nth < 5""")
def extract_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .texts import term_batches

    return M.extract_terms(term_batches(spark, sf_dir), M.EchoClient)


@query(f"""with recursive c as materialized (select job_id, chunk_index, source_text from {A.CHUNKS}),
 f(job_id, chunk_index, summary) as (select job_id, chunk_index, '|' || left(source_text, 20) from c where chunk_index = 0
  union all select c.job_id, c.chunk_index, right(f.summary, 40) || '|' || left(c.source_text, 20) from f join c on c.job_id = f.job_id and c.chunk_index = f.chunk_index + 1)
 select job_id, chunk_index::bigint chunk_index, summary from f""")
def carried_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.events import carried_context as carried

    return carried(A.chunks(spark, sf_dir), lambda source, previous: f"{(previous or '')[-40:]}|{source[:20]}")


@query(f"select event_seq, job_id, node, status from {A.EVENTS} where event_seq > 500")
def stream_event_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written to a folder, tailed by a stream behind the cursor, and read back."""
    from ..streaming import events as E

    root = _stream_dir(spark)
    E.append(A.events(spark, sf_dir).withColumn("created_at", F.col("created_at").cast("timestamp")), f"{root}/in")
    E.collect_available(E.tail(spark, f"{root}/in", 500), f"{root}/out", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out").select("event_seq", "job_id", "node", "status")


def _stream_dir(spark: SparkSession) -> str:
    import uuid

    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
