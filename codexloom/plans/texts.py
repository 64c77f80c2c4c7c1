"""Queries over texts: language, boundaries, similarity, quality checks, rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed as C
from ..functions import ids
from ..functions import text as X
from ..operators import boundary as B
from ..operators import chunking as K
from ..operators import quality as Y
from ..operators import render as R
from ..runtime import saved
from . import adapters as A
from .registry import query

_CJK = "[\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}]"


def _tokens_sql(t: str) -> str:
    cjk = f"len(regexp_extract_all({t}, '{_CJK}'))"
    other = f"length(regexp_replace(regexp_replace({t}, '{_CJK}', '', 'g'), '[\\s\\x0b\\x1c-\\x1f\\x85\\x{{a0}}]', '', 'g'))"
    return f"greatest(1, {cjk} + cast(ceil({other} / 4) as bigint))::bigint"


@query(f"select doc_id, {_tokens_sql('text')} tokens from documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.documents(spark, sf_dir).select("doc_id", X.estimate_tokens(F.col("text")).alias("tokens"))


@query("""with h as (select doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(doc_id || ':' || source)) s, sha256(doc_id || ':' || source) h from documents)
 select doc_id, 'chunk_' || substr(s, 1, 12) || '5' || substr(s, 14, 3) || substr('89ab', (instr('0123456789abcdef', substr(s, 17, 1)) - 1) % 4 + 1, 1) || substr(s, 18, 15) name_id, 'section_' || substr(h, 1, 24) short_id from h""")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.table(spark, sf_dir, "documents")
    return d.select("doc_id", ids.name_uuid("chunk", F.col("doc_id"), F.col("source")).alias("name_id"), ids.short_hash("section", F.col("doc_id"), F.col("source")).alias("short_id"))


PACK_LIMIT = 180


@query(f"""with recursive l as (select doc_id, pos, row_number() over (partition by doc_id order by pos) n, len(regexp_extract_all(text, '{_CJK}')) cjk, length(regexp_replace(regexp_replace(text, '{_CJK}', '', 'g'), '\\s', '', 'g')) other from {A.LINES}),
 f(doc_id, n, g, cjk, other) as (select doc_id, n, 0, cjk, other from l where n = 1
  union all select l.doc_id, l.n, case when c then f.g + 1 else f.g end, case when c then l.cjk else f.cjk + l.cjk end, case when c then l.other else f.other + l.other end
  from f join (select *, 1 as one from l) l on l.doc_id = f.doc_id and l.n = f.n + 1, lateral (select greatest(1, f.cjk + l.cjk + cast(ceil((f.other + l.other) / 4) as bigint)) > {PACK_LIMIT} c))
 select f.doc_id, g::bigint chunk_index, count(*) n_lines, greatest(1, sum(l.cjk) + cast(ceil(sum(l.other) / 4) as bigint))::bigint tokens from f join l on l.doc_id = f.doc_id and l.n = f.n group by 1, 2""")
def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines packed into chunks of at most 180 tokens (a low limit, so that most texts split)."""
    return K.pack_lines(A.lines(spark, sf_dir), PACK_LIMIT)


def _count_sql(text: str, word: str) -> str:
    return f"(length({text}) - length(replace({text}, '{word}', ''))) // {len(word)}"


_MARKERS = {k: " + ".join(_count_sql("t", w) for w in ws) for k, ws in C.MARKERS.items()}
_BEST = " ".join(f"when {k} = m then '{k}'" for k in C.MARKERS)
_SCRIPT = {k: f"len(regexp_extract_all(h, '{p}'))" for k, p in (("ja", "[\\x{3040}-\\x{30ff}]"), ("ko", "[\\x{ac00}-\\x{d7af}]"), ("ar", "[\\x{0600}-\\x{06ff}]"), ("ru", "[\\x{0400}-\\x{04ff}]"))}


@query(f"""with j as (select doc_id, left(string_agg(text, chr(10) order by pos), 20000) h from {A.LINES} group by 1),
 s as (select doc_id, h, ' ' || replace(lower(h), 'ß', 'ss') || ' ' t, {', '.join(f'{v} x_{k}' for k, v in _SCRIPT.items())} from j),
 c as (select doc_id, h, greatest({', '.join(f'x_{k}' for k in _SCRIPT)}) x, x_ja, x_ko, x_ar, x_ru, {', '.join(f'{v} {k}' for k, v in _MARKERS.items())} from s),
 m as (select *, greatest({', '.join(C.MARKERS)}) m from c)
 select doc_id, case when x >= 4 then case x when x_ja then 'ja' when x_ko then 'ko' when x_ar then 'ar' else 'ru' end when len(regexp_extract_all(h, '[\\x{{3400}}-\\x{{9fff}}]')) >= 8 then 'zh' when m > 0 then case {_BEST} end else 'en' end "language" from m""")
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.document_language(A.lines(spark, sf_dir))


_PAIRS = "(select * from (select doc_id, pos, block_id l_id, text l, page_no lp, lead(block_id) over w r_id, lead(text) over w r, lead(page_no) over w rp from {t} window w as (partition by doc_id order by pos)) where r is not null)"
_TRIM = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


@query(f"""with p as (select *, {_TRIM.format('l')} ls, {_TRIM.format('r')} rs from {_PAIRS.format(t=A.CUT_LINES)}),
 s as (select *, coalesce(lp <> rp, false) pb, not regexp_matches(ls, '[.!?。！？；;][\\]\\)）】''"]*$') inc, regexp_matches(ls, '[A-Za-z]{{2,}}-$') hy, regexp_matches(rs, '^[a-z]') lo from p)
 select doc_id, l_id left_id, r_id right_id, right(l, 800) "left", left(r, 800) "right", concat_ws(',', case when pb then 'PAGE_BREAK' end, case when inc then 'INCOMPLETE_PUNCTUATION' end, case when hy then 'HYPHENATED_WORD' end, case when lo then 'LOWERCASE_CONTINUATION' end) signals
 from s where pb and (inc or hy or lo)""")
def boundary_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = B.boundary_candidates(A.cut_lines(spark, sf_dir))
    return found.select("doc_id", "left_id", "right_id", "left", "right", F.array_join("signals", ",").alias("signals"))


@query(f"""with p as (select *, {_TRIM.format('l')} ls, {_TRIM.format('r')} rs from {_PAIRS.format(t=A.CUT_LINES)}),
 s as (select *, coalesce(lp <> rp, false) pb, not regexp_matches(ls, '[.!?。！？；;][\\]\\)）】''"]*$') inc, regexp_matches(ls, '[A-Za-z]{{2,}}-$') hy, regexp_matches(rs, '^[a-z]') lo from p)
 select doc_id, r_id right_id, case when hy or lo then 'CONTINUE' when inc then 'UNCERTAIN' else 'SPLIT' end decision from s where pb and (inc or hy or lo)""")
def boundary_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = B.boundary_candidates(A.cut_lines(spark, sf_dir))
    return B.decided(found, B.rule_decision).select("doc_id", "right_id", "decision")


@query(f"""with p as (select *, {_TRIM.format('l')} ls, {_TRIM.format('r')} rs from {_PAIRS.format(t=A.CUT_LINES)}),
 s as (select *, coalesce(lp <> rp, false) pb, not regexp_matches(ls, '[.!?。！？；;][\\]\\)）】''"]*$') inc, regexp_matches(ls, '[A-Za-z]{{2,}}-$') hy, regexp_matches(rs, '^[a-z]') lo from p)
 select doc_id, r_id right_id, 'CROSS_PAGE_UNCERTAIN' risk_type, 'MEDIUM' severity from s where pb and (inc or hy or lo)""")
def boundary_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.decision_risks(B.fallback_decisions(B.boundary_candidates(A.cut_lines(spark, sf_dir))))


def _line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = Window.partitionBy("doc_id").orderBy("pos")
    rows = A.lines(spark, sf_dir).select("doc_id", "pos", "text", F.lead("text").over(after).alias("next"))
    return rows.where("next is not null")


_LINE_PAIRS = f"(select * from (select doc_id, pos, text l, lead(text) over (partition by doc_id order by pos) r from {A.LINES}) where r is not null)"
_WORDS = "list_transform(list_filter(regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 1), lambda w: replace(lower(w), 'ß', 'ss'))"
_COSINE = f"""p as (select doc_id, pos, l, r, row_number() over () k from {_LINE_PAIRS}),
 a as (select k, w, count(*) n from (select k, unnest({_WORDS.format('l')}) w from p) group by 1, 2), b as (select k, w, count(*) n from (select k, unnest({_WORDS.format('r')}) w from p) group by 1, 2),
 na as (select k, sqrt(sum(n * n)) s from a group by 1), nb as (select k, sqrt(sum(n * n)) s from b group by 1), d as (select k, sum(a.n * b.n) d from a join b using (k, w) group by 1),
 cos as (select doc_id, pos, l, r, coalesce(d / (na.s * nb.s), 0) x from p left join na using (k) left join nb using (k) left join d using (k))"""


@query(f"with {_COSINE} select doc_id, pos, round(x, 6) cosine from cos")
def lexical_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_pairs(spark, sf_dir).select("doc_id", "pos", F.round(X.lexical_cosine(F.col("text"), F.col("next")), 6).alias("cosine"))


_DISCOURSE = " or ".join(f"starts_with(replace(lower({_TRIM.format('r')}), 'ß', 'ss'), '{m}')" for m in C.DISCOURSE)


@query(f"with {_COSINE} select doc_id, pos, round(least(1.0, greatest(0.0, 1 - x + case when {_DISCOURSE} then 0.12 else 0 end)), 6) score from cos")
def boundary_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_pairs(spark, sf_dir).select("doc_id", "pos", F.round(X.boundary_score(F.col("text"), F.col("next")), 6).alias("score"))


@query("""select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def embedding_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors and those of the next id."""
    e = A.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(after, "vec_id").select("vec_id", F.round(X.vector_cosine(F.col("embedding"), F.col("next")), 6).alias("cosine"))


_STOP = ", ".join(f"'{w}'" for w in C.STOPWORDS)


@query(f"""with w as (select doc_id, unnest(x) w, generate_subscripts(x, 1) p from (select doc_id, {_WORDS.format('text')} x from documents)),
 c as (select doc_id, w, count(*) n, min(p) f from w where w not in ({_STOP}) group by 1, 2),
 t as (select *, row_number() over (partition by doc_id order by n desc, f) k from c)
 select d.doc_id, string_agg(w, ', ' order by k) topic from documents d left join (select * from t where k <= 5) t using (doc_id) group by 1""")
def topic_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.topics(A.documents(spark, sf_dir), "doc_id", "text")


def _suspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every line, numbered through the whole document."""
    reason = F.when(F.col("pos") % 3 == 0, "SECTION_BOUNDARY").otherwise("TOKEN_SOFT_LIMIT")
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1
    return A.cut_lines(spark, sf_dir).select("doc_id", n.alias("chunk_index"), F.col("text").alias("source_text"), reason.alias("boundary_reason"))


@query(f"""with c as (select doc_id, row_number() over w - 1 k, text, pos, lag(text) over w t from {A.CUT_LINES} window w as (partition by doc_id order by pos)),
 s as (select doc_id, k, regexp_replace(t, '\\s+$', '') l, regexp_replace(text, '^\\s+', '') r, pos % 3 <> 0 soft from c where t is not null)
 select doc_id, k::bigint chunk_index, right(l, 800) "left", left(r, 800) "right" from s where regexp_matches(r, '^\\p{{Ll}}') or (l <> '' and not contains('{C.CLOSERS}', right(l, 1)) and soft)""")
def cross_chunk_suspicion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.cross_chunk_suspicion(_suspects(spark, sf_dir))


@query(f"""with c as (select doc_id, row_number() over w - 1 k, text, pos, lag(text) over w t from {A.CUT_LINES} window w as (partition by doc_id order by pos)),
 s as (select doc_id, k, regexp_replace(t, '\\s+$', '') l, regexp_replace(text, '^\\s+', '') r, pos % 3 <> 0 soft from c where t is not null)
 select doc_id, k::bigint chunk_index, case when k % 4 = 1 then 'SEMANTIC_DISCONTINUITY' else 'BOUNDARY_MODEL_FAILED' end risk_type, case when k % 4 = 1 then 'HIGH' else 'MEDIUM' end severity,
 case when k % 4 = 1 then '{C.COHERENCE_MESSAGES["SEMANTIC_DISCONTINUITY"]}' else '{C.COHERENCE_MESSAGES["BOUNDARY_MODEL_FAILED"]}' end message from s where k % 4 <> 2 and (regexp_matches(r, '^\\p{{Ll}}') or (l <> '' and not contains('{C.CLOSERS}', right(l, 1)) and soft))""")
def coherence_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risks of suspected cuts by recorded answers: to go on, to split, an error or none."""
    rows = saved(_suspects(spark, sf_dir))
    nth = F.col("chunk_index") % 4
    answers = rows.where(nth > 0).select("doc_id", "chunk_index", F.when(nth == 1, "CONTINUE").when(nth == 2, "SPLIT").alias("decision"), F.when(nth == 3, "timeout").alias("error"))
    return B.coherence_risks(B.cross_chunk_suspicion(rows), answers)


_NUMBERS = "regexp_extract_all({0}, '(^|[^\\p{{L}}\\p{{N}}_])([+-]?\\p{{Nd}}+(?:[.,]\\p{{Nd}}+)*(?:%|[a-zA-Z]+)?)', 2)"


def _differing(spark: SparkSession, sf_dir: str, pattern: str, rows: DataFrame) -> DataFrame:
    return rows.select("chunk_id", Y.sequences_differ(F.col("source_text"), F.col("translated_text"), pattern).alias("differs"))


@query(f"select chunk_id, {_NUMBERS.format('source_text')} <> {_NUMBERS.format('translated_text')} differs from {A.PAIRS}")
def number_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _differing(spark, sf_dir, C.NUMBER, A.pairs(spark, sf_dir))


_FORMULAS = "regexp_extract_all({0}, '(?s)\\$\\$.*?\\$\\$|\\$[^$\\n]+\\$')"


@query(f"select chunk_id, {_FORMULAS.format('source_text')} <> {_FORMULAS.format('translated_text')} differs from {A.PAIRS} union all select chunk_id, {_FORMULAS.format('source_text')} <> {_FORMULAS.format('translated_text')} from {A.DAMAGED}")
def formula_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _differing(spark, sf_dir, C.FORMULA, A.pairs(spark, sf_dir).unionByName(A.damaged(spark, sf_dir)))


_CITES = "regexp_extract_all({0}, '\\[\\d+(?:\\s*[-,]\\s*\\d+)*\\]')"


@query(f"select chunk_id, {_CITES.format('source_text')} <> {_CITES.format('translated_text')} differs from {A.DAMAGED}")
def citation_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _differing(spark, sf_dir, C.CITATION, A.damaged(spark, sf_dir))


def _marks(t: str, m: str) -> str:
    return f"(length({t}) - length(replace({t}, '{m}', '')))"


@query(f"select chunk_id, {_marks('source_text', '$')} - {_marks('translated_text', '$')} dollars, {_marks('source_text', '[')} - {_marks('translated_text', '[')} brackets from {A.DAMAGED}")
def marker_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    diff = lambda m: Y.marker_count(F.col("source_text"), m) - Y.marker_count(F.col("translated_text"), m)
    return A.damaged(spark, sf_dir).select("chunk_id", diff("$").alias("dollars"), diff("[").alias("brackets"))


_PIPES = "len(list_filter(string_split({0}, chr(10)), lambda x: starts_with(ltrim(x), '|')))"


@query(f"select chunk_id, {_PIPES.format('source_text')} source_rows, {_PIPES.format('translated_text')} translated_rows from {A.DAMAGED} where chunk_type = 'TABLE'")
def table_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.damaged(spark, sf_dir).where("chunk_type = 'TABLE'")
    return rows.select("chunk_id", Y.table_lines(F.col("source_text")).alias("source_rows"), Y.table_lines(F.col("translated_text")).alias("translated_rows"))


_PROFILE = "case when chunk_type in ('TABLE', 'FORMULA') then lower(chunk_type) when regexp_matches(source_text, '\\[\\d+(?:\\s*[-,]\\s*\\d+)*\\]') then 'reference' else 'text' end"


@query(f"select chunk_id, {_PROFILE} profile from {A.DAMAGED}")
def translation_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.damaged(spark, sf_dir).select("chunk_id", Y.profile(F.col("chunk_type"), F.col("source_text")).alias("profile"))


_MAILS = "len(list_distinct(regexp_extract_all({0}, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9_.-]+\\.[A-Za-z]{{2,}}')))"


@query(f"select chunk_id, chunk_type in ('FORMULA', 'PICTURE', 'CODE') or (chunk_type = 'TABLE' and {_MAILS.format('source_text')} >= 2) protected from {A.DAMAGED}")
def protected_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.damaged(spark, sf_dir).select("chunk_id", Y.protected(F.col("chunk_type"), F.col("source_text"), F.lit(False)).alias("protected"))


_FINDINGS = f"""(select chunk_id, 'NUMBER_MISMATCH' risk_type, 0 nth from {A.DAMAGED} where {_NUMBERS.format('source_text')} <> {_NUMBERS.format('translated_text')}
 union all select chunk_id, 'FORMULA_MISMATCH', 1 from {A.DAMAGED} where {_FORMULAS.format('source_text')} <> {_FORMULAS.format('translated_text')}
 union all select chunk_id, 'CITATION_MISMATCH', 2 from {A.DAMAGED} where {_CITES.format('source_text')} <> {_CITES.format('translated_text')}
 union all select chunk_id, case p when 'table' then 'TABLE' when 'formula' then 'FORMULA_MISMATCH' else 'REFERENCE' end, 3 from (select *, {_PROFILE} p from {A.DAMAGED})
  where (p = 'table' and {_PIPES.format('source_text')} <> {_PIPES.format('translated_text')}) or (p = 'formula' and {_marks('source_text', '$')} <> {_marks('translated_text', '$')}) or (p = 'reference' and {_marks('source_text', '[')} <> {_marks('translated_text', '[')}))"""


@query(f"select chunk_id, risk_type, row_number() over (partition by chunk_id order by nth) - 1 nth from {_FINDINGS}")
def quality_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.findings(A.damaged(spark, sf_dir)).select("chunk_id", "risk_type", "nth")


@query(f"select chunk_id, true high_risk from {_FINDINGS} where not (risk_type = 'TABLE' and chunk_id like '1%') group by 1")
def new_high_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Y.findings(A.damaged(spark, sf_dir))
    stored = found.where("risk_type = 'TABLE' and chunk_id like '1%'")
    return Y.high_risk(Y.new_risks(found, stored))


@query("select doc_id, replace(replace(text, '|', '\\|'), chr(10), ' ') cell, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') safe from documents")
def escape_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.documents(spark, sf_dir).select("doc_id", X.escape_markdown(F.col("text")).alias("cell"), X.escape_html(F.col("text")).alias("safe"))


@query("""select doc_id job_id, k::bigint batch, substr(text, k * 12000 + 1, 12000) as text from (select doc_id, text, unnest(generate_series(0, cast(floor((greatest(length(text), 1) - 1) / 12000) as bigint))) k from documents where text is not null)""")
def term_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document a job: the batches of its text."""
    from ..operators.metrics import term_batches as cut

    return cut(A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("job_id"), "text"))


@query(f"""with w as (select source job_id, doc_id, unnest(x) w, generate_subscripts(x, 1) p from (select source, doc_id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+') x from documents)),
 r as (select *, replace(lower(w), 'ß', 'ss') k, row_number() over (partition by job_id, replace(lower(w), 'ß', 'ss') order by doc_id, p) n from w)
 select job_id, k "key", w source_term from r where n = 1""")
def term_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.metrics import first_terms

    words = F.posexplode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    d = A.table(spark, sf_dir, "documents").select(F.col("source").alias("job_id"), F.col("doc_id").alias("batch"), words.alias("nth", "source_term"))
    return first_terms(d.withColumn("suggested", F.upper("source_term"))).select("job_id", "key", "source_term")


@query(f"""select job_id, string_agg('<!-- chunk:' || chunk_id || ' -->' || chr(10) || '### Original' || chr(10) || source_text || chr(10) || chr(10) || '### 译文（ZH）' || chr(10) || shown || chr(10), chr(10) order by chunk_index) body
 from (select *, trim(case when protected then source_text else coalesce(translated, '') end) shown from {A.CHUNKS}) group by 1""".replace("select job_id, string_agg", "select job_id, '# 双语对照' || chr(10) || chr(10) || trim(string_agg", 1).replace("order by chunk_index) body", "order by chunk_index), chr(10) || ' ') || chr(10) markdown", 1))
def bilingual_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bilingual_markdown(A.chunks(spark, sf_dir).withColumnRenamed("translated", "translated_text"))


@query(f"select job_id, trim(string_agg(trim(case when protected then source_text else coalesce(translated, '') end), chr(10) || chr(10) order by chunk_index), chr(10) || ' ') || chr(10) markdown from {A.CHUNKS} group by 1")
def translated_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.translated_markdown(A.chunks(spark, sf_dir).withColumnRenamed("translated", "translated_text"))
