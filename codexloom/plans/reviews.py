"""Queries over versions, edits, reviews, checkpoints, assets and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as C
from ..functions import text as X
from ..operators import metrics as M
from ..operators import models as L
from ..operators import quality as Y
from ..operators import queue as Q
from ..operators import render as R
from ..operators import structure as S
from ..operators import versions as V
from ..sources import text as T
from . import adapters as A
from .registry import query


def _case(value: str, names: dict[str, str], default: str = "null") -> str:
    return f"case {value} " + " ".join(f"when '{k}' then '{v}'" for k, v in names.items()) + f" else {default} end"


_FINAL = ", ".join(f"'{s}'" for s in C.FINAL)


@query(f"select job_id, source_text source_term from {A.CHUNKS} order by job_id, source_term")
def terms_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.chunks(spark, sf_dir).select("job_id", F.col("source_text").alias("source_term")).orderBy("job_id", "source_term")


@query(f"select job_id, chunk_id, version_no, source_type from {A.VERSIONS} order by job_id, chunk_id, version_no desc")
def versions_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.newest_first(A.versions(spark, sf_dir)).select("job_id", "chunk_id", "version_no", "source_type")


@query(f"select job_id, event_seq review_id, created_at from {A.EVENTS} where status = 'INTERRUPTED' order by job_id, created_at, event_seq")
def reviews_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.events(spark, sf_dir).where("status = 'INTERRUPTED'")
    return rows.select("job_id", F.col("event_seq").alias("review_id"), "created_at").orderBy("job_id", "created_at", "review_id")


@query(f"""select job_id, chunk_id, (n + k)::bigint version_no, t source_type, x translated_text, note edit_note from (
 select c.job_id, c.chunk_id, coalesce(v.n, 0) n, unnest([1, 2]) k, unnest(['USER_EDIT', 'RESTORE']) t, unnest(['edit of ' || source_text, source_text]) x, unnest([null, 'restore 1']) note
 from {A.CHUNKS} c left join (select chunk_id, max(version_no) n from {A.VERSIONS} group by 1) v using (chunk_id) where c.status = 'COMPLETED')""")
def version_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edit and a restoration of each finished chunk, and a write of an unknown kind."""
    done = A.chunks(spark, sf_dir).where("status = 'COMPLETED'")
    write = lambda n, kind, text, note: F.struct(F.lit(n).alias("nth"), F.lit(kind).alias("source_type"), text.alias("translated_text"), F.lit(note).alias("edit_note"))
    writes = F.array(write(1, "USER_EDIT", F.concat(F.lit("edit of "), "source_text"), None), write(2, "RESTORE", F.col("source_text"), "restore 1"), write(3, "GUESS", F.col("source_text"), None))
    return V.recorded(A.versions(spark, sf_dir), done.select("job_id", "chunk_id", F.inline(writes)), "nth")


_EDITS = f"(select c.*, j.status js, case when chunk_index % 4 = 3 then ' ' else ' new ' || source_text || ' ' end new_text from {A.CHUNKS} c left join (select job_id, status from {A.JOBS}) j using (job_id))"
_REFUSED = f"case when js is null then 'NOT_FOUND' when js not in ({_FINAL}) then 'INVALID_STATE' when status <> 'COMPLETED' or coalesce(translated, '') = '' then 'INVALID_STATE'"


#: Columns of chunks that an edit reads; the last two make the text, after the joins.
_EDITED = ("job_id", "chunk_id", "status", "revision_count", "l_partkey", "l_suppkey")


def _translated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.chunks(spark, sf_dir).withColumnRenamed("translated", "translated_text")


@query(f"select job_id, chunk_id, refused, case when refused is null then trim(new_text) else translated end translated_text, revision_count + case when refused is null then 1 else 0 end revision_count, refused is null outputs_stale from (select *, {_REFUSED} when trim(new_text) = '' then 'VALIDATION_ERROR' end refused from {_EDITS})")
def chunk_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = F.when(F.col("chunk_index") % 4 == 3, " ").otherwise(F.concat(F.lit(" new "), "source_text", F.lit(" ")))
    c = A.chunks(spark, sf_dir, "l_partkey", "l_suppkey")
    return V.edited(c.select(*_EDITED), A.jobs(spark, sf_dir), c.select("job_id", "chunk_id", new.alias("new_text")), A.translated())


@query(f"select job_id, chunk_id, refused, case when refused is null then t else translated end translated_text, revision_count + case when refused is null then 1 else 0 end revision_count, refused is null outputs_stale from (select e.*, v.translated_text t, {_REFUSED} when v.translated_text is null then 'NOT_FOUND' end refused from {_EDITS} e left join (select chunk_id, translated_text from {A.VERSIONS} where version_no = 2) v using (chunk_id))")
def chunk_restores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second version of every chunk, where there is one."""
    c = A.chunks(spark, sf_dir, "l_partkey", "l_suppkey")
    wanted = c.select("job_id", "chunk_id", F.lit(2).cast("long").alias("version_no"))
    return V.restored(c.select(*_EDITED), A.jobs(spark, sf_dir), A.versions(spark, sf_dir), wanted, A.translated())


@query(f"""select job_id, event_seq, node current_node, '{{"status":"' || status || '","retries":' || event_seq % 3 || ',"workflowVersion":"2.0"}}' state_snapshot from {A.EVENTS}""")
def checkpoint_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.events(spark, sf_dir).select("job_id", "event_seq", F.col("node").alias("current_node"), "status", (F.col("event_seq") % 3).alias("retries"))
    return V.checkpoints(rows, ["job_id", "event_seq", "current_node"], "2.0")


@query(f"select job_id, {_case('status', C.RESUMED)} status from {A.JOBS} where status in ({', '.join(repr(s) for s in C.RESUMED)}) and job_id in (select job_id from {A.EVENTS} where status = 'COMPLETED')")
def resumed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    decisions = A.events(spark, sf_dir).select("job_id", (F.col("status") == "COMPLETED").alias("approved"))
    return V.resumed(A.jobs(spark, sf_dir), decisions)


@query(f"select job_id, {_case('status', C.PAUSE_STAGES)} stage from {A.JOBS} where status in ({', '.join(repr(s) for s in C.PAUSE_STAGES)})")
def paused_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.paused(A.jobs(spark, sf_dir)).select("job_id", "stage")


@query(f"""select event_seq, case when event_seq % 3 <> 0 then 'success' when event_seq % 5 <= 2 then 'retry' else 'failed' end after_parse, case when event_seq % 4 > 0 then 'analyze' else 'split' end boundary_analysis,
 case when event_seq % 7 <> 0 then 'normalize' when event_seq % 5 <= 2 then 'retry' else 'fallback' end after_boundary_analysis, case when event_seq % 2 = 0 and event_seq % 3 = 0 then 'review' else 'summarize' end after_quality,
 case when status = 'FAILED' then 'cancelled' when status = 'COMPLETED' then 'outputs' else 'summarize' end after_translation, case when status = 'COMPLETED' then 'report' when event_seq % 6 <= 2 then 'retry' else 'failed' end after_output_validation from {A.EVENTS}""")
def stage_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, status = F.col("event_seq"), F.col("status")
    found = V.routes(k % 3 == 0, k % 5, k % 4, k % 7 == 0, k % 5, k % 2 == 0, k % 3 == 0, status == "FAILED", status == "COMPLETED", status == "COMPLETED", k % 6)
    return A.events(spark, sf_dir).select("event_seq", *(c.alias(n) for n, c in found.items()))


@query(f"""select job_id, case when go then 'TRANSLATING' else status end status, case when go then 'translate_chunk' else stage end stage, case when go then 'style ' || job_id end style_prompt, case when go then n end::bigint accepted
 from (select *, status = 'WAITING_STYLE_REVIEW' and n is not null go from {A.JOBS} left join (select job_id, max(chunk_index) n from {A.CHUNKS} group by 1) using (job_id))""")
def style_confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.chunks(spark, sf_dir)
    confirmed = c.select("job_id").distinct().withColumn("style_prompt", F.concat(F.lit(" style "), "job_id", F.lit(" ")))
    return V.styles_confirmed(A.jobs(spark, sf_dir), c.select("job_id", F.col("chunk_index").alias("attempt_no")), confirmed)


@query(f"select c.chunk_id, coalesce(g, '') terms from {A.CHUNKS} c left join (select job_id, string_agg(source_text || '=' || section, ';' order by source_text) g from (select job_id, source_text, max(section) section from {A.CHUNKS} where status = 'COMPLETED' group by 1, 2) group by 1) using (job_id)")
def chunk_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.chunks(spark, sf_dir)
    terms = c.select("job_id", F.col("source_text").alias("source_term"), F.col("section").alias("confirmed_translation"), (F.col("status") == "COMPLETED").alias("confirmed"))
    entries = F.transform(F.map_entries("glossary"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return V.with_terms(c.select("job_id", "chunk_id"), M.glossary(terms)).select("chunk_id", F.array_join(entries, ";").alias("terms"))


@query(f"select job_id, section, rk::bigint \"rank\" from (select job_id, section, row_number() over (partition by job_id order by max(chunk_index) desc, section) rk from {A.CHUNKS} group by 1, 2) where rk <= 5")
def recent_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters = A.chunks(spark, sf_dir).groupBy("job_id", "section").agg(F.max("chunk_index").alias("updated_at"))
    return V.recent_chapters(chapters).select("job_id", "section", "rank")


_BEATS = f"(select job_id, case when job_id % 3 = 0 then 'other' else 'worker' end lease_owner, lease_expires_at + to_minutes(cast(k * 10 as int)) at_ from (select *, unnest([0, 1, 2]) k from {A.QUEUE} where status = 'LEASED'))"


def _beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    owner = F.when(F.col("job_id") % 3 == 0, "other").otherwise("worker")
    k = F.explode(F.array(*(F.make_interval(mins=F.lit(10 * n)) for n in range(3))))
    return A.queue(spark, sf_dir).where("status = 'LEASED'").select("job_id", owner.alias("owner"), "lease_expires_at", k.alias("k")).select("job_id", "owner", (F.col("lease_expires_at") + F.col("k")).alias("at"))


@query(f"select job_id, lease_owner, coalesce(m + interval 30 minutes, lease_expires_at) lease_expires_at from {A.QUEUE} left join (select job_id, lease_owner, max(at_) m from {_BEATS} group by 1, 2) using (job_id, lease_owner)")
def lease_renewal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.renewed(A.queue(spark, sf_dir), _beats(spark, sf_dir))


@query(f"select q.job_id, q.status from {A.QUEUE} q where q.lease_owner is null or (q.job_id, q.lease_owner) not in (select (job_id, lease_owner) from {_BEATS})")
def lease_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.released(A.queue(spark, sf_dir), _beats(spark, sf_dir)).select("job_id", "status")


_OUTPUTS = ("bilingual.md", "translated.md", "document.html", "report.md")


@query(f"select job_id, job_id % 10 not in (0, 2, 4, 6, 8, 9) and job_id % 7 <> 0 valid from {A.JOBS}")
def outputs_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of even numbers lack a file, those that end in 9 all, those divisible by 7 have an empty one."""
    jobs = A.jobs(spark, sf_dir)
    files = jobs.where("job_id % 10 <> 9").select("job_id", F.explode(F.array(*(F.lit(n) for n in (*_OUTPUTS, "notes.txt")))).alias("name"))
    length = F.when((F.col("job_id") % 7 == 0) & (F.col("name") == "report.md"), 0).otherwise(F.length("name"))
    files = files.where("job_id % 2 = 1 or name <> 'document.html'").withColumn("length", length)
    return Y.outputs_valid(jobs, files, list(_OUTPUTS))


@query(f"select job_id, 'm' || job_id % 5 model from {A.JOBS} where job_id % 5 in (1, 3)")
def allowed_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.jobs(spark, sf_dir).select("job_id", F.concat(F.lit("m"), F.col("job_id") % 5).alias("model"))
    return Q.allowed_models(rows, F.lit('["m1", "m3"]'))


@query(f"select job_id, {_case('stage', {k: v for k, v in C.STAGE_LABELS.items()}, 'stage')} label from {A.JOBS}")
def stage_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.jobs(spark, sf_dir).select("job_id", X.lookup(F.col("stage"), C.STAGE_LABELS, F.replace("stage", F.lit("_"), F.lit(" "))).alias("label"))


@query(f"select chunk_id, risk_type, {_case('risk_type', C.RISK_LABELS, 'risk_type')} label from {A.RISKS}")
def risk_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.risks(spark, sf_dir).select("chunk_id", "risk_type", X.lookup(F.col("risk_type"), C.RISK_LABELS, F.col("risk_type")).alias("label"))


_ALIASES = ("number", "Formula", "CITATION", "table", "omission", "REFERENCE", "style", "terminology")


@query(f"select chunk_id, {_case('k', {str(n): C.ISSUE_TYPES.get(a.upper(), 'OMISSION') for n, a in enumerate(_ALIASES)})} risk_type from (select chunk_id, cast(chunk_index % {len(_ALIASES)} as varchar) k from {A.CHUNKS})")
def issue_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model issues by their names in any case; unknown ones are omissions."""
    name = F.element_at(F.array(*(F.lit(a) for a in _ALIASES)), (F.col("chunk_index") % len(_ALIASES) + 1).cast("int"))
    return A.chunks(spark, sf_dir).select("chunk_id", Y.issue_type(name).alias("risk_type"))


@query(f"select chunk_id, case when chunk_index % 3 = 0 then 'A / ' || section when chunk_index % 3 = 1 then section else '正文' end label from {A.CHUNKS}")
def path_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("chunk_index") % 3
    path = F.when(k == 0, F.array(F.lit("A"), F.col("section"))).when(k == 1, F.array().cast("array<string>"))
    return A.chunks(spark, sf_dir).select("chunk_id", X.path_label(path, F.when(k == 1, F.col("section")).when(k == 2, "")).alias("label"))


@query(f"select doc_id, block_id, 'figure_' || substr(sha256(block_id), 1, 24) figure_id, nullif(text, '') caption, '#/texts/' || k refs from {A.SHOWN} where kind = 'picture'")
def figure_ir(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.figures(A.shown_blocks(spark, sf_dir))
    return found.select("doc_id", "block_id", "figure_id", "caption", F.array_join("references", ",").alias("refs"))


@query(f"select doc_id, block_id, 'asset_' || block_id || '_source' asset_id, case kind when 'picture' then 'figure' else kind end kind, path relative_path, 'image/png' media_type from {A.SHOWN} where path is not null")
def asset_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.assets(A.shown_blocks(spark, sf_dir))


@query(f"select doc_id, block_id, 'block_' || lpad(cast(pos + 1 as varchar), 6, '0') caption_id from {A.SHOWN} s where kind = 'formula' and exists (select 1 from part where p_partkey = s.k + 1) and pos < 39")
def caption_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions that a block names by reference; of its two references the first isn't there."""
    return S.referenced_captions(A.shown_blocks(spark, sf_dir))


@query(f"""select doc_id, chunk_index, coalesce(case when k % 5 = 0 then own end, before, own) asset_id from (
 select doc_id, pos chunk_index, k, case when path is not null then 'asset_' || block_id || '_source' end own, case when b is not null then 'asset_' || bb || '_source' end before
 from (select s.*, p.path b, p.block_id bb from {A.SHOWN} s left join {A.SHOWN} p on p.doc_id = s.doc_id and p.pos = s.pos - 1))""")
def asset_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of a block and the one before it, every fifth with the path of its own asset."""
    b = A.shown_blocks(spark, sf_dir)
    key = F.col("doc_id") * 40 + F.col("pos")
    path = F.when(key % 5 == 0, F.col("metadata.source_asset_path"))
    before = F.format_string("block_%06d", F.col("pos") - 1)
    rows = b.select("doc_id", F.col("pos").alias("chunk_index"), F.array(before, "block_id").alias("block_ids"), path.alias("path"))
    return R.asset_of(rows, S.assets(b))


@query(f"select doc_id, pos::bigint pos, case when path is not null then '<figure class=\"figure-asset\"><img src=\"' || path || '\" alt=\"原文图片\">' || case when text <> '' then '<figcaption>' || text || '</figcaption>' else '' end || '</figure>' else '<figure class=\"missing-asset\"><figcaption>' || text || '</figcaption><p>图片资产未由解析器导出，请对照原始文件。</p></figure>' end html from {A.SHOWN} where kind = 'picture'")
def picture_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.shown_blocks(spark, sf_dir).where("kind = 'picture'")
    return rows.select("doc_id", "pos", R.picture_html(F.col("text"), F.col("metadata.source_asset_path")).alias("html"))


class _Strict:
    """A model that finds an issue in every text that doesn't begin with a blank, and mends it
    with the first of the known terms."""

    GOOD, BAD = '{"issues": []}', '{"issues": [{"type": "OMISSION", "message": "m", "severity": "high"}]}'

    def chat(self, task: str, payload: dict) -> str:
        if task == "quality":
            return self.GOOD if payload["translation"].startswith(" ") else self.BAD
        return f" {payload['translation']}{len(payload['issues'])}{min(payload['confirmedTerms'], default='')}"


@query(f"""select c.job_id, chunk_index::bigint chunk_index, case when chunk_index % 2 = 0 then ' ' || source_text else ' ' || source_text || '1' || coalesce(t, '') end translated_text, (chunk_index % 2)::bigint revision_count, (1 + chunk_index % 2)::bigint checks, 0::bigint issues
 from {A.CHUNKS} c left join (select job_id, min(source_text) t from {A.CHUNKS} where status = 'COMPLETED' group by 1) using (job_id)""")
def bounded_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other chunk has an issue, is revised once by it and the job's terms, and checked again."""
    c = A.chunks(spark, sf_dir)
    terms = M.glossary(c.select("job_id", F.col("source_text").alias("source_term"), F.col("section").alias("confirmed_translation"), (F.col("status") == "COMPLETED").alias("confirmed")))
    text = F.when(F.col("chunk_index") % 2 == 0, F.concat(F.lit(" "), "source_text")).otherwise(F.col("source_text"))
    rows = V.with_terms(c.select("job_id", "chunk_index", "source_text", text.alias("translated_text")), terms)
    return L.revised(rows, _Strict).withColumn("issues", F.size("issues").cast("long"))


@query(f"""select j.job_id, n + 1 attempt_no, s source_text, '[zh] ' || s translated_text, 'plain' style_prompt, 'DRAFT' status from {A.JOBS} j
 join (select job_id, max(chunk_index)::bigint n, left(string_agg(source_text, chr(10) || chr(10) order by chunk_index) filter (k <= 2 and chunk_type = 'TEXT' and not protected), 3500) s
  from (select *, row_number() over (partition by job_id, chunk_type = 'TEXT' and not protected order by chunk_index) k from {A.CHUNKS}) group by 1) c on c.job_id = j.job_id where status = 'WAITING_STYLE_REVIEW' and s is not null""")
def style_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.chunks(spark, sf_dir)
    samples = M.preview_sample(c).withColumn("style_prompt", F.lit(" plain "))
    return L.previewed(A.jobs(spark, sf_dir), samples, c.select("job_id", F.col("chunk_index").alias("attempt_no")), L.EchoClient)


@query(f"select job_id, chunk_index::bigint chunk_index, left(translated, 60) summary from {A.CHUNKS} where translated is not null")
def chunk_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.summarised(_translated(spark, sf_dir), L.EchoClient)


_LABELS = ("title", "section_header", "text", "list_item", "table", "formula", "page_footer", "chart")


@query(f"""select doc_id, pos::bigint pos, kind, case kind when 'title' then 1 when 'heading' then lv end::bigint heading_level, case kind when 'title' then '# ' || t when 'heading' then repeat('#', cast(least(lv, 6) as int)) || ' ' || t when 'list_item' then '- ' || t when 'formula' then '$$' || chr(10) || t || chr(10) || '$$' else t end markdown, 800.0 - y top, 800.0 - (y - 20) bottom from (
 select l_orderkey doc_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 pos, {_case('cast(l_partkey % 8 as varchar)', {str(n): C.LABEL_KINDS.get(x, 'other') for n, x in enumerate(_LABELS)})} kind, 'item ' || l_partkey t, l_suppkey % 9 + 1 lv, cast(700 - l_linenumber * 10 as double) y from lineitem)""")
def parser_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parser's items as blocks: kinds by label, Markdown by kind, boxes from the top."""
    from pyspark.sql import Window

    c = F.col
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1
    label = F.element_at(F.array(*(F.lit(x) for x in _LABELS)), (c("l_partkey") % len(_LABELS) + 1).cast("int"))
    y = (700 - c("l_linenumber") * 10).cast("double")
    box = F.struct(F.lit(10.0).alias("left"), y.alias("top"), F.lit(90.0).alias("right"), (y - 20.0).alias("bottom"), F.lit(600.0).alias("page_width"), F.lit(800.0).alias("page_height"))
    items = A.table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("doc_id"), pos.cast("int").alias("pos"), label.alias("label"), F.concat(F.lit("item "), "l_partkey").alias("text"), (c("l_suppkey") % 9 + 1).cast("int").alias("level"), F.lit(None).cast("string").alias("marker"), F.lit(1).alias("page_no"), box.alias("bbox")
    )
    return T.parser_items(items).select("doc_id", "pos", "kind", "heading_level", "markdown", F.col("bbox.top").alias("top"), F.col("bbox.bottom").alias("bottom"))
