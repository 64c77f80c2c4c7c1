"""Queries over jobs, queue, metrics, chunks, risks and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as C
from ..functions import text as X
from ..operators import metrics as M
from ..operators import queue as Q
from ..operators import render as R
from ..streaming import events as E
from . import adapters as A
from .registry import query

_NOW = f"timestamp '{A.NOW}'"


def _now():
    return F.lit(A.NOW).cast("timestamp")


@query(f"""select j.job_id, cast(coalesce(t, 0) as bigint) tokens, round(coalesce(c, 0), 2) cost,
 (max_tokens > 0 and coalesce(t, 0) >= max_tokens) or (max_cost > 0 and coalesce(c, 0) >= max_cost) exhausted
 from {A.JOBS} j left join (select job_id, sum(total_tokens) t, sum(cost) c from {A.METRICS} group by 1) m using (job_id)""")
def budget_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.budget_check(A.jobs(spark, sf_dir), A.metrics(spark, sf_dir))


@query(f"select job_id, count(*) total, count(*) filter (status = 'COMPLETED') completed, count(*) filter (status = 'COMPLETED') * 100.0 / count(*) percent from {A.CHUNKS} group by 1".replace("* 100.0 / count(*)", "* 100.0::double / count(*)"))
def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.progress(A.chunks(spark, sf_dir))


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.progress(A.chunks(spark, sf_dir))


@query(f"""select p.job_id, case when total - completed <= 0 then 0 else cast(trunc((total - completed) * m / 1000) as bigint) + 30 end eta_s
 from (select job_id, count(*) total, count(*) filter (status = 'COMPLETED') completed from {A.CHUNKS} group by 1) p
 left join (select job_id, median(elapsed_ms)::double m from {A.METRICS} where chunk_id is not null and elapsed_ms > 0 group by 1) using (job_id)""")
def job_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.eta_seconds(_totals(spark, sf_dir), A.metrics(spark, sf_dir))


@query(f"select job_id, sum(prompt_tokens)::bigint prompt_tokens, sum(completion_tokens)::bigint completion_tokens, sum(total_tokens)::bigint total_tokens, sum(elapsed_ms)::bigint elapsed_ms, sum(retry_count)::bigint retry_count from {A.METRICS} group by 1")
def report_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.report_metrics(A.metrics(spark, sf_dir))


@query(f"select job_id, prompt_tokens, completion_tokens, prompt_tokens * 2.5::double / 1e6 + completion_tokens * 10.0::double / 1e6 cost_usd from {A.METRICS}")
def metric_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost = M.metric_cost(F.col("prompt_tokens"), F.col("completion_tokens"), 2.5, 10.0)
    return A.metrics(spark, sf_dir).select("job_id", "prompt_tokens", "completion_tokens", cost.alias("cost_usd"))


@query(f"select job_id, (max(chunk_index) + 1)::bigint next_no from {A.CHUNKS} group by 1")
def next_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.next_number(A.chunks(spark, sf_dir), "job_id", "chunk_index")


@query(f"""select n.job_id, n.event_seq, (coalesce(h, 0) + row_number() over (partition by n.job_id order by n.event_seq))::bigint version_no
 from (select * from {A.EVENTS} where status = 'COMPLETED') n left join (select job_id, max(chunk_index) h from {A.CHUNKS} group by 1) using (job_id)""")
def version_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = A.chunks(spark, sf_dir).select("job_id", F.col("chunk_index").alias("version_no"))
    new = A.events(spark, sf_dir).where("status = 'COMPLETED'").select("job_id", "event_seq")
    return M.numbered(new, old, "job_id", "event_seq")


@query(f"select job_id, event_seq, node, created_at from {A.EVENTS} qualify row_number() over (partition by job_id order by created_at desc, event_seq desc) = 1")
def latest_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.latest(A.events(spark, sf_dir), "job_id", "created_at", "event_seq").select("job_id", "event_seq", "node", "created_at")


@query(f"select job_id, max(chunk_index)::bigint attempt_no, arg_max(source_text, chunk_index) source_text from {A.CHUNKS} group by 1")
def latest_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.chunks(spark, sf_dir).groupBy("job_id").agg(F.max("chunk_index").alias("attempt_no"), F.max_by("source_text", "chunk_index").alias("source_text"))


@query(f"select job_id, min(chunk_index)::bigint chunk_index from {A.CHUNKS} where status in ('PENDING', 'FAILED') group by 1")
def next_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.next_pending(A.chunks(spark, sf_dir))


@query(f"with q as (select * from {A.QUEUE} where status = 'QUEUED') select m.job_id, 1 + count(o.job_id) \"position\" from q m left join q o on o.available_at <= m.available_at and o.created_at < m.created_at group by 1")
def queue_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.queue_positions(A.queue(spark, sf_dir))


_CLAIM = f"""select q.job_id, user_id, priority::bigint priority, q.created_at from {A.QUEUE} q join {A.JOBS} j using (job_id)
 where available_at <= {_NOW} and (q.status = 'QUEUED' or lease_expires_at < {_NOW})
 and (select count(*) from {A.QUEUE} q2 join {A.JOBS} j2 using (job_id) where j2.user_id = j.user_id and q2.status = 'LEASED' and q2.lease_expires_at >= {_NOW}) < 5"""


@query(_CLAIM)
def queue_claimable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.claimable(A.queue(spark, sf_dir), A.jobs(spark, sf_dir), _now()).select("job_id", "user_id", "priority", "created_at")


@query(_CLAIM + " order by priority desc, q.created_at, job_id limit 1")
def queue_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.claim_order(queue_claimable(spark, sf_dir))


@query(f"select job_id, status from {A.JOBS} where status in ('UPLOADED', 'PARSED', 'TRANSLATING') and job_id not in (select job_id from {A.QUEUE})")
def recover_unqueued(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.unqueued(A.jobs(spark, sf_dir), A.queue(spark, sf_dir), ["UPLOADED", "PARSED", "TRANSLATING"]).select("job_id", "status")


_ENQUEUE = f"(select job_id, cast(job_id % 12 as int) priority from {A.JOBS} where status in ('UPLOADED', 'PARSED', 'TRANSLATING'))"


@query(f"""select coalesce(q.job_id, n.job_id) job_id, case when n.job_id is not null then 'QUEUED' else q.status end status,
 (case when n.job_id is not null then greatest(coalesce(q.priority, 0), n.priority) else q.priority end)::bigint priority, case when n.job_id is null then q.lease_owner end lease_owner
 from {A.QUEUE} q full join {_ENQUEUE} n on q.job_id = n.job_id""")
def enqueue_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = A.jobs(spark, sf_dir).where("status in ('UPLOADED', 'PARSED', 'TRANSLATING')").select("job_id", (F.col("job_id") % 12).cast("int").alias("priority"))
    return Q.enqueue(A.queue(spark, sf_dir), new)


@query(f"select job_id, status from {A.JOBS} where user_id = 7")
def owned_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.owned(A.jobs(spark, sf_dir), F.lit(7)).select("job_id", "status")


@query(f"select job_id, case when not (status in ('COMPLETED', 'FAILED', 'CANCELLED') and expires_at <= {_NOW}) then filename end filename from {A.JOBS}")
def retention_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.cleaned(A.jobs(spark, sf_dir), _now(), ["filename"]).select("job_id", "filename")


@query(f"select job_id, status from {A.JOBS} where status in ('COMPLETED', 'FAILED', 'CANCELLED') and expires_at <= {_NOW}")
def retention_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.expired(A.jobs(spark, sf_dir), _now()).select("job_id", "status")


@query(f"""select 'cancel' as action, job_id from {A.JOBS} where status in ('UPLOADED', 'PARSED', 'WAITING_TERM_REVIEW', 'WAITING_STYLE_REVIEW', 'WAITING_RISK_REVIEW', 'WAITING_CHAPTER_REVIEW', 'TRANSLATING')
 union all select 'resume', job_id from {A.JOBS} where status = 'FAILED' union all select 'edit', job_id from {A.JOBS} where status in ('COMPLETED', 'FAILED', 'CANCELLED')""")
def allowed_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [Q.allowed(A.jobs(spark, sf_dir), a).select(F.lit(a).alias("action"), "job_id") for a in ("cancel", "resume", "edit")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"select job_id, case when stage = 'parse_document' then 'UPLOADED' when stage in ('split_sections', 'extract_terms') then 'PARSED' else 'TRANSLATING' end resumed from {A.JOBS} where status = 'FAILED'")
def resume_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.allowed(A.jobs(spark, sf_dir), "resume").select("job_id", Q.resumed_status(F.col("stage")).alias("resumed"))


_SORTED_TYPES = "select job_id, chunk_id, list_sort(list(distinct risk_type)) t from {r} group by 1, 2"


@query(f"select c.chunk_id, array_to_string(t, ',') risk_types, coalesce(len(t), 0)::bigint n from {A.CHUNKS} c left join ({_SORTED_TYPES.format(r=A.RISKS)}) r using (chunk_id)")
def chunk_risk_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = M.risk_types(A.risks(spark, sf_dir), by_arrival=False)
    rows = A.chunks(spark, sf_dir).select("chunk_id").join(types, "chunk_id", "left")
    return rows.select("chunk_id", F.array_join("risk_types", ",").alias("risk_types"), F.coalesce(F.size("risk_types"), F.lit(0)).alias("n"))


@query(f"""select chunk_id, string_agg(risk_type, ',' order by first_at, k) risk_types from (
 select chunk_id, risk_type, min(created_at) first_at, min(risk_id) k from {A.RISKS} group by 1, 2) group by 1""".replace("min(risk_id) k", "arg_min(risk_id, created_at) k"))
def risk_types_by_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.risk_types(A.risks(spark, sf_dir)).select("chunk_id", F.array_join("risk_types", ",").alias("risk_types"))


@query(f"""select r.job_id, r.chunk_index, 'chunk ' || (r.chunk_index + 1) || ' · ' || c.section as "location", left(c.source_text, 300) excerpt, r.risk_type
 from {A.RISKS} r left join {A.CHUNKS} c using (chunk_id)""")
def risk_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.chunks(spark, sf_dir).select("chunk_id", "section", "source_text")
    rows = A.risks(spark, sf_dir).join(c, "chunk_id", "left")
    where = F.concat(F.lit("chunk "), F.col("chunk_index") + 1, F.lit(" · "), "section")
    return rows.select("job_id", F.col("chunk_index").cast("long").alias("chunk_index"), where.alias("location"), F.left("source_text", F.lit(300)).alias("excerpt"), "risk_type")


@query(f"select event_seq, job_id, node, status from {A.EVENTS} where event_seq > 500 order by event_seq")
def event_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.after(A.events(spark, sf_dir), 500).select("event_seq", "job_id", "node", "status")


@query(f"select job_id, node, count(*) filter (status = 'STARTED') started, count(*) filter (status = 'COMPLETED') completed, count(*) filter (status = 'FAILED') failed, count(*) filter (status = 'INTERRUPTED') interrupted, round(sum(elapsed_ms), 4) elapsed_ms from {A.EVENTS} group by 1, 2")
def node_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.timeline(A.events(spark, sf_dir)).withColumn("elapsed_ms", F.round("elapsed_ms", 4))


@query(f"select (row_number() over (order by created_at, job_id, node) + 100)::bigint event_seq, job_id, node from {A.EVENTS}")
def event_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.numbered(A.events(spark, sf_dir).drop("event_seq"), 100).select("event_seq", "job_id", "node")


@query(f"select job_id, event_seq, case when event_seq % 3 = 0 then event_seq when regexp_matches(node, '^[0-9]+$') then cast(node as bigint) end cursor from (select job_id, event_seq, case when event_seq % 2 = 0 then cast(event_seq as varchar) else node end node from {A.EVENTS})")
def last_seen_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = F.when(F.col("event_seq") % 3 == 0, F.col("event_seq"))
    header = F.when(F.col("event_seq") % 2 == 0, F.col("event_seq").cast("string")).otherwise(F.col("node"))
    return A.events(spark, sf_dir).select("job_id", "event_seq", Q.last_seen(after, header).alias("cursor"))


@query(f"select job_id, status, created_at from {A.JOBS} order by created_at desc, job_id")
def jobs_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.jobs(spark, sf_dir).select("job_id", "status", "created_at").orderBy(F.desc("created_at"), "job_id")


@query(f"select count(*) chunks, avg(case when status = 'COMPLETED' then 1.0::double else 0 end) completion_rate, avg(case when len(t) > 0 then 1.0::double else 0 end) risk_rate, sum(revision_count)::bigint revisions from {A.CHUNKS} c left join ({_SORTED_TYPES.format(r=A.RISKS)}) r using (chunk_id)")
def replay_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.replay_evaluation(replay_records(spark, sf_dir))


_REPLAY = f"""select 'job' recordType, job_id jobId, status, null chunkIndex, null sourceSha256, null riskTypes, null elapsedMs, null revisionCount from {A.JOBS}
 union all select 'chunk', c.job_id, status, chunk_index, sha256(source_text), array_to_string(coalesce(t, []), ','), null, revision_count from {A.CHUNKS} c left join ({_SORTED_TYPES.format(r=A.RISKS)}) r using (chunk_id)
 union all select 'event', job_id, status, null, null, null, elapsed_ms, null from {A.EVENTS}"""


def replay_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.chunks(spark, sf_dir).withColumnRenamed("translated", "translated_text")
    j = A.jobs(spark, sf_dir).withColumn("mode", F.lit("paper"))
    return R.replay_records(j, c, A.risks(spark, sf_dir), A.events(spark, sf_dir))


@query(f"select recordType, jobId, status, chunkIndex::bigint chunkIndex, sourceSha256, riskTypes, elapsedMs, revisionCount::bigint revisionCount from ({_REPLAY})")
def replay_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay_records(spark, sf_dir).select("recordType", "jobId", "status", "chunkIndex", "sourceSha256", F.array_join("riskTypes", ",").alias("riskTypes"), "elapsedMs", "revisionCount")


# A chunk that failed wasn't stored, a table isn't cut again; a failed table is cut.
_OLD = f"(select job_id, chunk_index, source_text, status from {A.CHUNKS} where status <> 'FAILED')"
_NEW = f"(select job_id, chunk_index, source_text || '!' source_text from {A.CHUNKS} where chunk_type = 'TEXT' or status = 'FAILED')"


@query(f"""select coalesce(o.job_id, n.job_id) job_id, coalesce(o.chunk_index, n.chunk_index)::bigint chunk_index,
 case when o.job_id is null then 'INSERT' when o.status <> 'PENDING' then 'REJECT' when n.job_id is null then 'DELETE' else 'UPDATE' end as action, coalesce(n.source_text, o.source_text) source_text
 from {_OLD} o full join {_NEW} n on o.job_id = n.job_id and o.chunk_index = n.chunk_index""")
def chunk_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.chunking import upsert_chunks

    c = A.chunks(spark, sf_dir)
    old = c.where("status <> 'FAILED'").select("job_id", "chunk_index", "source_text", "status")
    new = c.where("chunk_type = 'TEXT' or status = 'FAILED'").select("job_id", "chunk_index", F.concat("source_text", F.lit("!")).alias("source_text"))
    return upsert_chunks(old, new)


@query(f"""select job_id, section, chunk_index::bigint chunk_index, case when len(s) > 0 then array_to_string(list_slice(s, greatest(1, len(s) - 2), len(s)), chr(10)) end summary
 from (select job_id, section, chunk_index, coalesce(list(summary) filter (summary is not null) over (partition by job_id, section order by chunk_index rows between unbounded preceding and 1 preceding), []) s from {A.CHUNKS})""")
def section_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.section_summaries(A.chunks(spark, sf_dir))


@query(f"""select job_id, section, case when count(*) = 1 then string_agg(s, chr(10)) else right(string_agg(s, chr(10) order by chunk_index), 2000) end summary
 from (select job_id, section, chunk_index, coalesce(summary, left(translated, 300)) s from {A.CHUNKS} where translated is not null) group by 1, 2""")
def chapter_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.chapter_memory(A.chunks(spark, sf_dir)).drop("chapter_id")


_MENTIONS = f"(select job_id, case chunk_index % 4 when 0 then 'character' when 1 then 'Place' when 2 then 'SETTING' else 'other' end entity_type, section source_name, source_text translated_name, case when chunk_index % 2 = 0 then summary else '' end note, chunk_index, 0 nth from {A.CHUNKS})"


@query(f"""select job_id, upper(entity_type) entity_type, source_name, arg_max(translated_name, chunk_index) translated_name, arg_max(note, chunk_index) filter (note <> '') note, min(chunk_index)::bigint first_chunk, max(chunk_index)::bigint last_chunk
 from {_MENTIONS} where upper(entity_type) in ('CHARACTER', 'PLACE', 'SETTING') group by 1, 2, 3""")
def entity_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*(F.lit(k) for k in ("character", "Place", "SETTING", "other"))), (F.col("chunk_index") % 4 + 1).cast("int"))
    rows = A.chunks(spark, sf_dir).select("job_id", kind.alias("entity_type"), F.col("section").alias("source_name"), F.col("source_text").alias("translated_name"), F.when(F.col("chunk_index") % 2 == 0, F.col("summary")).otherwise("").alias("note"), "chunk_index", F.lit(0).alias("nth"))
    return M.entity_memory(rows)


@query(f"""select job_id, entity_type, source_name, rk::bigint "rank" from (select *, row_number() over (partition by job_id order by last_chunk desc, entity_type, source_name) rk from (
 select job_id, upper(entity_type) entity_type, source_name, max(chunk_index) last_chunk from {_MENTIONS} where upper(entity_type) in ('CHARACTER', 'PLACE', 'SETTING') group by 1, 2, 3)) where rk <= 3""")
def top_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.top_entities(entity_memory(spark, sf_dir), 3).select("job_id", "entity_type", "source_name", "rank")


@query(f"select job_id, left(string_agg(source_text, chr(10) || chr(10) order by chunk_index), 3500) sample from (select * from {A.CHUNKS} where chunk_type = 'TEXT' and not protected qualify row_number() over (partition by job_id order by chunk_index) <= 2) group by 1")
def preview_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.preview_sample(A.chunks(spark, sf_dir))


@query(f"select job_id, chunk_index::bigint chunk_index, lead(section) over (partition by job_id order by chunk_index) is distinct from section or lead(section) over (partition by job_id order by chunk_index) is null chapter_end from {A.CHUNKS}")
def chapter_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.chapter_ends(A.chunks(spark, sf_dir))


@query(f"""select e.job_id, e.event_seq, 'HIGH_RISK_CHUNK' review_type from (select job_id, min(event_seq) event_seq from {A.EVENTS} where status = 'FAILED' group by job_id) e
 where e.job_id not in (select job_id from {A.EVENTS} where event_seq < 50)""")
def review_get_or_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.events(spark, sf_dir)
    stored = e.where("event_seq < 50").select("job_id", F.lit("HIGH_RISK_CHUNK").alias("review_type"), F.col("job_id").alias("subject_id"))
    failed = e.where("status = 'FAILED'").groupBy("job_id").agg(F.min("event_seq").alias("event_seq"))
    wanted = failed.select("job_id", F.lit("HIGH_RISK_CHUNK").alias("review_type"), F.col("job_id").alias("subject_id"), "event_seq")
    return Q.get_or_create(stored, wanted).select("job_id", "event_seq", "review_type")


@query(f"select job_id, chunk_id, 1::bigint version_no from {A.CHUNKS} where translated is not null and job_id in (select job_id from {A.JOBS})")
def version_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("timestamp")
    c = A.chunks(spark, sf_dir).withColumns({"completed_at": none, "updated_at": none, "created_at": none})
    return M.backfill_versions(c, A.jobs(spark, sf_dir).select("job_id", "created_at")).drop("created_at")


_STATUS_CASE = " ".join(f"when '{k}' then '{v}'" for k, v in C.STATUS_LABELS.items())


@query(f"""select job_id, case status {_STATUS_CASE} end label, strftime(created_at, '%m-%d %H:%M:%S') as "at", case when e is null then '-' when e < 60000 then (e // 1000) || ' 秒' when e < 3600000 then (e // 60000) || ' 分 ' || ((e // 1000) % 60) || ' 秒' else (e // 3600000) || ' 小时 ' || ((e // 60000) % 60) || ' 分' end elapsed
 from (select job_id, status, created_at, case when job_id % 10 = 0 then null else job_id * 1237 end e from {A.JOBS})""")
def job_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    elapsed = F.when(F.col("job_id") % 10 != 0, F.col("job_id") * 1237)
    return A.jobs(spark, sf_dir).select("job_id", X.lookup(F.col("status"), C.STATUS_LABELS).alias("label"), F.date_format("created_at", "MM-dd HH:mm:ss").alias("at"), X.duration(elapsed).alias("elapsed"))


@query(f"""select job_id, e as error from (select job_id, case when suffix not in ('.pdf', '.md', '.txt') then 'UNSUPPORTED_FILE' when m not in ('paper', 'novel') then 'INVALID_MODE' when job_id % 7 = 0 then 'INVALID_OCR_MODE' when job_id % 11 > 9 then 'INVALID_LANGUAGE' when bytes > 52428800 then 'FILE_TOO_LARGE' end e from
 (select job_id, case job_id % 4 when 0 then '.md' when 1 then '.txt' when 2 then '.pdf' else '.doc' end suffix, case when job_id % 5 = 0 then 'poem' else 'paper' end m, job_id * 10000 bytes from {A.JOBS}))""")
def upload_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.quality import upload_errors

    suffix = F.element_at(F.array(*(F.lit(s) for s in (".MD", ".txt", ".pdf", ".doc"))), (F.col("job_id") % 4 + 1).cast("int"))
    rows = A.jobs(spark, sf_dir).select("job_id", F.concat(F.lit("a"), suffix).alias("filename"), F.when(F.col("job_id") % 5 == 0, "poem").otherwise("paper").alias("mode"), F.when(F.col("job_id") % 7 == 0, "maybe").otherwise(F.element_at(F.array(*(F.lit(m) for m in C.OCR_MODES)), (F.col("job_id") % 3 + 1).cast("int"))).alias("ocr_mode"),
        F.get(F.array(*(F.lit(x) for x in C.TARGET_LANGUAGES)), (F.col("job_id") % 11).cast("int")).alias("target_language"), (F.col("job_id") * 10000).alias("bytes"))
    return upload_errors(rows).select("job_id", "error")


@query(f"""select job_id, '# ' || filename || ' 翻译报告' || chr(10) || chr(10) || '## 任务' || chr(10) || chr(10) || '- 状态：' || status || chr(10) || '- Chunk：' || completed || '/' || total || chr(10) || chr(10) || '## 术语' || chr(10) || chr(10)
 || '| 原文 | 译名 | 备注 |' || chr(10) || '| --- | --- | --- |' || chr(10) || coalesce(terms || chr(10), '') || chr(10) || '## 风险' || chr(10) || chr(10) || coalesce(risks, '- 未记录风险项。') || chr(10) || chr(10) || '## 调用指标' || chr(10) || chr(10)
 || '- Prompt tokens：' || coalesce(p, 0) || chr(10) || '- Completion tokens：' || coalesce(c, 0) || chr(10) || '- 总 tokens：' || coalesce(t, 0) || chr(10) || '- 总耗时：' || coalesce(e, 0) || ' ms' || chr(10) || '- 重试次数：' || coalesce(r, 0) || chr(10) report
 from {A.JOBS} join (select job_id, count(*) total, count(*) filter (status = 'COMPLETED') completed, string_agg('| ' || source_text || ' | ' || source_text || ' |  |', chr(10) order by source_text) terms from {A.CHUNKS} group by 1) using (job_id)
 left join (select job_id, string_agg('- **' || severity || ' / ' || risk_type || '**：' || message, chr(10) order by created_at, risk_id) risks from (select * replace (created_at * 1000 + chunk_index as created_at) from {A.RISKS}) group by 1) using (job_id)
 left join (select job_id, sum(prompt_tokens) p, sum(completion_tokens) c, sum(total_tokens) t, sum(elapsed_ms) e, sum(retry_count) r from {A.METRICS} group by 1) using (job_id)""")
def job_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    terms = A.chunks(spark, sf_dir).select("job_id", F.col("source_text").alias("source_term"), F.col("source_text").alias("suggested_translation"), none.alias("confirmed_translation"), none.alias("note"))
    risks = A.risks(spark, sf_dir).withColumn("created_at", F.col("created_at") * 1000 + F.col("chunk_index"))
    jobs = A.jobs(spark, sf_dir).join(_totals(spark, sf_dir), "job_id")
    return R.report(jobs, terms, risks, A.metrics(spark, sf_dir))


@query(f"select order_id job_id, unmatched from (select coalesce(a.job_id, b.job_id) order_id, count(*) unmatched from (select job_id, chunk_id from {A.CHUNKS} where chunk_index < 3) a full join (select job_id, chunk_id from {A.CHUNKS} where chunk_index between 1 and 3) b using (job_id, chunk_id) where a.job_id is null or b.job_id is null group by 1)".replace("using (job_id, chunk_id)", "on a.job_id = b.job_id and a.chunk_id = b.chunk_id"))
def term_set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.chunks(spark, sf_dir).select("job_id", F.col("chunk_id").alias("term_id"), "chunk_index")
    return M.unmatched_terms(c.where("chunk_index < 3"), c.where("chunk_index between 1 and 3"))


@query(f"select job_id, string_agg(source_text || '=' || section, ';' order by source_text) glossary from (select job_id, source_text, max(section) section from {A.CHUNKS} where status = 'COMPLETED' group by 1, 2) group by 1")
def glossary_confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.chunks(spark, sf_dir).select("job_id", F.col("source_text").alias("source_term"), F.col("section").alias("confirmed_translation"), (F.col("status") == "COMPLETED").alias("confirmed"))
    entries = F.transform(F.map_entries("glossary"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return M.glossary(c).select("job_id", F.array_join(entries, ";").alias("glossary"))
