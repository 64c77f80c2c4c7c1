"""Queries over versioned tables: what is stored after a commit."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as C
from ..operators import persist as P
from ..operators import queue as Q
from ..runtime import saved, shared_dir
from ..sources.versioned import VersionedStore
from . import adapters as A
from .registry import query

_NOW = f"timestamp '{A.NOW}'"


def _now():
    return F.lit(A.NOW).cast("timestamp_ntz")


def seeded(spark: SparkSession, tables: dict[str, DataFrame]) -> VersionedStore:
    """A store of its own in the shared folder, which goes when the application ends."""
    store = VersionedStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", 8)
    store.folder.fs.deleteOnExit(store.folder.path())
    tx = store.begin()
    for name, rows in tables.items():
        tx.replace(name, rows)
    tx.commit()
    return store


def _name_uuid(prefix: str, name: str) -> str:
    h = f"sha1(unhex('{C.NAMESPACE_URL}') || encode({name}))"
    return f"'{prefix}_' || substr({h}, 1, 12) || '5' || substr({h}, 14, 3) || substr('89ab', (('0x' || substr({h}, 17, 1))::int & 3) + 1, 1) || substr({h}, 18, 15)"


# A chunk that failed wasn't stored, a table isn't cut again; a failed table is cut.
_OLD = f"(select job_id, chunk_index::bigint chunk_index, chunk_id, section, chunk_type, source_text, status, translated, false has_risk, null::varchar risk_summary from {A.CHUNKS} where status <> 'FAILED')"
_DRAFTS = f"(select job_id, chunk_index::bigint chunk_index, section || '.' section, 'TEXT' chunk_type, source_text || '!' source_text from {A.CHUNKS} where chunk_type = 'TEXT' or status = 'FAILED')"
_DRAFT_RISKS = f"(select job_id, chunk_index::bigint chunk_index, risk_id nth, risk_type, message || risk_type message from {A.RISKS})"
_WANTED = f"(select job_id from {A.JOBS} union select -job_id from {A.JOBS} where status = 'FAILED')"
_OUTCOMES = f"""(select w.job_id, case when j.status is null then 'JOB_NOT_FOUND' when j.status not in ('UPLOADED', 'PARSED') then 'INVALID_STATE' when w.job_id not in (select job_id from {_DRAFTS}) then 'VALIDATION_ERROR'
 when w.job_id in (select job_id from {_OLD} where status <> 'PENDING') then 'INVALID_STATE' else 'APPLIED' end outcome from {_WANTED} w left join {A.JOBS} j using (job_id))"""
_GO = f"(select job_id from {_OUTCOMES} where outcome = 'APPLIED')"
_OLD_RISKS = f"(select r.job_id, r.chunk_index::bigint chunk_index, r.chunk_id, risk_type, message, severity from {A.RISKS} r join {_OLD} o using (chunk_id))"
_FIRST = f"(select job_id, chunk_index, risk_type, message, min(nth) nth from {_DRAFT_RISKS} group by 1, 2, 3, 4)"
_ID = f"coalesce(o.chunk_id, {_name_uuid('chunk', "d.job_id || ':' || d.chunk_index")})"


def _stored(spark: SparkSession, sf_dir: str) -> tuple[VersionedStore, DataFrame]:
    """The drafts of all jobs, and of some that aren't there, persisted over the stored chunks."""
    # The items are numbered once and stored without their texts, of which five tables are made.
    items = saved(A.items(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "chunk_index"))
    c = A.chunks_of(items).withColumn("chunk_index", F.col("chunk_index").cast("long"))
    none = F.lit(None).cast("string")
    old = c.where("status <> 'FAILED'").select("job_id", "chunk_index", "chunk_id", "section", "chunk_type", "source_text", "status", "translated", F.lit(False).alias("has_risk"), none.alias("risk_summary"))
    r = A.risks_of(c)
    # Risks of the stored chunks: made of these, so they needn't be joined with them.
    old_risks = A.risks_of(old).select("job_id", "chunk_index", "chunk_id", none.alias("risk_id"), "risk_type", "message", "severity", none.alias("source_excerpt"))
    jobs = A.jobs(spark, sf_dir)
    store = seeded(spark, {"jobs": jobs.select("job_id", "status", "stage", F.lit(0).cast("long").alias("total_chunks")), "chunks": old, "risks": old_risks})
    drafts = c.where("chunk_type = 'TEXT' or status = 'FAILED'").select("job_id", "chunk_index", F.concat("section", F.lit(".")).alias("section"), F.lit("TEXT").alias("chunk_type"), F.concat("source_text", F.lit("!")).alias("source_text"))
    draft_risks = r.select("job_id", "chunk_index", F.col("risk_id").alias("nth"), "risk_type", F.concat("message", "risk_type").alias("message"))
    wanted = jobs.select("job_id").unionByName(jobs.where("status = 'FAILED'").select((-F.col("job_id")).alias("job_id")))
    return store, P.persist(store, drafts, draft_risks, wanted, _now())


@query(f"select job_id, outcome from {_OUTCOMES}")
def persist_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir)[1]


@query(f"""select job_id, chunk_index, chunk_id, section, chunk_type, source_text, status, translated, has_risk, risk_summary from {_OLD} where job_id not in {_GO}
 union all select d.job_id, d.chunk_index, {_ID}, d.section, d.chunk_type, d.source_text, coalesce(o.status, 'PENDING'), o.translated, s is not null, s from {_DRAFTS} d semi join {_GO} g using (job_id)
 left join {_OLD} o on o.job_id = d.job_id and o.chunk_index = d.chunk_index
 left join (select job_id, chunk_index, array_to_string(list(message order by f), '；') s from (select job_id, chunk_index, message, min(nth) f from {_FIRST} group by 1, 2, 3) group by 1, 2) r on r.job_id = d.job_id and r.chunk_index = d.chunk_index""")
def persisted_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stored chunks after the commit: of refused jobs the old ones, of applied ones the
    drafts, with the names, states and translations of those that were there."""
    return _stored(spark, sf_dir)[0].snapshot().table("chunks")


@query(f"""select job_id, chunk_index, chunk_id, null risk_id, risk_type, message, severity, null source_excerpt from {_OLD_RISKS} where job_id not in {_GO}
 union all select job_id, chunk_index, chunk_id, {_name_uuid('risk', "job_id || ':' || chunk_id || ':' || risk_type || ':' || message")}, risk_type, message, 'MEDIUM', left(source_text, 500)
 from (select d.job_id, d.chunk_index, {_ID} chunk_id, d.source_text, f.risk_type, f.message from {_FIRST} f join {_DRAFTS} d on d.job_id = f.job_id and d.chunk_index = f.chunk_index semi join {_GO} g on g.job_id = d.job_id left join {_OLD} o on o.job_id = d.job_id and o.chunk_index = d.chunk_index)""")
def persisted_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir)[0].snapshot().table("risks")


@query(f"""select j.job_id, case when n is null then status else 'PARSED' end status, case when n is null then stage else 'split_sections' end stage, coalesce(n, 0)::bigint total_chunks
 from {A.JOBS} j left join (select job_id, count(*) n from {_DRAFTS} where job_id in {_GO} group by 1) d using (job_id)""")
def persisted_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir)[0].snapshot().table("jobs")


_LIVE = f"(select j.user_id, count(*) live from {A.QUEUE} q join {A.JOBS} j using (job_id) where q.status = 'LEASED' and q.lease_expires_at >= {_NOW} group by 1)"
_CLAIMS = f"""(select c.job_id, 'w' || s_suppkey worker from (select *, row_number() over (order by priority desc, created_at, job_id) n from (
 select q.job_id, q.priority, q.created_at, coalesce(live, 0) live, row_number() over (partition by j.user_id order by q.priority desc, q.created_at, q.job_id) nth from {A.QUEUE} q join {A.JOBS} j using (job_id) left join {_LIVE} l on l.user_id = j.user_id
 where q.available_at <= {_NOW} and (q.status = 'QUEUED' or q.lease_expires_at < {_NOW})) where nth <= 5 - live) c join (select s_suppkey, row_number() over (order by s_suppkey) n from supplier) w using (n))"""


@query(f"""select q.job_id, case when worker is null then q.status else 'LEASED' end status, coalesce(worker, lease_owner) lease_owner, case when worker is null then lease_expires_at else {_NOW} + interval 30 minutes end lease_expires_at
 from {A.QUEUE} q left join {_CLAIMS} c using (job_id)""")
def queue_after_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored queue after every supplier has claimed a job, in the order of their keys."""
    store = seeded(spark, {"jobs": A.jobs(spark, sf_dir).select("job_id", "user_id"), "queue": A.queue(spark, sf_dir)})
    workers = Q.ranked(A.table(spark, sf_dir, "supplier").select("s_suppkey"), [F.col("s_suppkey")]).select(F.concat(F.lit("w"), "s_suppkey").alias("owner"), F.col("rank").alias("turn"))
    Q.claim(store, workers, _now())
    return store.snapshot().table("queue").select("job_id", "status", "lease_owner", "lease_expires_at")
