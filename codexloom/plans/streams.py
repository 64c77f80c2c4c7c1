"""Queries over streams with state: files written to the shared folder and streamed once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import events as E
from ..streaming import state as S
from . import adapters as A
from .documents import _stream_dir
from .registry import ORACLE, query

#: Minutes of a lease here: three days, as the table's events of a user are days apart.
LEASE_MINUTES = 3 * 24 * 60


def streamed(spark: SparkSession, rows: DataFrame, change) -> DataFrame:
    """``change`` of the rows as a stream of files, run until all are read."""
    root = _stream_dir(spark)
    rows.write.parquet(f"{root}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{root}/in").schema).parquet(f"{root}/in")
    with S.rocksdb(spark):
        E.collect_available(change(stream), f"{root}/out", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out")


@query(f"""with e as (select job_id, event_seq, epoch_us(created_at) t, status = 'COMPLETED' done from {A.EVENTS} where job_id is not null and created_at is not null),
 l as (select *, lag(t) over (partition by job_id order by t, event_seq) t0, lag(done) over (partition by job_id order by t, event_seq) done0 from e),
 r as (select *, sum(case when t0 is null or done0 or t - t0 > {LEASE_MINUTES * 60_000_000} then 1 else 0 end) over (partition by job_id order by t, event_seq) nth from l),
 g as (select job_id, nth, min(t) t1, max(t) t2, max(t) + {LEASE_MINUTES * 60_000_000} t3, bool_or(done) done from r group by 1, 2)
 select job_id, 'LEASED' state, 'w' || job_id "owner", t1 "at" from g
 union all select job_id, 'RELEASED', 'w' || job_id, t2 from g where done
 union all select job_id, 'EXPIRED', 'w' || job_id, t3 from g where not done and t3 // 1000 + 1 <= (select max(t) // 1000 from e)""")
def lease_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event claims its job, or renews the lease; a completion releases it."""
    rows = A.events(spark, sf_dir).withColumn("created_at", F.col("created_at").cast("timestamp"))
    kinds = F.array(F.lit("CLAIM"), F.lit("BEAT"), F.when(F.col("status") == "COMPLETED", "RELEASE"))
    rows = rows.select("job_id", F.concat(F.lit("w"), "job_id").alias("owner"), "created_at", "event_seq", F.posexplode(F.array_compact(kinds)).alias("nth", "kind"))
    rows = rows.select("job_id", "kind", "owner", "created_at", (3 * F.col("event_seq") + F.col("nth")).alias("seq"))
    return streamed(spark, rows, lambda stream: S.lease_states(stream, LEASE_MINUTES))


@query(ORACLE["carried_context"])
def context_any_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of each job, dealt out by a hash of their texts."""
    rows = A.chunks(spark, sf_dir).select("job_id", "chunk_index", "source_text")
    rows = rows.repartition("source_text")
    return streamed(spark, rows, lambda stream: S.ordered_context(stream, lambda source, previous: f"{(previous or '')[-40:]}|{source[:20]}"))
