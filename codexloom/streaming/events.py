"""Workflow events: appending, tailing, timelines and state carried along chunks."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas


def numbered(events: DataFrame, last: int) -> DataFrame:
    """Events of one writer with the sequence numbers that follow ``last``.

    Numbers are dense per batch: rows are ranked inside hash-free ranges of time, and
    each range is offset by the counts of earlier ranges, so no task sorts all rows."""
    rows = events.withColumn("range", F.date_trunc("hour", "created_at"))
    per = rows.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = per.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("range").orderBy("created_at", "job_id", "node"))
    return rows.withColumn("rank", rank).join(before.select("range", "before"), "range").withColumn("event_seq", F.col("rank") + F.col("before") + last).drop("rank", "range", "before")


def append(events: DataFrame, path: str) -> None:
    events.select(*(F.col(f.name).cast(f.dataType) for f in schemas.EVENT.fields)).write.mode("append").parquet(path)


def after(events: DataFrame, cursor: int) -> DataFrame:
    """Batch twin of ``tail``: events behind the cursor, in order."""
    return events.where(F.col("event_seq") > cursor).orderBy("event_seq", "created_at")


def tail(spark: SparkSession, path: str, cursor: int = 0, job_id: int | None = None) -> DataFrame:
    """A stream of the events behind the cursor as files arrive."""
    rows = spark.readStream.schema(schemas.EVENT).option("maxFilesPerTrigger", 100).parquet(path)
    rows = rows.where(F.col("event_seq") > cursor)
    return rows if job_id is None else rows.where(F.col("job_id") == job_id)


def collect_available(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes what is there now to a Parquet folder, exactly once, and ends."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def timeline(events: DataFrame) -> DataFrame:
    """Runs of each node of a job: started, ended, failed, interrupted, and elapsed time."""
    count = lambda s: F.count_if(F.col("status") == s)
    return events.groupBy("job_id", "node").agg(count("STARTED").alias("started"), count("COMPLETED").alias("completed"), count("FAILED").alias("failed"), count("INTERRUPTED").alias("interrupted"), F.sum("elapsed_ms").alias("elapsed_ms"))


def stream_timeline(stream: DataFrame, delay: str = "30 minutes", width: str = "1 hour") -> DataFrame:
    """Events by node and window of time; late ones are counted until the watermark passes."""
    return stream.withWatermark("created_at", delay).groupBy(F.window("created_at", width), "node").agg(F.count(F.lit(1)).alias("events"), F.sum("elapsed_ms").alias("elapsed_ms"))


def carried_context(chunks: DataFrame, summarise) -> DataFrame:
    """The summary of the chunk before, carried along each job in order.

    ``summarise(source, previous)`` is any Python function; jobs are independent and run
    in parallel, the chunks of one in sequence.  A partition holds whole jobs, sorted, so
    one pass carries the state and nothing is gathered."""

    def run(batches):
        job, previous = None, None
        for batch in batches:
            jobs, out = batch.column("job_id").to_pylist(), []
            for now, source in zip(jobs, batch.column("source_text").to_pylist(), strict=True):
                previous = summarise(source, previous if now == job else None)
                job = now
                out.append(previous)
            yield pa.RecordBatch.from_arrays([batch.column("job_id"), batch.column("chunk_index"), pa.array(out, pa.string())], names=["job_id", "chunk_index", "summary"])

    rows = chunks.select("job_id", F.col("chunk_index").cast("int").alias("chunk_index"), "source_text")
    return rows.repartition("job_id").sortWithinPartitions("job_id", "chunk_index").mapInArrow(run, "job_id long, chunk_index int, summary string")


def stream_context(stream: DataFrame, summarise) -> DataFrame:
    """``carried_context`` on a stream of chunks that arrive in order: the last summary of a
    job is the state of its key."""

    def run(key, frames, state):
        previous = state.get[0] if state.exists else None
        for frame in frames:
            out = []
            for source in frame.sort_values("chunk_index")["source_text"]:
                previous = summarise(source, previous)
                out.append(previous)
            yield pd.DataFrame({"job_id": key[0], "chunk_index": sorted(frame["chunk_index"]), "summary": out})
        state.update((previous,))

    return stream.select("job_id", "chunk_index", "source_text").groupBy("job_id").applyInPandasWithState(run, "job_id long, chunk_index int, summary string", "summary string", "append", "NoTimeout")


def expired_leases(stream: DataFrame, minutes: int = 30) -> DataFrame:
    """The last heartbeat of each lease and when it runs out."""
    return stream.groupBy("job_id").agg(F.max("created_at").alias("beat")).withColumn("expires_at", F.col("beat") + F.make_interval(mins=F.lit(minutes)))
