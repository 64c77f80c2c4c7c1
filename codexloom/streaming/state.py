"""Streams with state of their own: leases that run out by a timer, and context carried
along chunks that arrive in any order.

Both keep their state in the RocksDB state store, one a job for leases and one for the jobs
of a bucket for context; a query needs that store for them: ``rocksdb`` sets it for the queries that are started inside it."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_STORE, before)


class Leases(StatefulProcessor):
    """The lease of one job, with a timer at its end."""

    def __init__(self, minutes: int) -> None:
        self.length = minutes * 60_000_000

    def init(self, handle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "owner string, ends long")

    def handleInputRows(self, key, rows, timerValues):
        held = before = tuple(self.lease.get()) if self.lease.exists() else None
        for row in sorted(rows, key=lambda r: (r.at, r.seq)):  # those of one job in one micro-batch
            if held and held[1] < row.at:
                yield Row(job_id=key[0], state="EXPIRED", owner=held[0], at=held[1])
                held = None
            if row.kind == "CLAIM":
                if held is None:
                    held = row.owner, row.at + self.length
                    yield Row(job_id=key[0], state="LEASED", owner=row.owner, at=row.at)
            elif held and held[0] == row.owner:
                if row.kind == "RELEASE":
                    yield Row(job_id=key[0], state="RELEASED", owner=row.owner, at=row.at)
                    held = None
                elif row.kind == "BEAT":
                    held = row.owner, max(held[1], row.at + self.length)
        if held != before:
            if before:
                self.handle.deleteTimer(_timer(before[1]))
            if held:
                self.lease.update(held)
                self.handle.registerTimer(_timer(held[1]))
            else:
                self.lease.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.lease.exists():
            owner, ends = self.lease.get()
            if _timer(ends) <= expiredTimerInfo.getExpiryTimeInMs():
                self.lease.clear()
                yield Row(job_id=key[0], state="EXPIRED", owner=owner, at=ends)

    def close(self) -> None:
        pass


def _timer(ends: int) -> int:
    """The first millisecond at which a lease has ended: one that ends now is live still."""
    return ends // 1000 + 1


def lease_states(stream: DataFrame, minutes: int = 30, delay: str = "0 seconds") -> DataFrame:
    """(job_id, state, owner, at in microseconds) of a stream of (job_id, kind, owner, created_at, seq).

    CLAIM takes a job that is free, or whose lease has run out (LEASED); BEAT by the owner
    of a live lease moves its end; RELEASE by that owner clears it (RELEASED).  A lease
    whose end the watermark passes gives EXPIRED, so its job can be claimed again, whether
    or not another row of the job comes.  Other kinds, and rows of those who don't hold
    the lease, change nothing; rows with a null job, kind, owner or time are left out, and
    so are those behind the watermark."""
    rows = stream.where("job_id is not null and kind is not null and owner is not null and created_at is not null")
    rows = rows.withWatermark("created_at", delay).select("job_id", "kind", "owner", "created_at", F.unix_micros("created_at").alias("at"), F.coalesce(F.col("seq").cast("long"), F.lit(0)).alias("seq"))
    kind = stream.schema["job_id"].dataType.simpleString()
    return rows.groupBy("job_id").transformWithState(Leases(minutes), f"job_id {kind}, state string, owner string, at long", "append", "EventTime")


def lease_runs(beats: DataFrame, minutes: int, now: Column) -> DataFrame:
    """Batch twin for one worker a job: runs of (job_id, created_at, seq, release) rows, each of
    which claims the job if it is free and renews the lease if not."""
    order = Window.partitionBy("job_id").orderBy("created_at", "seq")
    length = F.lit(minutes * 60_000_000)
    rows = beats.withColumn("at", F.unix_micros("created_at")).withColumn("last", F.lag("at").over(order)).withColumn("left", F.lag("release").over(order))
    rows = rows.withColumn("starts", F.col("last").isNull() | F.col("left") | (F.col("at") - F.col("last") > length)).withColumn("run", F.count_if("starts").over(order))
    runs = rows.groupBy("job_id", "run").agg(F.min("at").alias("first"), F.max("at").alias("beat"), F.bool_or("release").alias("release"))
    ends = F.col("beat") + length
    over = F.col("release") | (F.floor(ends / 1000) + 1 <= F.floor(F.unix_micros(now) / 1000))
    states = F.array(
        F.struct(F.lit("LEASED").alias("state"), F.col("first").alias("at")),
        F.when(over, F.struct(F.when(F.col("release"), "RELEASED").otherwise("EXPIRED").alias("state"), F.when(F.col("release"), F.col("beat")).otherwise(ends).alias("at"))),
    )
    return runs.select("job_id", F.explode(F.array_compact(states)).alias("s")).select("job_id", "s.state", "s.at")


#: Keys of the state of ``ordered_context``: jobs are dealt out over these, as a key costs
#: several calls of the store and its jobs share them.
BUCKETS = 1 << 16


class Ordered(StatefulProcessor):
    """The next chunk of each job of a bucket, the summary before it, and the chunks that wait
    for it."""

    def __init__(self, summarise, first: int, kind: str) -> None:
        self.summarise, self.first, self.kind = summarise, first, kind

    def init(self, handle) -> None:
        self.places = handle.getValueState("places", f"job_id array<{self.kind}>, next array<int>, summary array<string>, waits array<int>")
        self.waiting = handle.getMapState("waiting", f"job_id {self.kind}, chunk_index int", "source_text string")

    def handleInputRows(self, key, rows, timerValues):
        found = self.places.get()  # null if there is none
        places = {job: place for job, *place in zip(*found, strict=True)} if found is not None else {}
        out, new, changed = Row("job_id", "chunk_index", "summary"), {}, False
        for _, job, at, source in rows:
            place = places.get(job)
            if place is None:
                place, changed = places.setdefault(job, [self.first, None, 0]), True
            n, previous, waits = place
            if at > n:
                new.setdefault(job, {}).setdefault(at, source)  # chunks of this micro-batch that wait
                continue
            if at < n:
                continue
            early = new.get(job, {})
            while True:
                previous = self.summarise(source, previous)
                yield out(job, n, previous)
                n += 1
                if waits and self.waiting.containsKey((job, n)):
                    (source,) = self.waiting.getValue((job, n))
                    self.waiting.removeKey((job, n))
                    early.pop(n, None)
                    waits -= 1
                elif n in early:
                    source = early.pop(n)
                else:
                    break
            place[:], changed = (n, previous, waits), True
        for job, early in new.items():
            place = places[job]
            waits = place[2]
            for at, source in early.items():
                if not (waits and self.waiting.containsKey((job, at))):
                    self.waiting.updateValue((job, at), (source,))
                    place[2], changed = place[2] + 1, True
        if changed:
            self.places.update((list(places), *map(list, zip(*places.values(), strict=True))))

    def close(self) -> None:
        pass


def ordered_context(stream: DataFrame, summarise, first: int = 0, buckets: int = BUCKETS) -> DataFrame:
    """``carried_context`` on a stream of chunks that arrive in any order.

    Chunks of a job are numbered from ``first`` without gaps.  One that comes early waits in
    the job's state until all before it are there; one that comes again is left out (the
    first to arrive counts), and so is a row with a null job or number.  Places of the jobs
    of one bucket are read and written together, whichever of them get chunks; a query
    keeps its number of buckets."""
    bucket = F.pmod(F.xxhash64("job_id"), F.lit(buckets)).cast("int").alias("bucket")
    rows = stream.where("job_id is not null and chunk_index is not null").select(bucket, "job_id", F.col("chunk_index").cast("int").alias("chunk_index"), "source_text")
    kind = stream.schema["job_id"].dataType.simpleString()
    return rows.groupBy("bucket").transformWithState(Ordered(summarise, first, kind), f"job_id {kind}, chunk_index int, summary string", "append", "None")
