"""Queue, recovery, ownership, retention and status transitions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed as C
from ..runtime import saved
from ..sources.versioned import Transaction, VersionedStore


def _live(queue: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """(user_id, live): leases that haven't expired; one that ends now is live still."""
    live = queue.where(F.col("status") == "LEASED").where(F.col("lease_expires_at") >= now).join(jobs.select("job_id", "user_id"), "job_id")
    return live.groupBy("user_id").agg(F.count(F.lit(1)).alias("live"))


def claimable(queue: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """Queue rows a worker may take: available, queued or with an expired lease, and their
    user below the limit of live leases."""
    rows = queue.join(jobs.select("job_id", "user_id"), "job_id").join(_live(queue, jobs, now), "user_id", "left")
    open_ = (F.col("status") == "QUEUED") | (F.col("lease_expires_at") < now)
    return rows.where((F.col("available_at") <= now) & open_ & (F.coalesce("live", F.lit(0)) < C.USER_LEASES)).drop("live")


def claim_order(rows: DataFrame, n: int = 1) -> DataFrame:
    """The first rows by priority, then age."""
    return rows.orderBy(F.desc("priority"), "created_at", "job_id").limit(n)


_ORDER = (F.desc, "priority"), (F.asc, "created_at"), (F.asc, "job_id")


def ranked(rows: DataFrame, order: list[Column], most: int | None = None) -> DataFrame:
    """Rows with ``rank`` (1, 2, 3, ...) in an order without ties, the first ``most`` if given.

    Rows are dealt into ranges and saved with the range's number; counts of earlier ranges, of
    which there are as many as shuffle partitions, are the offsets.  Ranges behind the cut are
    dropped before any row is numbered, and no task holds more than one range."""
    spark = rows.sparkSession
    dealt = saved(rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("rk_range", F.spark_partition_id()))
    counts = dealt.groupBy("rk_range").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("rk_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("rk_range", before.alias("rk_before"))
    if most is not None:
        offsets = offsets.where(F.col("rk_before") < most)
    inside = F.row_number().over(Window.partitionBy("rk_range").orderBy(*order))
    found = dealt.join(F.broadcast(offsets), "rk_range").withColumn("rank", F.col("rk_before") + inside).drop("rk_range", "rk_before")
    return found if most is None else found.where(F.col("rank") <= most)


def assigned(queue: DataFrame, jobs: DataFrame, claimants: DataFrame, now: Column) -> DataFrame:
    """(job_id, owner): what the claimants (owner, turn = 1, 2, 3, ...) get when they claim one
    after the other, each the first job that is open then.

    A user takes part with as many jobs as the limit leaves, the first by priority and
    age: a later one is open only once those are handed out, and then the limit is reached.
    So the claims of n workers are the first n of these jobs."""
    order = [way(c) for way, c in _ORDER]
    rows = claimable(queue, jobs, now).join(_live(queue, jobs, now), "user_id", "left")
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy(*order))
    # the bound by a constant lets each task send USER_LEASES rows a user at most
    rows = rows.withColumn("nth", nth).where(F.col("nth") <= C.USER_LEASES).where(F.col("nth") <= C.USER_LEASES - F.coalesce("live", F.lit(0)))
    n = claimants.agg(F.max("turn")).first()[0] or 0
    first = ranked(rows.select("job_id", "priority", "created_at"), order, n)
    return first.join(claimants.select(F.col("turn").cast("long").alias("rank"), "owner"), "rank").select("job_id", "owner")


def claim(store: VersionedStore, claimants: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    """Hands jobs of the store's queue to the claimants and writes their leases in one commit;
    gives (job_id, owner, lease_expires_at).

    Whoever claims on the same version and commits later begins again on the newer one, where
    the jobs are leased; so no job is handed out twice and no user gets more than
    the limit, however many claim at once."""

    def change(tx: Transaction) -> DataFrame:
        queue, jobs = tx.table("queue"), tx.table("jobs")
        until = now + F.make_interval(mins=F.lit(minutes))
        given = saved(assigned(queue, jobs, claimants, now).withColumn("lease_expires_at", until.cast(queue.schema["lease_expires_at"].dataType)))
        if given.limit(1).count():
            lease = given.select("job_id", F.lit("LEASED").alias("status"), F.col("owner").alias("lease_owner"), "lease_expires_at")
            if "updated_at" in queue.columns:
                lease = lease.withColumn("updated_at", now)
            kept = queue.drop(*(c for c in lease.columns if c != "job_id"))
            tx.replace("queue", kept.join(lease, "job_id").select(*(F.col(c).cast(queue.schema[c].dataType) for c in queue.columns)), given)
        return given

    return store.run(change, whole=("queue",))


#: Queued jobs that one worker counts, and strips of the queue, at most.
STRIP_ROWS, STRIPS = 200_000, 256


def dominated(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """For each point, the points with a smaller first value and a second one no larger, by
    halving the ranks of the second: O(n log n) on arrays."""
    order = np.argsort(first, kind="stable")
    ranks = np.unique(second, return_inverse=True)[1][order].astype(np.int64)
    high = np.searchsorted(first[order], first[order], "left")  # points before these count
    low, found, mine = np.zeros_like(high), np.zeros_like(high), ranks
    for bit in range(int(ranks.max(initial=0)).bit_length() - 1, -1, -1):
        ones = (ranks >> bit) & 1
        zeros = np.append(0, np.cumsum(1 - ones))
        z_low, z_high = zeros[low], zeros[high]
        up = ((mine >> bit) & 1) == 1
        found += np.where(up, z_high - z_low, 0)
        low, high = np.where(up, zeros[-1] + low - z_low, z_low), np.where(up, zeros[-1] + high - z_high, z_high)
        ranks = np.concatenate([ranks[ones == 0], ranks[ones == 1]])
    out = np.empty_like(found)
    out[order] = found + high - low
    return out


def _counted(rows: DataFrame, strip: str, first: str, second: str) -> DataFrame:
    """``dominated`` inside each strip."""

    def run(table: pa.Table) -> pa.Table:
        value = lambda c: table.column(c).cast(pa.int64()).to_numpy()
        counts = dominated(value(first), value(second))
        return pa.table([table.column("job_id"), pa.array(counts)], names=["job_id", "n"])

    return rows.groupBy(strip).applyInArrow(run, T.StructType([rows.schema["job_id"], T.StructField("n", T.LongType())]))


def queue_positions(queue: DataFrame) -> DataFrame:
    """One more than the queued jobs that are older and available no later; priority doesn't count.

    The queue is cut into strips of equal size by age and by availability.  Jobs of one's
    own strip by age are counted in it; those of older strips, in one's strip by
    availability, or by whole cells of both, which are few.  Each job is in two tasks."""
    queued = queue.where("status = 'QUEUED'").select("job_id", F.unix_micros(F.col("created_at").cast("timestamp")).alias("old"), F.unix_micros(F.col("available_at").cast("timestamp")).alias("due"))
    queued = saved(queued)
    n = queued.count()
    strips = max(1, min(STRIPS, -(-n // STRIP_ROWS)))

    def strip(column: str) -> Column:
        if strips == 1:
            return F.lit(0)
        cuts = sorted(set(queued.approxQuantile(column, [k / strips for k in range(1, strips)], 0.1 / strips)))
        return F.size(F.filter(F.array(*(F.lit(int(c)) for c in cuts)), lambda c: c < F.col(column)))

    rows = saved(queued.withColumns({"by_age": strip("old"), "by_due": strip("due")}))
    inside = _counted(rows, "by_age", "old", "due")
    if strips == 1:
        return inside.select("job_id", (1 + F.col("n")).alias("position"))
    cells = rows.groupBy("by_age", "by_due").agg(F.count(F.lit(1)).alias("n"))
    a, b = cells.alias("a"), cells.alias("b")
    older = F.expr("b.by_age < a.by_age and b.by_due < a.by_due")
    whole = a.join(F.broadcast(b), older, "left").groupBy("a.by_age", "a.by_due").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("whole"))  # STRIPS ** 2 rows at most
    beside = _counted(rows, "by_due", "by_age", "due").withColumnRenamed("n", "beside")
    out = rows.join(F.broadcast(whole), ["by_age", "by_due"]).join(inside, "job_id").join(beside, "job_id")
    return out.select("job_id", (1 + F.col("n") + F.col("beside") + F.col("whole")).alias("position"))


def unqueued(jobs: DataFrame, queue: DataFrame, active: list[str]) -> DataFrame:
    return jobs.where(F.col("status").isin(*active)).join(queue.select("job_id"), "job_id", "left_anti")


def enqueue(queue: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert: the higher priority stays, the lease is cleared."""
    q, n = queue.alias("q"), new.alias("n")
    rows = q.join(n, F.expr("q.job_id = n.job_id"), "full_outer")
    touched = F.col("n.job_id").isNotNull()
    return rows.select(
        F.coalesce("q.job_id", "n.job_id").alias("job_id"),
        F.when(touched, "QUEUED").otherwise(F.col("q.status")).alias("status"),
        F.when(touched, F.greatest(F.coalesce("q.priority", F.lit(0)), "n.priority")).otherwise(F.col("q.priority")).alias("priority"),
        F.when(~touched, F.col("q.lease_owner")).alias("lease_owner"),
    )


def owned(jobs: DataFrame, user_id: Column) -> DataFrame:
    """Jobs of one user; another's are as if they weren't there."""
    return jobs.where(F.col("user_id") == user_id)


def expired(jobs: DataFrame, now: Column) -> DataFrame:
    """Finished jobs past their retention: files go, rows stay with their keys cleared."""
    return jobs.where(F.col("status").isin(*C.FINAL) & (F.col("expires_at") <= now))


def cleaned(jobs: DataFrame, now: Column, keys: list[str]) -> DataFrame:
    gone = F.col("status").isin(*C.FINAL) & (F.col("expires_at") <= now)
    return jobs.withColumns({k: F.when(~F.coalesce(gone, F.lit(False)), F.col(k)) for k in keys})


def allowed(jobs: DataFrame, action: str) -> DataFrame:
    """Jobs that the action may be applied to."""
    test = {"cancel": F.col("status").isin(*C.CANCELLABLE), "resume": F.col("status") == "FAILED", "edit": F.col("status").isin(*C.FINAL)}
    return jobs.where(test[action])


def resumed_status(stage: Column) -> Column:
    """Status of a job that is resumed at a stage."""
    before = ["split_sections", "extract_terms", "interrupt_for_term_review", "pretranslate_sample", "interrupt_for_style_review"]
    return F.when(stage == "parse_document", "UPLOADED").when(stage.isin(*before), "PARSED").otherwise("TRANSLATING")


def last_seen(after: Column, header: Column) -> Column:
    """Cursor of an event reader: the parameter wins over the header."""
    return F.coalesce(after.cast("long"), header.try_cast("long"))


def get_or_create(reviews: DataFrame, wanted: DataFrame) -> DataFrame:
    """Reviews that aren't there yet, one for each (job, type, subject)."""
    key = ["job_id", "review_type", "subject_id"]
    return wanted.dropDuplicates(key).join(reviews.select(*key), key, "left_anti")


def allowed_models(requests: DataFrame, catalog_json: Column) -> DataFrame:
    """Requests whose model is in a JSON array of allowed ones (empty allows all)."""
    allowed_ = F.from_json(catalog_json, "array<string>")
    return requests.where((F.size(allowed_) == 0) | F.array_contains(allowed_, F.col("model")))
