"""History of translations, edits, checkpoints, reviews and style confirmation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as C
from ..functions import text as X
from .metrics import latest, numbered


def recorded(history: DataFrame, writes: DataFrame, order: str) -> DataFrame:
    """Rows that writes (job_id, chunk_id, source_type, translated_text, edit_note and an
    order) append to the history: nothing stored changes, numbers go on within the chunk."""
    known = writes.where(F.col("source_type").isin(*C.VERSION_SOURCES))
    return numbered(known, history, "chunk_id", order).select("job_id", "chunk_id", "version_no", "source_type", "translated_text", "edit_note")


def _checked(chunks: DataFrame, jobs: DataFrame, requests: DataFrame, text: Column | None, more: DataFrame | None = None) -> DataFrame:
    """Requests (job_id, chunk_id, ...) with the old text of their chunk (ed_old) and why they
    are refused, or null; ``more`` has further columns by the requests' keys.

    The texts of chunks are long, so they go through the last join only.  ``text`` makes them
    of other columns of the chunks, which go through the joins in their place; the columns'
    names may not be those of the requests."""
    own = ["translated_text"] if text is None else [c for c in chunks.columns if c not in ("job_id", "chunk_id", "status", "revision_count", "translated_text")]
    c = chunks.select("job_id", "chunk_id", F.col("status").alias("ed_status"), F.col("revision_count").alias("ed_count"), *own)
    j = jobs.select("job_id", F.col("status").alias("ed_job"))
    rows = requests.join(j, "job_id", "left")
    if more is not None:
        rows = rows.join(more, [k for k in requests.columns if k in more.columns], "left")
    rows = rows.join(c, ["job_id", "chunk_id"], "left").withColumn("ed_old", F.col("translated_text") if text is None else text)
    refused = (
        F.when(F.col("ed_job").isNull() | F.col("ed_status").isNull(), "NOT_FOUND")
        .when(~F.col("ed_job").isin(*C.FINAL), "INVALID_STATE")
        .when((F.col("ed_status") != "COMPLETED") | (F.coalesce("ed_old", F.lit("")) == ""), "INVALID_STATE")
    )
    return rows.withColumn("refused", refused)


def _applied(rows: DataFrame, text: Column) -> DataFrame:
    ok = F.col("refused").isNull()
    return rows.select(
        "job_id", "chunk_id", "refused", F.when(ok, text).otherwise(F.col("ed_old")).alias("translated_text"), (F.col("ed_count") + ok.cast("int")).cast("long").alias("revision_count"), ok.alias("outputs_stale")
    )


def edited(chunks: DataFrame, jobs: DataFrame, edits: DataFrame, text: Column | None = None) -> DataFrame:
    """Outcome of a user's edits (job_id, chunk_id, new_text), one of a chunk: the new text,
    one more revision and stale outputs, or why it is refused and the old text.  Chunks have
    translated_text, or ``text`` makes it of their other columns, after the joins."""
    rows = _checked(chunks, jobs, edits, text)
    clean = X.strip(F.coalesce("new_text", F.lit("")))
    rows = rows.withColumn("refused", F.coalesce("refused", F.when(clean == "", "VALIDATION_ERROR")))
    return _applied(rows, clean)


def restored(chunks: DataFrame, jobs: DataFrame, history: DataFrame, wanted: DataFrame, text: Column | None = None) -> DataFrame:
    """Outcome of restoring versions (job_id, chunk_id, version_no), as ``edited`` gives it."""
    old = history.select("job_id", "chunk_id", "version_no", F.col("translated_text").alias("ed_text"))
    rows = _checked(chunks, jobs, wanted, text, old)
    rows = rows.withColumn("refused", F.coalesce("refused", F.when(F.col("ed_text").isNull(), "NOT_FOUND")))
    return _applied(rows, F.col("ed_text"))


def newest_first(history: DataFrame) -> DataFrame:
    return history.orderBy("job_id", "chunk_id", F.desc("version_no"))


def checkpoints(states: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row per state: the columns besides ``keys`` as a JSON snapshot, with the workflow's version."""
    rest = [c for c in states.columns if c not in keys]
    return states.select(*keys, F.to_json(F.struct(*rest, F.lit(version).alias("workflowVersion"))).alias("state_snapshot"))


def paused(jobs: DataFrame) -> DataFrame:
    """Jobs that wait for a person, with the stage at which the run has ended."""
    return jobs.where(F.col("status").isin(*C.RESUMED)).select("job_id", "status", X.lookup(F.col("status"), C.PAUSE_STAGES).alias("stage"))


def resumed(jobs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Waiting jobs that a decision (job_id, approved) lets go on, with their next status."""
    rows = paused(jobs).join(decisions.where("approved").select("job_id").distinct(), "job_id", "left_semi")
    return rows.select("job_id", X.lookup(F.col("status"), C.RESUMED).alias("status"))


def routes(parse_error: Column, parse_tries: Column, candidates: Column, boundary_failed: Column, boundary_tries: Column, high_risk: Column, review_wanted: Column, cancelled: Column, done: Column, valid: Column, output_tries: Column, most: int = 2) -> dict[str, Column]:
    """What follows each stage, from the state of a run."""
    return {
        "after_parse": F.when(~parse_error, "success").when(parse_tries <= most, "retry").otherwise("failed"),
        "boundary_analysis": F.when(candidates > 0, "analyze").otherwise("split"),
        "after_boundary_analysis": F.when(~boundary_failed, "normalize").when(boundary_tries <= most, "retry").otherwise("fallback"),
        "after_quality": F.when(high_risk & review_wanted, "review").otherwise("summarize"),
        "after_translation": F.when(cancelled, "cancelled").when(done, "outputs").otherwise("summarize"),
        "after_output_validation": F.when(valid, "report").when(output_tries <= most, "retry").otherwise("failed"),
    }


def styles_confirmed(jobs: DataFrame, previews: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Jobs (job_id, status, stage) with those that wait for a style and have one confirmed
    (job_id, style_prompt) going on to translation, and the preview that is accepted by it."""
    last = latest(previews, "job_id", "attempt_no").select("job_id", "attempt_no")
    rows = jobs.join(confirmed.select("job_id", F.col("style_prompt").alias("sc_style")), "job_id", "left").join(last, "job_id", "left")
    go = (F.col("status") == "WAITING_STYLE_REVIEW") & F.col("sc_style").isNotNull()
    return rows.select("job_id", F.when(go, "TRANSLATING").otherwise(F.col("status")).alias("status"), F.when(go, "translate_chunk").otherwise(F.col("stage")).alias("stage"), F.when(go, F.trim("sc_style")).alias("style_prompt"), F.when(go, F.col("attempt_no")).alias("accepted"))


def with_terms(chunks: DataFrame, glossary: DataFrame) -> DataFrame:
    """Each chunk with the confirmed terms of its job (job_id, glossary); an empty map without."""
    return chunks.join(glossary.select("job_id", "glossary"), "job_id", "left").withColumn("glossary", F.coalesce("glossary", F.create_map().cast("map<string,string>")))


def recent_chapters(chapters: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` chapters of each job that were updated last."""
    rank = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("updated_at"), "section"))
    return chapters.withColumn("rank", rank).where(F.col("rank") <= k)


def renewed(queue: DataFrame, beats: DataFrame, minutes: int = 30) -> DataFrame:
    """Leases after heartbeats (job_id, owner, at): only the owner's last beat renews one."""
    last = beats.groupBy("job_id", F.col("owner").alias("lease_owner")).agg(F.max("at").alias("rn_at"))
    rows = queue.join(last, ["job_id", "lease_owner"], "left")
    return rows.select("job_id", "lease_owner", F.coalesce(F.col("rn_at") + F.make_interval(mins=F.lit(minutes)), F.col("lease_expires_at")).alias("lease_expires_at"))


def released(queue: DataFrame, ended: DataFrame) -> DataFrame:
    """The queue without the rows whose owner has ended the job (job_id, owner)."""
    return queue.join(ended.select("job_id", F.col("owner").alias("lease_owner")), ["job_id", "lease_owner"], "left_anti")
