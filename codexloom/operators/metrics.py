"""Budgets, progress, reports, versions and memories: aggregations over satellite tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as C
from ..functions import ids
from ..functions import text as X


def budget_check(jobs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Spent tokens and cost of each job, and whether a limit is reached (0 is no limit)."""
    spent = metrics.groupBy("job_id").agg(F.sum("total_tokens").alias("tokens"), F.sum("cost").alias("cost"))
    rows = jobs.join(spent, "job_id", "left").withColumns({"tokens": F.coalesce("tokens", F.lit(0)), "cost": F.coalesce("cost", F.lit(0.0))})
    over = ((F.col("max_tokens") > 0) & (F.col("tokens") >= F.col("max_tokens"))) | ((F.col("max_cost") > 0) & (F.col("cost") >= F.col("max_cost")))
    return rows.select("job_id", "tokens", F.round("cost", 2).alias("cost"), over.alias("exhausted"))


def progress(chunks: DataFrame) -> DataFrame:
    rows = chunks.groupBy("job_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "COMPLETED").alias("completed"))
    return rows.withColumn("percent", F.when(F.col("total") > 0, F.col("completed") * 100.0 / F.col("total")).otherwise(0.0))


def eta_seconds(jobs: DataFrame, metrics: DataFrame) -> DataFrame:
    """0 when nothing is left, null without timings, else remaining times the median."""
    timed = metrics.where("chunk_id is not null and elapsed_ms > 0").groupBy("job_id").agg(F.median("elapsed_ms").alias("median"))
    left = F.col("total") - F.col("completed")
    eta = F.when(left <= 0, F.lit(0)).otherwise((left * F.col("median") / 1000).cast("long") + C.ETA_EXTRA_S)
    return jobs.join(timed, "job_id", "left").select("job_id", eta.cast("long").alias("eta_s"))


def report_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("job_id").agg(*(F.sum(c).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens", "elapsed_ms", "retry_count")))


def metric_cost(prompt: Column, completion: Column, price_in: float, price_out: float) -> Column:
    return prompt * price_in / 1e6 + completion * price_out / 1e6


def next_number(rows: DataFrame, key: str, number: str) -> DataFrame:
    """One more than the highest number of each key."""
    return rows.groupBy(key).agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next_no"))


def numbered(new: DataFrame, old: DataFrame, key: str, order: str, number: str = "version_no") -> DataFrame:
    """New rows with the numbers that follow those of their key."""
    highest = old.groupBy(key).agg(F.max(number).alias("highest"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return new.join(highest, key, "left").withColumn(number, F.coalesce("highest", F.lit(0)) + rank).drop("highest")


def latest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in descending order (a grouped limit, not a sort of all)."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(o) if isinstance(o, str) else o for o in order)))
    return rows.withColumn("rank", rank).where("rank = 1").drop("rank")


def next_pending(chunks: DataFrame) -> DataFrame:
    open_ = chunks.where(F.col("status").isin("PENDING", "FAILED"))
    return open_.groupBy("job_id").agg(F.min("chunk_index").alias("chunk_index"))


def section_summaries(chunks: DataFrame, n: int = 3) -> DataFrame:
    """The last ``n`` summaries before each chunk in its section, oldest first."""
    # Each summary takes the ones before it along; a chunk reads the last one before it.
    own = Window.partitionBy("job_id", "section", F.col("summary").isNull()).orderBy("chunk_index")
    tail = F.array(*(F.lag("summary", k).over(own) for k in range(n - 1, 0, -1)), "summary")
    rows = chunks.select("job_id", "section", "chunk_index", F.when(F.col("summary").isNotNull(), tail).alias("tail"))
    before = Window.partitionBy("job_id", "section").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last("tail", ignorenulls=True).over(before)
    return rows.select("job_id", "section", "chunk_index", F.nullif(F.array_join(F.filter(last, lambda s: s.isNotNull() & (s != "")), "\n"), F.lit("")).alias("summary"))


#: Rows of a section that can reach into a suffix; each has a character and a line break.
_SUFFIX_ROWS = 1000


def chapter_memory(chunks: DataFrame, limit: int = 2000) -> DataFrame:
    """Summaries of a section joined, the last ``limit`` characters once there are two.

    Only the end of a section is moved: each task sends its last rows (a bound by a constant on
    the row number), and of those the ones go on that fewer than ``limit`` characters follow."""
    if limit > 2 * _SUFFIX_ROWS:
        raise ValueError(f"at most {2 * _SUFFIX_ROWS} characters are kept")
    key = ["job_id", "section"]
    summary = F.coalesce(F.nullif("summary", F.lit("")), F.left("translated", F.lit(300)))
    rows = chunks.where("translated is not null and translated <> ''").select(*key, "chunk_index", summary.alias("s"))
    counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("chunk_index", "s")).alias("last"))
    late = Window.partitionBy(*key).orderBy(F.desc("chunk_index"))
    ends = rows.withColumn("cm_rank", F.row_number().over(late)).where(F.col("cm_rank") <= _SUFFIX_ROWS).withColumn("s", F.right("s", F.lit(limit)))
    behind = F.coalesce(F.sum(F.length("s") + 1).over(late.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ends.withColumn("cm_behind", behind).where(F.col("cm_behind") < limit)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "s"))), lambda x: x["s"])
    found = ends.groupBy(*key).agg(F.array_join(listed, "\n").alias("all"), F.count(F.lit(1)).alias("kept")).join(counts, key)
    joined = F.concat(F.when(F.col("n") > F.col("kept"), "\n").otherwise(""), "all")
    return found.select(*key, ids.name_uuid("chapter", F.col("job_id"), F.col("section")).alias("chapter_id"), F.when(F.col("n") == 1, F.col("last.s")).otherwise(F.right(joined, F.lit(limit))).alias("summary"))


def entity_memory(mentions: DataFrame) -> DataFrame:
    """One row per entity: last translation, last note that isn't empty, first and last chunk."""
    rows = mentions.withColumn("entity_type", F.upper("entity_type")).where(F.col("entity_type").isin(*C.ENTITY_TYPES))
    at = F.struct("chunk_index", "nth")
    noted = F.when(F.coalesce("note", F.lit("")) != "", at)
    return rows.groupBy("job_id", "entity_type", "source_name").agg(
        F.max_by("translated_name", at).alias("translated_name"), F.max_by("note", noted).alias("note"), F.min("chunk_index").alias("first_chunk"), F.max("chunk_index").alias("last_chunk")
    )


def top_entities(memory: DataFrame, k: int = 100) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("last_chunk"), "entity_type", "source_name"))
    return memory.withColumn("rank", rank).where(F.col("rank") <= k)


def preview_sample(chunks: DataFrame, n: int = 2, limit: int = 3500) -> DataFrame:
    """The first ``n`` text chunks that are translated, joined and cut."""
    rank = F.row_number().over(Window.partitionBy("job_id").orderBy("chunk_index"))
    rows = chunks.where("chunk_type = 'TEXT' and not protected").withColumn("rank", rank).where(F.col("rank") <= n)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "source_text"))), lambda x: x["source_text"]), "\n\n")
    return rows.groupBy("job_id").agg(F.left(joined, F.lit(limit)).alias("sample"))


def chapter_ends(chunks: DataFrame) -> DataFrame:
    """Whether a chunk is the last of its section before another or the end."""
    after = F.lead("section").over(Window.partitionBy("job_id").orderBy("chunk_index"))
    return chunks.select("job_id", "chunk_index", (~F.coalesce(after == F.col("section"), F.lit(False))).alias("chapter_end"))


def risk_types(risks: DataFrame, by_arrival: bool = True) -> DataFrame:
    """Risk types of each chunk: in order of arrival, or sorted."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("created_at", "risk_id", "risk_type"))), lambda r: r["risk_type"])
    types = F.array_distinct(listed) if by_arrival else F.sort_array(F.collect_set("risk_type"))
    return risks.groupBy("chunk_id").agg(types.alias("risk_types"))


def first_terms(suggestions: DataFrame) -> DataFrame:
    """First suggestion of each case-folded term of a job, by batch and place."""
    rows = suggestions.withColumn("key", X.casefold(F.col("source_term"))).where(F.trim("source_term") != "")
    rank = F.row_number().over(Window.partitionBy("job_id", "key").orderBy("batch", "nth"))
    kept = rows.withColumn("rank", rank).where("rank = 1")
    return kept.select("job_id", "key", "source_term", "suggested", ids.name_uuid("term", F.col("job_id"), F.col("source_term")).alias("term_id"))


def term_batches(documents: DataFrame, size: int = C.TERM_BATCH_CHARS) -> DataFrame:
    """Texts of each job cut into batches of ``size`` characters."""
    n = F.sequence(F.lit(0), F.floor((F.greatest(F.length("text"), F.lit(1)) - 1) / size).cast("int"))
    rows = documents.select("job_id", "text", F.explode(n).alias("batch"))
    return rows.select("job_id", "batch", F.substring("text", F.col("batch") * size + 1, F.lit(size)).alias("text"))


def glossary(terms: DataFrame) -> DataFrame:
    """Confirmed terms of a job as one map; of a term confirmed twice, the last in order."""
    kept = terms.where("confirmed and trim(confirmed_translation) <> ''")
    kept = kept.groupBy("job_id", "source_term").agg(F.max("confirmed_translation").alias("confirmed_translation"))
    pairs = F.array_sort(F.collect_list(F.struct("source_term", "confirmed_translation")))
    return kept.groupBy("job_id").agg(F.map_from_entries(pairs).alias("glossary"))


def unmatched_terms(stored: DataFrame, submitted: DataFrame) -> DataFrame:
    """Jobs whose submitted term ids aren't the stored ones, with the count of differences."""
    s, t = stored.select("job_id", "term_id", F.lit(1).alias("a")), submitted.select("job_id", "term_id", F.lit(1).alias("b"))
    both = s.join(t, ["job_id", "term_id"], "full_outer").where("a is null or b is null")
    return both.groupBy("job_id").agg(F.count(F.lit(1)).alias("unmatched"))


def replay_evaluation(records: DataFrame) -> DataFrame:
    chunks = records.where("recordType = 'chunk'")
    return chunks.agg(
        F.count(F.lit(1)).alias("chunks"),
        F.coalesce(F.avg((F.col("status") == "COMPLETED").cast("double")), F.lit(0.0)).alias("completion_rate"),
        F.coalesce(F.avg((F.size("riskTypes") > 0).cast("double")), F.lit(0.0)).alias("risk_rate"),
        F.coalesce(F.sum("revisionCount"), F.lit(0)).alias("revisions"),
    )


def backfill_versions(chunks: DataFrame, jobs: DataFrame) -> DataFrame:
    """First version of each translated chunk, dated by the first timestamp there is."""
    rows = chunks.where("translated is not null").join(jobs.withColumnRenamed("created_at", "job_created_at"), "job_id")
    return rows.select("job_id", "chunk_id", F.lit(1).alias("version_no"), F.coalesce("completed_at", "updated_at", "created_at", "job_created_at").alias("created_at"))
