"""Deterministic checks of source and translation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as C
from ..functions import ids
from ..functions import text as X

FINDING = "array<struct<risk_type:string,message:string,severity:string>>"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _finding(kind: Column | str, message: str) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("risk_type"), F.lit(message).alias("message"), F.lit("HIGH").alias("severity"))


def sequences_differ(source: Column, translated: Column, pattern: str) -> Column:
    """Whether the ordered lists of matches differ."""
    return ~_all(source, pattern).eqNullSafe(_all(translated, pattern))


def sequence_findings(source: Column, translated: Column) -> Column:
    tests = {"NUMBER_MISMATCH": C.NUMBER, "FORMULA_MISMATCH": C.FORMULA, "CITATION_MISMATCH": C.CITATION}
    return F.array_compact(F.array(*(F.when(sequences_differ(source, translated, p), _finding(k, C.SEQUENCE_MESSAGES[k])) for k, p in tests.items())))


def table_lines(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\r?\n"), lambda x: F.startswith(F.regexp_replace(x, f"^{C.SPACE}+", ""), F.lit("|"))))


def marker_count(text: Column, marker: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(marker), F.lit("")))


def profile(chunk_type: Column, source: Column) -> Column:
    return F.when(chunk_type.isin("TABLE", "FORMULA"), F.lower(chunk_type)).when(source.rlike(C.CITATION), "reference").otherwise("text")


def structure_findings(kind: Column, source: Column, translated: Column) -> Column:
    """The one check of a chunk's profile."""
    table = (kind == "table") & (table_lines(source) != table_lines(translated))
    formula = (kind == "formula") & (marker_count(source, "$") != marker_count(translated, "$"))
    reference = (kind == "reference") & (marker_count(source, "[") != marker_count(translated, "["))
    types = {"TABLE": table, "FORMULA": formula, "REFERENCE": reference}
    return F.array_compact(F.array(*(F.when(t, _finding(C.ISSUE_TYPES[k], C.STRUCTURE_MESSAGES[k])) for k, t in types.items())))


def issue_type(name: Column) -> Column:
    return X.lookup(F.upper(name), C.ISSUE_TYPES, F.lit("OMISSION"))


def protected(chunk_type: Column, source: Column, flagged: Column) -> Column:
    """Chunks that are never translated."""
    contact = (chunk_type == "TABLE") & (X.distinct_emails(F.coalesce(source, F.lit(""))) >= 2)
    return F.coalesce(flagged, F.lit(False)) | chunk_type.isin("FORMULA", "PICTURE", "CODE") | contact


def findings(pairs: DataFrame, issues: Column | None = None) -> DataFrame:
    """Findings of each pair (chunk_id, chunk_type, source_text, translated_text) in the order
    deterministic, structural, model."""
    s, t = F.col("source_text"), F.col("translated_text")
    model = F.array().cast(FINDING)
    if issues is not None:
        model = F.transform(issues, lambda i: F.struct(issue_type(i["type"]).alias("risk_type"), i["message"].alias("message"), i["severity"].alias("severity")))
    every = F.concat(sequence_findings(s, t), structure_findings(profile(F.col("chunk_type"), s), s, t), model)
    return pairs.select("chunk_id", F.posexplode(every).alias("nth", "f")).select("chunk_id", "nth", "f.*")


def new_risks(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Findings that aren't stored yet; repeats within the batch stay."""
    fresh = found.join(stored.select("chunk_id", "risk_type", "message").distinct(), ["chunk_id", "risk_type", "message"], "left_anti")
    return fresh.withColumn("risk_id", ids.name_uuid("risk", F.col("chunk_id"), F.col("risk_type"), F.col("message")))


def high_risk(new: DataFrame) -> DataFrame:
    """Chunks with a new risk of high severity."""
    return new.groupBy("chunk_id").agg(F.bool_or(F.col("severity") == "HIGH").alias("high_risk"))


def risk_summary(new: DataFrame) -> DataFrame:
    messages = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("nth", "message"))), lambda m: m["message"]))
    return new.groupBy("chunk_id").agg(F.array_join(messages, "；").alias("risk_summary"))


def outputs_valid(jobs: DataFrame, files: DataFrame, needed: list[str]) -> DataFrame:
    """Whether each job has all needed outputs, none of them empty; files have job_id, name, length."""
    good = files.where((F.col("length") > 0) & F.col("name").isin(*needed)).groupBy("job_id").agg(F.countDistinct("name").alias("n"))
    return jobs.select("job_id").join(good, "job_id", "left").select("job_id", (F.coalesce("n", F.lit(0)) == len(needed)).alias("valid"))


def upload_errors(requests: DataFrame) -> DataFrame:
    """The first failed check of an upload, or null; what isn't given fails its check."""
    requests = requests.fillna("", ["filename", "mode", "ocr_mode", "target_language"])
    suffix = F.lower(F.regexp_extract("filename", r"(\.[^./\\]+)$", 1))
    error = (
        F.when(~suffix.isin(*C.UPLOAD_SUFFIXES), "UNSUPPORTED_FILE")
        .when(~F.col("mode").isin(*C.MODES), "INVALID_MODE")
        .when(~F.col("ocr_mode").isin(*C.OCR_MODES), "INVALID_OCR_MODE")
        .when(~F.col("target_language").isin(*C.TARGET_LANGUAGES), "INVALID_LANGUAGE")
        .when(F.col("bytes") > C.MAX_UPLOAD_BYTES, "FILE_TOO_LARGE")
    )
    return requests.withColumn("error", error)
