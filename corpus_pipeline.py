"""The corpus pipeline: quality rules, near-dedup, decontamination, secrets, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexloom.llm._shared import Stage, small, table
from codexloom.llm.decontaminate import decontaminate
from codexloom.llm.mixing import mix_sources
from codexloom.llm.near_dedup import near_duplicates
from codexloom.llm.quality_rules import apply_rules
from codexloom.llm.secret_scan import redact
from codexloom.runtime import ship


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows with their columns named by number, so that no name of an operator's own
    meets one of them, and the new name of each."""
    names = {c: f"in_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _named(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.select(*(F.col(new).alias(old) for old, new in names.items()))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a risk-controlled threshold rejects go.

    Null and empty texts fail the base rule; very long ones are judged whole; a null lang
    is a stratum of its own; repeated rows are judged alike, rows with a null id by the same
    cutoffs; an empty table stays empty; further columns stay as they are, whatever their
    names."""
    rows, names = _numbered(docs)
    judged = apply_rules(rows, table(spark, sf_dir, "labels"), rows.columns, names["text"], names["doc_id"], names["lang"])
    return _named(judged.where("kept"), names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of the smallest id.

    Rows without an id stay, as do empty and null texts.  Rows that repeat an id are one
    document: it stays or goes with all its texts, and of its rows of equal text one stays
    (the least of their other columns, written as JSON).  An empty table stays empty;
    further columns stay as they are, whatever their names."""
    ship(spark)
    rows, names = _numbered(docs)
    key, text = names["doc_id"], names["text"]
    stage = Stage(spark, "kept")
    found = near_duplicates(rows, key, text).where(F.col(key).isNotNull())
    keep = stage.save(found.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept")).where("kept").select(key, "n"))
    out = rows.join(small(keep.select(key)), key, "left_semi").select(rows.columns)
    if keep.where("n > 1").limit(1).count():
        several = small(keep.where("n > 1").select(key))
        row = F.struct(*rows.columns)
        one = out.join(several, key, "left_semi").groupBy(key, text).agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
        out = out.join(several, key, "left_anti").select(rows.columns).unionByName(one)
    return _named(out.unionByName(rows.where(F.col(key).isNull())), names)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go.

    Null and empty texts hold none; very long ones are searched whole; repeated rows and
    rows with null ids are judged by their text; an empty table stays empty, and with an
    empty benchmark all stay; further columns stay as they are, whatever their names."""
    ship(spark)
    rows, names = _numbered(docs)
    found = decontaminate(rows, table(spark, sf_dir, "benchmark"), text_col=names["text"])
    return _named(found.where(F.size("spans") == 0), names)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, with secrets replaced by a mark and n_chars recounted.

    Null texts stay null (and so does their n_chars), very long ones are scanned whole;
    repeated rows each get the same text; an empty table stays empty; further columns stay
    as they are, whatever their names."""
    ship(spark)
    rows, names = _numbered(docs)
    clean = redact(rows, names["text"])
    if "n_chars" in names:
        clean = clean.withColumn(names["n_chars"], F.length(names["text"]).cast(docs.schema["n_chars"].dataType))
    return _named(clean, names)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with how often and where the mix has each (n_tokens, weight, copies,
    block, place; input columns of these names are replaced).

    A null source is a source of its own; null and empty texts have no tokens and come once
    a full pass; rows that repeat an id are all in or all out; an empty table stays empty;
    other further columns stay as they are, whatever their names."""
    return mix_sources(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("mixing", mixing),
]

#: Groups of near-duplicates by trees of hashed tokens, and mixing by hashed keys, aren't
#: expressible in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    stage = Stage(spark, "pipeline")
    for name, function in STAGES:
        docs = function(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stage.save(docs)
    return docs
