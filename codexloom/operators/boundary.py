"""Doubtful boundaries between blocks and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as C
from ..functions import text as X

SIGNALS = ("PAGE_BREAK", "INCOMPLETE_PUNCTUATION", "HYPHENATED_WORD", "LOWERCASE_CONTINUATION", "PARSER_WARNING")


def document_language(blocks: DataFrame) -> DataFrame:
    """Language of each document from the start of its text.  Only the blocks that reach
    the first 20,000 characters are gathered."""
    run = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = blocks.select("doc_id", "pos", "text", F.coalesce(F.sum(F.length("text") + 1).over(run), F.lit(0)).alias("before")).where("before < 20000")
    joined = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda b: b["text"]), "\n").alias("text"))
    return joined.select("doc_id", X.detect_language(F.col("text")).alias("language"))


def adjacent_pairs(blocks: DataFrame) -> DataFrame:
    """Neighbours in order, both of them texts (other kinds separate)."""
    after = Window.partitionBy("doc_id").orderBy("pos")
    right = F.lead(F.struct("block_id", "kind", "text", "page_no", "risks")).over(after)
    rows = blocks.select("doc_id", F.struct("pos", "block_id", "kind", "text", "page_no", "risks").alias("l"), right.alias("r"))
    return rows.where(F.col("l.kind").isin(*C.TEXT_KINDS) & F.col("r.kind").isin(*C.TEXT_KINDS))


def boundary_candidates(blocks: DataFrame) -> DataFrame:
    """Ambiguous boundaries with their signals and 800 characters of either side."""
    left, right = X.strip(F.col("l.text")), X.strip(F.col("r.text"))
    flags = {
        "PAGE_BREAK": F.coalesce(F.col("l.page_no") != F.col("r.page_no"), F.lit(False)),
        "INCOMPLETE_PUNCTUATION": ~left.rlike(C.SENTENCE_END),
        "HYPHENATED_WORD": left.rlike(C.WORD_HYPHEN),
        "LOWERCASE_CONTINUATION": right.rlike("^[a-z]"),
        "PARSER_WARNING": (F.coalesce(F.size("l.risks"), F.lit(0)) > 0) | (F.coalesce(F.size("r.risks"), F.lit(0)) > 0),
    }
    rows = adjacent_pairs(blocks).withColumns({f"s_{n}": f for n, f in flags.items()})
    s = {n: F.col(f"s_{n}") for n in SIGNALS}
    other = s["INCOMPLETE_PUNCTUATION"] | s["HYPHENATED_WORD"] | s["LOWERCASE_CONTINUATION"] | s["PARSER_WARNING"]
    found = rows.where((s["PAGE_BREAK"] & other) | (s["PARSER_WARNING"] & s["INCOMPLETE_PUNCTUATION"]))
    signals = F.array_compact(F.array(*(F.when(s[n], F.lit(n)) for n in SIGNALS)))
    return found.select("doc_id", F.col("l.block_id").alias("left_id"), F.col("r.block_id").alias("right_id"), F.right("l.text", F.lit(800)).alias("left"), F.left("r.text", F.lit(800)).alias("right"), F.col("l.page_no").alias("left_page"), F.col("r.page_no").alias("right_page"), signals.alias("signals"))


def fallback_decisions(candidates: DataFrame) -> DataFrame:
    """Every candidate undecided, when no model answers."""
    return candidates.select("doc_id", "left_id", "right_id", F.lit("UNCERTAIN").alias("decision"), F.lit(0.0).alias("confidence"))


def decided(candidates: DataFrame, decide) -> DataFrame:
    """Decisions of a pluggable rule or model column: ``decide(left, right, signals)``."""
    out = candidates.withColumn("d", decide(F.col("left"), F.col("right"), F.col("signals")))
    return out.select("doc_id", "left_id", "right_id", F.col("d.decision").alias("decision"), F.col("d.confidence").alias("confidence"))


def rule_decision(left: Column, right: Column, signals: Column) -> Column:
    """A deterministic stand-in for a model: a cut word or sentence continues."""
    joined = F.array_contains(signals, "HYPHENATED_WORD") | F.array_contains(signals, "LOWERCASE_CONTINUATION")
    decision = F.when(joined, "CONTINUE").when(F.array_contains(signals, "INCOMPLETE_PUNCTUATION"), "UNCERTAIN").otherwise("SPLIT")
    return F.struct(decision.alias("decision"), F.when(joined, 0.9).otherwise(0.5).alias("confidence"))


def decision_risks(decisions: DataFrame) -> DataFrame:
    undecided = decisions.where("decision = 'UNCERTAIN'")
    return undecided.select("doc_id", "right_id", F.lit("CROSS_PAGE_UNCERTAIN").alias("risk_type"), F.lit("MEDIUM").alias("severity"))


def cross_chunk_suspicion(chunks: DataFrame) -> DataFrame:
    """Chunks that may cut a sentence of the chunk right before (index less one)."""
    order = Window.partitionBy("doc_id").orderBy("chunk_index")
    before = F.lag(F.struct("chunk_index", "source_text")).over(order)
    rows = chunks.withColumn("before", before).where(F.col("before.chunk_index") == F.col("chunk_index") - 1)
    left = F.regexp_replace("before.source_text", f"{C.SPACE}+$", "")
    right = F.regexp_replace("source_text", f"^{C.SPACE}+", "")
    cut = (left != "") & ~F.contains(F.lit(C.CLOSERS), F.right(left, F.lit(1))) & F.coalesce(F.col("boundary_reason").isin("TOKEN_HARD_LIMIT", "TOKEN_SOFT_LIMIT"), F.lit(False))
    return rows.where(right.rlike(r"^\p{Ll}") | cut).select("doc_id", "chunk_index", F.right(left, F.lit(800)).alias("left"), F.left(right, F.lit(800)).alias("right"))


def coherence_risks(suspects: DataFrame, answers: DataFrame) -> DataFrame:
    """Risks of suspected cuts, by a model's answers (doc_id, chunk_index, decision, error):
    a text that goes on over the cut is a high one, and a question without an answer is told.
    Both columns of an answer may be null, and a suspect may have none."""
    rows = suspects.select("doc_id", "chunk_index").join(answers.select("doc_id", "chunk_index", "decision", "error"), ["doc_id", "chunk_index"], "left")
    failed = F.col("error").isNotNull() | F.col("decision").isNull()
    kind = F.when(failed, "BOUNDARY_MODEL_FAILED").when(F.col("decision") == "CONTINUE", "SEMANTIC_DISCONTINUITY")
    severity = F.when(F.col("risk_type") == "SEMANTIC_DISCONTINUITY", "HIGH").otherwise("MEDIUM")
    rows = rows.withColumn("risk_type", kind).where("risk_type is not null")
    return rows.select("doc_id", "chunk_index", "risk_type", severity.alias("severity"), X.lookup(F.col("risk_type"), C.COHERENCE_MESSAGES).alias("message"))


def topics(rows: DataFrame, key: str, text: str, limit: int = 5) -> DataFrame:
    """The most frequent words of each text, then first ones first; null without words.
    Texts are dealt out once, and their words are counted where they are."""
    rows = rows.repartition(key)
    words = rows.select(key, F.posexplode_outer(X.tokens(F.col(text))).alias("at", "word"))
    kept = words.where(F.col("word").isNull() | ~F.col("word").isin(*C.STOPWORDS))
    counted = kept.where("word is not null").groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "first"))
    top = counted.withColumn("rank", rank).where(F.col("rank") <= limit)
    joined = top.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda t: t["word"]), ", ").alias("topic"))
    return rows.select(key).distinct().join(joined, key, "left")
