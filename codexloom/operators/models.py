"""Calls of a language model: one client a partition, retries, routing, and stages on top.

A client is any object with ``chat(task, payload) -> str`` that several threads may call;
``make`` builds it (or a list of them, the later ones for when the first is down) on the
executor.  Rows that need no call are split off before, since a filter isn't pushed
through a Python function."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache, partial
from typing import TYPE_CHECKING, Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quality import profile, protected

if TYPE_CHECKING:
    from .ledger import Ledger

#: Calls of a partition that wait for an answer at the same time.
CALLS = 8

#: Seconds that rows may take in turn before threads take the rest: of a batch, and for each row.
BATCH_S, ROW_S = 0.05, 0.0002


class Client(Protocol):
    def chat(self, task: str, payload: dict) -> str: ...


class Transient(Exception):
    """An error that may pass: time-outs, connections, limits, server errors."""


class Rejected(Exception):
    """An error that no repetition mends."""


def with_retries(call: Callable[[], str], retries: int = 3, base: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """Repeats a transient failure with doubling pauses."""
    for attempt in range(retries + 1):
        try:
            answer = call()
            if not answer:
                raise Rejected("empty answer")
            return answer
        except Transient:
            if attempt == retries:
                raise
            sleep(base * 2**attempt)
    raise AssertionError


def fail_over(calls: list[Callable[[], str]], **options) -> str:
    """The first endpoint that answers."""
    for n, call in enumerate(calls):
        try:
            return with_retries(call, **options)
        except Transient:
            if n == len(calls) - 1:
                raise
    raise AssertionError


def model_for(task: str, overrides: dict[str, str], settings: dict[str, str], default: str, fallback: bool = False) -> str:
    """The override, else the setting of the task, else the default; a fallback has no other."""
    return default if fallback else overrides.get(task) or settings.get(task) or default


class EchoClient:
    """A deterministic stand-in for tests; what it returns is no translation."""

    def chat(self, task: str, payload: dict) -> str:
        text = payload.get("text") or payload.get("sourceChunk") or payload.get("source") or ""
        if task == "terms":
            words = [w for w in dict.fromkeys(text.split()) if w[:1].isupper() and len(w) > 3]
            return json.dumps({"terms": [{"sourceTerm": w, "suggestedTranslation": w.upper(), "note": None} for w in words[:5]]})
        if task == "quality":
            return json.dumps({"issues": []})
        if task == "memory":
            return json.dumps({"entities": []})
        if task == "summary":
            return text[:60]
        if task == "boundary":
            return json.dumps({"decision": "UNCERTAIN", "confidence": 0.0})
        return f"[{payload.get('targetLanguage', 'zh')}] {text}"


Make = Callable[[], "Client | list[Client]"]


def _asker(make: Make) -> Callable[[str, dict], str]:
    """A call to the first endpoint that answers; ``make`` gives one client or several."""
    made = make()
    clients = made if isinstance(made, list) else [made]
    if len(clients) == 1:
        chat = clients[0].chat
        return lambda task, payload: with_retries(partial(chat, task, payload))
    return lambda task, payload: fail_over([partial(c.chat, task, payload) for c in clients])


class Pool(ThreadPoolExecutor):
    """The threads of a partition, and whether its calls have had to be waited for."""

    def __init__(self) -> None:
        super().__init__(CALLS)
        self.waits = False


def each(pool: Pool, one: Callable, rows: list) -> list:
    """``one`` of every row, in their order.  Rows are taken in turn while answers come at
    once, since threads that don't wait only hinder each other; from the first that is waited
    for, each thread takes the next row when it is free, so a row costs no task of the pool.
    After an error no further rows are begun."""
    out: list = [None] * len(rows)
    left = iter(range(len(rows)))
    if not pool.waits:
        end = time.monotonic() + BATCH_S
        for n in left:
            out[n] = one(rows[n])
            if time.monotonic() > end + n * ROW_S:
                pool.waits = True
                break
        else:
            return out

    def work(_: int) -> None:
        try:
            for n in left:
                out[n] = one(rows[n])
        except BaseException:
            for _n in left:
                pass
            raise

    list(pool.map(work, range(min(CALLS, len(rows)))))
    return out


def _values(column: pa.Array) -> list:
    """The values of a column of strings; by way of numpy, as ``to_pylist`` makes a scalar of each."""
    return column.to_numpy(zero_copy_only=False).tolist()


def ask(rows: DataFrame, task: str, make: Make, payload: Column, key_cols: list[str], ledger: Ledger | None = None) -> DataFrame:
    """Adds ``answer`` and ``elapsed_ms`` to the key columns: one call a row, ``CALLS`` at a
    time in a partition.  The payload is a struct; a row without one (null) calls nothing.

    With a ledger, calls survive lost executors and further runs, and one that fails for good
    is a row with ``error``; without, it ends the job."""
    if ledger is not None:
        return ledger.ask(rows, task, make, payload, key_cols).select(*key_cols, "answer", "elapsed_ms", "error")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = _asker(make)

        def one(text: str | None) -> tuple[str | None, int]:
            began = time.monotonic()
            return (call(task, json.loads(text)) if text else None), int((time.monotonic() - began) * 1000)

        with Pool() as pool:
            for batch in batches:
                found = each(pool, one, _values(batch.column("md_payload")))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in key_cols), pa.array([x for x, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=[*key_cols, "answer", "elapsed_ms"])

    picked = rows.select(*key_cols, F.to_json(payload, {"ignoreNullFields": "false"}).alias("md_payload"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in picked.schema.fields if f.name in key_cols)
    return picked.mapInArrow(run, f"{fields}, answer string, elapsed_ms long")


_KEY = ["job_id", "chunk_index"]


def _has(rows: DataFrame, name: str, default: Column) -> Column:
    return F.coalesce(name, default) if name in rows.columns else default


def translation_payload(chunks: DataFrame, language: str = "zh", kind: Column | None = None) -> Column:
    """What a translation is asked with: the text, and of the terms, summaries, memory and
    style those that the chunks have as columns."""
    blank = F.lit("")
    terms = F.create_map().cast("map<string,string>")
    return F.struct(
        _has(chunks, "glossary", terms).alias("confirmedTerms"),
        _has(chunks, "section_summary", blank).alias("sectionSummary"),
        _has(chunks, "previous_summary", blank).alias("previousChunkSummary"),
        F.col("source_text").alias("sourceChunk"),
        _has(chunks, "story_memory", F.lit("{}")).alias("storyMemory"),
        (profile(F.col("chunk_type"), F.col("source_text")) if kind is None else kind).alias("translationProfile"),
        F.lit(language).alias("targetLanguage"),
        _has(chunks, "style_prompt", blank).alias("stylePrompt"),
    )


def translate(chunks: DataFrame, make: Make, language: str = "zh", ledger: Ledger | None = None) -> DataFrame:
    """Chunks (job_id, chunk_index, chunk_type, source_text, protected and what else
    ``translation_payload`` reads) with translated_text; protected ones keep their source
    and call nothing.  With a ledger also error, where there is no translation."""
    rows = chunks.withColumn("keep", protected(F.col("chunk_type"), F.col("source_text"), F.col("protected")))
    kept = rows.where("keep").select(*_KEY, F.col("source_text").alias("translated_text"))
    asked = ask(rows.where("not keep"), "translation", make, translation_payload(chunks, language), _KEY, ledger)
    told = ["error"] if ledger is not None else []
    return kept.unionByName(asked.select(*_KEY, F.col("answer").alias("translated_text"), *told), allowMissingColumns=True)


def summarised(chunks: DataFrame, make: Make, ledger: Ledger | None = None) -> DataFrame:
    """(job_id, chunk_index, summary) of translated chunks; with a ledger also error."""
    rows = chunks.where("translated_text <> ''")
    answers = ask(rows, "summary", make, F.struct(F.col("translated_text").alias("text")), _KEY, ledger)
    return answers.select(*_KEY, F.col("answer").alias("summary"), *(["error"] if ledger is not None else []))


def previewed(jobs: DataFrame, samples: DataFrame, previews: DataFrame, make: Make, language: str = "zh") -> DataFrame:
    """New attempts of previews (job_id, attempt_no, source_text, translated_text, style_prompt,
    status) for jobs that wait for a style: samples have job_id, sample and style_prompt."""
    wanted = jobs.where("status = 'WAITING_STYLE_REVIEW'").select("job_id").join(samples.where("sample <> ''"), "job_id")
    rows = wanted.select("job_id", F.col("sample").alias("source_text"), F.trim("style_prompt").alias("style_prompt"))
    answers = ask(rows, "translation", make, translation_payload(rows, language, F.lit("preview")), ["job_id", "source_text", "style_prompt"])
    highest = previews.groupBy("job_id").agg(F.max("attempt_no").alias("last"))
    out = answers.join(highest, "job_id", "left")
    return out.select("job_id", (F.coalesce("last", F.lit(0)) + 1).alias("attempt_no"), "source_text", F.col("answer").alias("translated_text"), "style_prompt", F.lit("DRAFT").alias("status"))


def extract_terms(batches: DataFrame, make: Make) -> DataFrame:
    """Suggestions (job_id, batch, nth, source_term, suggested) of text batches."""
    answers = ask(batches.where("text <> ''"), "terms", make, F.struct("text"), ["job_id", "batch"])
    parsed = F.from_json("answer", "terms array<struct<sourceTerm:string,suggestedTranslation:string,note:string>>", {"mode": "FAILFAST"})
    rows = answers.select("job_id", "batch", F.posexplode(parsed["terms"]).alias("nth", "t"))
    return rows.select("job_id", "batch", "nth", F.col("t.sourceTerm").alias("source_term"), F.col("t.suggestedTranslation").alias("suggested"))


@lru_cache(256)
def _issues(answer: str) -> list[dict]:
    """The issues of an answer; most answers are equal, as they find none."""
    return json.loads(answer)["issues"]


@lru_cache(8)
def _terms(text: str) -> dict[str, str]:
    """The terms of a job, which its chunks share."""
    return json.loads(text)


def revised(chunks: DataFrame, make: Make, attempts: int = 1) -> DataFrame:
    """Translated chunks (job_id, chunk_index, source_text, translated_text, glossary) after
    the check of a model: while it finds issues of high severity, and ``attempts`` times at
    most, the text is revised by them and checked again.  Adds the revisions made
    (revision_count), the checks (checks) and the issues of the last one."""
    issue = T.StructType([T.StructField(n, T.StringType()) for n in ("type", "message", "severity")])
    terms = _has(chunks, "glossary", F.create_map().cast("map<string,string>"))
    picked = chunks.where("translated_text <> ''").select(*_KEY, "source_text", "translated_text", F.to_json(terms).alias("terms"))
    schema = T.StructType([*(picked.schema[k] for k in _KEY), *(T.StructField(n, t) for n, t in (("translated_text", T.StringType()), ("revision_count", T.LongType()), ("checks", T.LongType()), ("issues", T.ArrayType(issue))))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = _asker(make)

        def one(row: tuple[str, str, str]) -> tuple[str, int, int, list[dict]]:
            source, text, known = row
            for done in range(attempts + 1):
                found = _issues(call("quality", {"source": source, "translation": text}))
                high = [dict(i) for i in found if str(i.get("severity", "")).upper() == "HIGH"]
                if not high or done == attempts:
                    return text, done, done + 1, [{n: i.get(n) for n in ("type", "message", "severity")} for i in found]
                text = call("revision", {"source": source, "translation": text, "issues": high, "confirmedTerms": dict(_terms(known))})
            raise AssertionError

        kind = pa.list_(pa.struct([(n, pa.string()) for n in ("type", "message", "severity")]))
        with Pool() as pool:
            for batch in batches:
                rows = list(zip(*(_values(batch.column(c)) for c in ("source_text", "translated_text", "terms")), strict=True))
                out = list(zip(*each(pool, one, rows), strict=True)) or [[]] * 4
                columns = [pa.array(c, k) for c, k in zip(out, (pa.string(), pa.int64(), pa.int64(), kind), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _KEY), *columns], names=schema.names)

    return picked.mapInArrow(run, schema)


def story_entities(chunks: DataFrame, make: Make, ledger: Ledger) -> DataFrame:
    """Entities (job_id, chunk_index, nth, entityType, sourceName, translatedName, note, error)
    that the model finds in translated chunks; a chunk whose call failed, or whose answer isn't
    of the form asked for, is a row with error and without an entity."""
    from .ledger import parsed

    rows = chunks.where("translated_text <> ''")
    payload = F.struct(F.col("source_text").alias("source"), F.col("translated_text").alias("translation"))
    answers = parsed(ask(rows, "memory", make, payload, _KEY, ledger), "entities array<struct<entityType:string,sourceName:string,translatedName:string,note:string>>", ["entities"])
    return answers.select(*_KEY, "error", F.posexplode_outer("parsed.entities").alias("nth", "e")).select(*_KEY, "nth", "e.*", "error").where("error is not null or nth is not null")
