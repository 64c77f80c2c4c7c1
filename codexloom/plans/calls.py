"""Queries over the ledger of model calls, with clients whose answers SQL can tell."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import models as L
from ..operators.ledger import Ledger, routed_model
from ..runtime import saved, shared_dir
from . import adapters as A
from .registry import query


def ledger(spark: SparkSession, **options) -> Ledger:
    made = Ledger(spark, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}", base=0.0, **options)
    made.folder.fs.deleteOnExit(made.folder.path())
    return made


class _Moody:
    """Names the characters and places of a text; some texts it rejects, some it never
    answers in time, and to some its answer is no JSON."""

    def chat(self, task: str, payload: dict) -> str:
        words = payload["source"].split()
        part = int(words[1])
        if part % 7 == 0:
            raise L.Rejected("no such text")
        if part % 7 == 1:
            raise L.Transient("timed out")
        if part % 7 == 2:
            return "Sorry."
        found = [{"entityType": ("character", "Place", "other")[part % 3], "sourceName": words[0] + words[1], "translatedName": words[3], "note": None}]
        return json.dumps({"entities": found * (part % 5 > 0)})


_TOLD = f"(select job_id, chunk_index::bigint chunk_index, cast(split_part(source_text, ' ', 2) as bigint) p, source_text from {A.CHUNKS} where translated is not null)"


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.chunks(spark, sf_dir).withColumnRenamed("translated", "translated_text")
    return L.story_entities(c, _Moody, ledger(spark))


@query(f"""select job_id, chunk_index, error, name from (select job_id, chunk_index, case p % 7 when 0 then 'no such text' when 1 then 'timed out' when 2 then 'INVALID_JSON' end error, case when p % 7 > 2 then 'part' || p end as name, p from {_TOLD}) where error is not null or p % 5 > 0""")
def story_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of every translated chunk, and what went wrong with the others."""
    return _entities(spark, sf_dir).select("job_id", "chunk_index", "error", F.col("sourceName").alias("name"))


@query(f"""select job_id, case p % 3 when 0 then 'CHARACTER' else 'PLACE' end entity_type, 'part' || p source_name, arg_max(split_part(source_text, ' ', 4), chunk_index) translated_name, min(chunk_index) first_chunk, max(chunk_index) last_chunk
 from {_TOLD} where p % 7 > 2 and p % 5 > 0 and p % 3 < 2 group by 1, 2, 3""")
def story_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The memory of each job after all its chunks."""
    e = _entities(spark, sf_dir).where("error is null")
    mentions = e.select("job_id", "chunk_index", "nth", F.col("entityType").alias("entity_type"), F.col("sourceName").alias("source_name"), F.col("translatedName").alias("translated_name"), "note")
    return M.entity_memory(mentions).drop("note")


@query(f"""select 'first' as run, count(distinct p || '/' || split_part(source_text, ' ', 4)) calls, count(distinct p || '/' || split_part(source_text, ' ', 4)) filter (p % 7 > 1) answers from {_TOLD}
 union all select 'second', count(distinct p || '/' || split_part(source_text, ' ', 4)), count(distinct p || '/' || split_part(source_text, ' ', 4)) filter (p % 7 > 1) from {_TOLD}""")
def ledger_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls in the ledger after a run and after the same run again: equal payloads are one."""
    c = saved(A.chunks(spark, sf_dir).where("translated is not null").select("job_id", "chunk_index", "source_text"))
    book, out = ledger(spark), []
    for run in ("first", "second"):
        book.ask(c, "memory", _Moody, F.struct(F.col("source_text").alias("source")), ["job_id", "chunk_index"])
        out.append(saved(book.entries().agg(F.count(F.lit(1)).alias("calls"), F.count("answer").alias("answers")).withColumn("run", F.lit(run))))
    return out[0].unionByName(out[1]).select("run", "calls", "answers")


_TASKS = ("terms", "translation", "summary", "quality", "boundary", "memory")


@query(f"""select event_seq, case when job_id % 5 = 0 then 'base' when job_id % 3 = 0 and task = 'translation' then 'own' else case task when 'terms' then 'small' when 'translation' then 'large' when 'quality' then 'large' else 'base' end end model
 from (select event_seq, job_id, case event_seq % 6 when 0 then 'terms' when 1 then 'translation' when 2 then 'summary' when 3 then 'quality' when 4 then 'boundary' else 'memory' end task from {A.EVENTS})""")
def routed_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model that each call goes to: of the job, of the task, or the default; every fifth
    job's calls go to the fallback."""
    task = F.element_at(F.array(*(F.lit(t) for t in _TASKS)), (F.col("event_seq") % len(_TASKS) + 1).cast("int"))
    own = F.when(F.col("job_id") % 3 == 0, F.create_map(F.lit("translation"), F.lit("own"))).otherwise(F.create_map(F.lit("terms"), F.lit("")))
    settings = F.create_map(*(F.lit(x) for x in ("terms", "small", "translation", "large", "quality", "large", "boundary", "")))
    return A.events(spark, sf_dir).select("event_seq", routed_model(task, own, settings, F.lit("base"), F.col("job_id") % 5 == 0).alias("model"))
