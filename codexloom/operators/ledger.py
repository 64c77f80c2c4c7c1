"""A durable ledger of model calls: what has been answered is never asked again.

A call is named by the hash of its task and payload, so equal payloads share one.  Calls are
dealt by that name into buckets; a task asks the calls of its buckets in small batches, and
after each batch writes the answers, or the errors of calls that failed for good, to a file of
its own before it goes on.  A file takes all batches of some seconds, so files grow with the
time that calls take and not with their number; what a store shows of an open file after a
flush (local disks and HDFS do) is kept when an executor is lost.  A task that is repeated after a lost executor reads the names in its
buckets' files first and asks only the rest: a call is asked once more at most, and only if
it was in the batch that the executor took with it.  Two copies of a task at once
may ask twice; one answer of each call counts.

After a run its small files become part of one table.  A run that was cut off is found
by the next, which begins with what it has left.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import saved
from ..sources.files import Folder, opened
from .models import Pool, Rejected, Transient, each, model_for

#: Calls that are written together.
BATCH = 64
BUCKETS = 256
#: Seconds after which a file of answers is closed.
OPEN_S = 5.0

ENTRY = "call string, task string, answer string, error string, lasting boolean, provider string, model string, total_tokens long, retries long, elapsed_ms long"


class Ledger:
    """The calls that a folder keeps."""

    def __init__(self, spark: SparkSession, uri: str, version: str = "", batch: int = BATCH, retries: int = 3, base: float = 1.0) -> None:
        """``version`` is part of the calls' names: with another one (of the prompts, say) all
        are asked anew."""
        self.spark, self.folder, self.version, self.batch = spark, Folder(spark, uri), version, batch
        self.retries, self.base = retries, base

    def _table(self, *names: str) -> DataFrame:
        paths = [f"{self.folder.uri}/{n}" for n in names]
        # A line that was cut off has neither.
        return self.spark.read.schema(ENTRY).json(paths).where("call is not null and (answer is not null or error is not null)") if paths else self.spark.createDataFrame([], ENTRY)

    def _parts(self, kind: str) -> list[str]:
        return [f"{kind}/{n}" for n in self.folder.names(kind) if not n.startswith((".", "_"))]

    def _left(self) -> list[str]:
        return [f"{run}/{b}" for run in self._parts("runs") for b in self.folder.names(run)]

    def entries(self) -> DataFrame:
        """One row a call; an answer goes before an error."""
        done = self.spark.read.schema(ENTRY).parquet(*(f"{self.folder.uri}/{n}" for n in found)) if (found := self._parts("done")) else self._table()
        left = self._left()
        rows = done.unionByName(self._table(*left))
        best = F.min_by(F.struct(*rows.columns), F.struct(F.col("answer").isNull(), ~F.coalesce("lasting", F.lit(False)), "elapsed_ms"))
        return rows.groupBy("call").agg(best.alias("e")).select("e.*")

    def settle(self, runs: list[str] | None = None) -> None:
        """Makes the small files of runs one part of the table, then deletes them.  Without a
        list, of all; that is for runs that were cut off, while none goes on."""
        runs = self._parts("runs") if runs is None else [r for r in runs if r in self._parts("runs")]
        made = f"done/{uuid.uuid4().hex}"
        left = [f"{run}/{b}" for run in runs for b in self.folder.names(run)]
        if left:
            self._table(*left).write.parquet(f"{self.folder.uri}/.{made.replace('/', '-')}")
            self.folder.fs.mkdirs(self.folder.path("done"))
            self.folder.fs.rename(self.folder.path(f".{made.replace('/', '-')}"), self.folder.path(made))
        for run in runs:
            self.folder.delete(run)

    def ask(self, rows: DataFrame, task: str, make: Callable, payload: Column, key_cols: list[str]) -> DataFrame:
        """The key columns of each row with answer, error, provider, model, total_tokens, retries
        and elapsed_ms, after all calls have been made.

        ``make`` gives, on the executor, a client or endpoint, or a list of them (see
        ``entry_of``).  A row whose payload is null calls nothing.  Calls with an answer, or
        with a lasting error, aren't asked; those with a passing one are asked again."""
        text = F.to_json(payload, {"ignoreNullFields": "false"})
        asked = saved(rows.select(*key_cols, text.alias("lg_payload"), F.when(text.isNotNull(), F.sha2(F.concat(F.lit(f"{self.version}:{task}:"), text), 256)).alias("call")))
        calls = asked.where("call is not null")
        if self._parts("done") or self._left():
            calls = calls.join(self.entries().where("answer is not null or lasting").select("call"), "call", "left_anti")
        bucket = F.pmod(F.xxhash64("call"), F.lit(BUCKETS)).cast("int")
        name = f"runs/{uuid.uuid4().hex}"
        root, batch, retries, base = f"{self.folder.uri}/{name}", self.batch, self.retries, self.base

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            clients, at, last, have, held, made = make(), None, None, set(), [], 0
            sink, opened_at = None, 0.0
            endpoints = [c if hasattr(c, "provider") else _Plain(c) for c in (clients if isinstance(clients, list) else [clients])]

            def one(held: tuple[str, str]) -> dict:
                return entry_of(endpoints, task, json.loads(held[1]), retries, base)

            def close() -> None:
                nonlocal sink
                if sink is not None:
                    sink.close()
                    sink = None

            def write(entries: list[dict]) -> None:
                nonlocal sink, opened_at
                if sink is None:
                    fs, path = opened(f"{root}/{at}")
                    fs.create_dir(path, recursive=True)
                    sink, opened_at = fs.open_output_stream(f"{path}/{uuid.uuid4().hex}.json", compression=None), time.monotonic()
                sink.write("".join(json.dumps(e) + "\n" for e in entries).encode())
                sink.flush()
                if time.monotonic() - opened_at > OPEN_S:
                    close()

            def flush(pool: Pool) -> None:
                nonlocal held, made
                if held:
                    write([{"call": c, "task": task, **e} for c, e in zip((c for c, _ in held), each(pool, one, held), strict=True)])
                    made, held = made + len(held), []

            try:
                with Pool() as pool:
                    for part in batches:
                        for b, call, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                            if b != at:
                                flush(pool)
                                close()
                                at, have = b, _named(f"{root}/{b}")
                            if call != last and call not in have:  # equal ones follow each other
                                held.append((call, text))
                            last = call
                            if len(held) == batch:
                                flush(pool)
                    flush(pool)
            finally:
                close()
            yield pa.RecordBatch.from_pydict({"made": pa.array([made], pa.int64())})

        dealt = calls.select(bucket.alias("bucket"), "call", F.col("lg_payload").alias("payload"))
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt.repartition(tasks, "bucket").sortWithinPartitions("bucket", "call").mapInArrow(run, "made long").agg(F.sum("made")).collect()  # one number
        self.settle([name])
        told = self.entries().drop("task")
        return asked.drop("lg_payload").join(told, "call", "left").drop("call", "lasting")


def _named(uri: str) -> set[str]:
    """The calls that earlier attempts of a run have written for a bucket."""
    fs, path = opened(uri)
    if fs.get_file_info(path).type != pafs.FileType.Directory:
        return set()
    out: set[str] = set()
    for info in fs.get_file_info(pafs.FileSelector(path)):
        if info.extension == "json":
            with fs.open_input_stream(info.path, compression=None) as source:
                lines = source.read().split(b"\n")[:-1]  # what follows the last end of a line was cut off
                out |= {json.loads(line)["call"] for line in lines}
    return out


def entry_of(endpoints: Iterable, task: str, payload: dict, retries: int = 3, base: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> dict:
    """An entry for one call.  Passing failures are repeated with doubling pauses, then the next
    endpoint is asked; a rejected call or an empty answer ends it, as it would fail anywhere.

    An endpoint has provider, ``model(task)`` and ``chat(model, task, payload)``, which gives
    (content, total tokens)."""
    began, repeated, error, lasting, last = time.monotonic(), 0, None, False, None
    for endpoint in endpoints:
        last = endpoint
        model = endpoint.model(task)
        for attempt in range(retries + 1):
            try:
                content, tokens = endpoint.chat(model, task, payload)
                if not (content or "").strip():
                    raise Rejected("empty answer")
                return {"answer": content.strip(), "error": None, "lasting": True, "provider": endpoint.provider, "model": model, "total_tokens": tokens, "retries": repeated, "elapsed_ms": int((time.monotonic() - began) * 1000)}
            except Rejected as found:
                error, lasting = str(found), True
                break
            except Transient as found:
                error = str(found)
                if attempt < retries:
                    repeated += 1
                    sleep(base * 2**attempt)
        if lasting:
            break
    return {"answer": None, "error": error or "no endpoint", "lasting": lasting, "provider": last and last.provider, "model": last and last.model(task), "total_tokens": 0, "retries": repeated, "elapsed_ms": int((time.monotonic() - began) * 1000)}


class _Plain:
    """A client without a name and models as an endpoint."""

    def __init__(self, client) -> None:
        self.client, self.provider = client, type(client).__name__

    def model(self, task: str) -> str:
        return ""

    def chat(self, model: str, task: str, payload: dict) -> tuple[str, int]:
        return self.client.chat(task, payload), 0


class Endpoint:
    """An OpenAI-compatible chat endpoint over HTTP.

    The model of a task is the override of the job, else the setting of the task, else the
    default; a fallback has its default only."""

    def __init__(self, provider: str, url: str, key: str, default: str, settings: dict[str, str] | None = None, overrides: dict[str, str] | None = None, prompts: dict[str, str] | None = None, timeout: float = 120, max_tokens: int = 8192) -> None:
        self.provider, self.url, self.key, self.default = provider, url.rstrip("/"), key, default
        self.settings, self.overrides, self.prompts = settings or {}, overrides or {}, prompts or {}
        self.timeout, self.max_tokens = timeout, max_tokens

    def model(self, task: str) -> str:
        return model_for(task, self.overrides, self.settings, self.default, self.provider == "fallback")

    def chat(self, model: str, task: str, payload: dict) -> tuple[str, int]:
        import http.client
        import urllib.error
        import urllib.request

        messages = [{"role": "system", "content": self.prompts.get(task, task)}, {"role": "user", "content": json.dumps(payload, ensure_ascii=False)}]
        body = {"model": model, "messages": messages, "max_tokens": self.max_tokens}
        if task in JSON_TASKS:
            body["response_format"] = {"type": "json_object"}
        request = urllib.request.Request(f"{self.url}/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as response:
                found = json.loads(response.read())
            return found["choices"][0]["message"]["content"], (found.get("usage") or {}).get("total_tokens") or 0
        except urllib.error.HTTPError as error:
            kind = Transient if error.code in (408, 409, 429) or error.code >= 500 else Rejected
            raise kind(f"HTTP {error.code}") from error
        except (OSError, http.client.HTTPException) as error:
            raise Transient(str(error)) from error
        except (ValueError, KeyError, IndexError, TypeError) as error:
            raise Rejected(f"no answer in the response: {error}") from error


#: Tasks whose answer is a JSON object.
JSON_TASKS = ("terms", "boundary", "quality", "memory")


def routed_model(task: Column, overrides: Column, settings: Column, default: Column, fallback: Column) -> Column:
    """``model_for`` on columns: overrides and settings are maps by task."""
    named = lambda m: F.nullif(F.try_element_at(m, task), F.lit(""))
    return F.when(fallback, default).otherwise(F.coalesce(named(overrides), named(settings), default))


def parsed(answers: DataFrame, schema: str, required: list[str]) -> DataFrame:
    """Adds ``parsed``, the answer as JSON of a schema.  An answer that isn't JSON, or lacks one
    of the required fields, is an error row."""
    value = F.from_json("answer", schema)
    bad = F.try_parse_json("answer").isNull()
    for name in required:
        bad |= value[name].isNull()
    error = F.coalesce("error", F.when(F.col("answer").isNotNull() & F.coalesce(bad, F.lit(True)), "INVALID_JSON"))
    return answers.withColumns({"parsed": F.when(error.isNull(), value), "error": error})
