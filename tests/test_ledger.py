"""The ledger of calls: what is asked, what a lost task costs, errors, endpoints."""

from __future__ import annotations

import json
import os
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from codexloom.operators import models as L
from codexloom.operators.ledger import Endpoint, Ledger, _named, entry_of, parsed


def log(path, text):
    with open(path, "ab", buffering=0) as out:
        out.write(f"{text}\n".encode())


def calls(path):
    return Counter(path.read_text().split()) if path.exists() else Counter()


def client(path, fault=None):
    """A client that logs every call; ``fault`` names a file that is made by the first call
    of text 40, whose task then dies."""
    path, fault = str(path), fault and str(fault)

    class Logged:
        def chat(self, task, payload):
            text = payload["text"]
            log(path, text)
            if fault and text == "40" and not os.path.exists(fault):
                open(fault, "w").close()
                os._exit(1)
            if text == "13":
                raise L.Rejected("refused")
            if text == "14":
                raise L.Transient("busy")
            return f"{task} {text}" if text != "15" else " "

    return Logged


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "k long, text string")


def ask(book, df, make, task="t"):
    return {r["k"]: r for r in book.ask(df, task, make, F.when(F.col("text") != "", F.struct("text")), ["k"]).collect()}


@pytest.fixture
def book(spark, tmp_path):
    return Ledger(spark, f"file://{tmp_path}/ledger", batch=8, base=0.0)


def test_each_payload_is_asked_once(spark, book, tmp_path):
    df = rows(spark, [*(str(n) for n in range(30)), "3", "3", "", None])
    found = ask(book, df, client(tmp_path / "log"))
    assert len(found) == 34 and found[3]["answer"] == found[30]["answer"] == "t 3" and found[32]["answer"] is found[33]["answer"] is None
    assert found[32]["error"] is None and found[13]["error"] == "refused" and found[14]["error"] == "busy" and found[15]["error"] == "empty answer"
    assert found[14]["retries"] == 3 and calls(tmp_path / "log") == {str(n): 1 + 3 * (n == 14) for n in range(30)}
    again = ask(book, df, client(tmp_path / "log"))
    assert again[3]["answer"] == "t 3" and again[13]["error"] == "refused"
    assert calls(tmp_path / "log") == {str(n): 1 + 7 * (n == 14) for n in range(30)}  # only what may have passed
    assert ask(book, rows(spark, ["3"]), client(tmp_path / "log"), "other")[0]["answer"] == "other 3"
    newer = Ledger(spark, book.folder.uri, version="2", base=0.0)
    ask(newer, rows(spark, ["4"]), client(tmp_path / "log"))
    assert calls(tmp_path / "log")["3"] == 2 and calls(tmp_path / "log")["4"] == 2


def test_a_task_that_dies_repeats_one_batch_at_most(spark, tmp_path):
    """With one failure allowed to a task the run goes on by itself (as on a cluster); local
    sessions allow none, so the run is cut off and begun again."""
    book = Ledger(spark, f"file://{tmp_path}/ledger", batch=8, base=0.0)
    df = rows(spark, [str(n) for n in range(100)])
    make = client(tmp_path / "log", tmp_path / "fault")
    with pytest.raises(Exception, match="crash|exit|abort"):
        ask(book, df, make)
    before = calls(tmp_path / "log")
    assert 8 <= len(before) < 100
    found = ask(book, df, make)
    told = calls(tmp_path / "log")
    assert len(found) == 100 and {r["answer"] for k, r in found.items() if k not in (13, 14, 15)} == {f"t {n}" for n in range(100) if n not in (13, 14, 15)}
    again = [n for n in told if told[n] > 1 and n != "14"]
    assert max(told[n] for n in told if n != "14") == 2 and len(again) <= 4 * 8  # of the four tasks at work
    book.settle()
    assert book.folder.names("runs") == [] and book.entries().count() == 100


def test_a_repeated_attempt_reads_what_the_first_has_written(spark, tmp_path):
    """The second attempt of a task, in the same run: run by a context that allows it."""
    import subprocess
    import sys

    code = f"""
import sys; sys.path[:0] = {sys.path!r}
from pyspark.sql import SparkSession
from tests.test_ledger import *
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", "file://{tmp_path}/cp").getOrCreate()
from pathlib import Path
book = Ledger(spark, "file://{tmp_path}/ledger", batch=8, base=0.0)
found = ask(book, rows(spark, [str(n) for n in range(100)]), client(Path("{tmp_path}/log"), Path("{tmp_path}/fault")))
print(len(found), sum(r["answer"] is not None for r in found.values()))
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, check=False)
    assert done.stdout.split()[-2:] == ["100", "97"], done.stderr[-2000:]
    told = calls(tmp_path / "log")
    assert max(told[n] for n in told if n != "14") <= 2 and sum(told[n] > 1 for n in told if n != "14") <= 2 * 8


def test_files_do_not_grow_with_quick_calls(spark, tmp_path, monkeypatch):
    book = Ledger(spark, f"file://{tmp_path}/ledger", batch=8, base=0.0)
    seen = []
    settle = book.settle

    def counted(runs=None):
        seen.extend(f for f in (tmp_path / "ledger" / "runs").rglob("*.json"))
        settle(runs)

    monkeypatch.setattr(book, "settle", counted)
    assert len(ask(book, rows(spark, [f"a{n}" for n in range(20_000)]), client(tmp_path / "log"))) == 20_000
    assert len(seen) == 256 and max(calls(tmp_path / "log").values()) == 1


def test_a_line_that_was_cut_off_is_asked_again(spark, book, tmp_path):
    run = tmp_path / "ledger" / "runs" / "r" / "7"
    run.mkdir(parents=True)
    (run / "x.json").write_text('{"call": "c1", "task": "t", "answer": "yes", "error": null, "lasting": true}\n{"call": "c2", "task": "t", "ans')
    assert _named(f"file://{run}") == {"c1"}
    assert [r["call"] for r in book.entries().collect()] == ["c1"]
    book.settle()
    assert [r["call"] for r in book.entries().collect()] == ["c1"]


class Endpoints:
    def __init__(self, provider, answers):
        self.provider, self.answers, self.seen = provider, list(answers), 0

    def model(self, task):
        return f"{self.provider}-{task}"

    def chat(self, model, task, payload):
        self.seen += 1
        answer = self.answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer, 5


def test_endpoints_in_turn():
    pauses = []
    busy = lambda n: [L.Transient("busy")] * n
    entry = entry_of([Endpoints("a", busy(3)), Endpoints("b", [*busy(1), " ok "])], "t", {}, 2, 1.0, pauses.append)
    assert (entry["answer"], entry["provider"], entry["model"], entry["retries"], entry["total_tokens"]) == ("ok", "b", "b-t", 3, 5) and pauses == [1.0, 2.0, 1.0]
    second = Endpoints("b", ["never"])
    entry = entry_of([Endpoints("a", [L.Rejected("bad")]), second], "t", {}, 2, 0.0)
    assert entry["error"] == "bad" and entry["lasting"] and second.seen == 0
    entry = entry_of([Endpoints("a", busy(1)), Endpoints("b", busy(1))], "t", {}, 0, 0.0)
    assert entry["error"] == "busy" and not entry["lasting"] and entry_of([], "t", {})["error"] == "no endpoint"


def test_endpoint_over_http():
    seen = []

    class Server(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, self.headers["Authorization"], body))
            content = body["messages"][1]["content"]
            code = {"busy": 429, "down": 503, "bad": 400}.get(json.loads(content).get("x"), 200)
            answer = b"{}" if "odd" in content else json.dumps({"choices": [{"message": {"content": f"re {content}"}}], "usage": {"total_tokens": 7}}).encode()
            self.send_response(code)
            self.end_headers()
            self.wfile.write(answer)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    end = Endpoint("main", f"http://127.0.0.1:{server.server_port}/v1/", "key", "base", {"terms": "small"}, {"quality": "own"}, {"terms": "Find the terms."}, 5, 100)
    assert end.chat(end.model("terms"), "terms", {"x": "é"}) == ('re {"x": "é"}', 7)
    path, key, body = seen[0]
    assert path == "/v1/chat/completions" and key == "Bearer key" and body["model"] == "small" and body["max_tokens"] == 100
    assert body["messages"][0] == {"role": "system", "content": "Find the terms."} and body["response_format"] == {"type": "json_object"}
    end.chat("m", "summary", {})
    assert "response_format" not in seen[1][2] and end.model("quality") == "own" and end.model("summary") == "base"
    assert Endpoint("fallback", "", "", "base", {"terms": "small"}, {"terms": "own"}).model("terms") == "base"
    for x, kind in (("busy", L.Transient), ("down", L.Transient), ("bad", L.Rejected), ("odd", L.Rejected)):
        with pytest.raises(kind):
            end.chat("m", "terms", {"x": x})
    server.shutdown()
    server.server_close()
    with pytest.raises(L.Transient):
        end.chat("m", "terms", {})


def test_answers_of_another_form_are_errors(spark):
    texts = ['{"entities": []}', '{"entities": [{"sourceName": "a"}]}', "{}", "no", '{"entities": 5}', None]
    df = spark.createDataFrame([(n, t, "failed" if t is None else None) for n, t in enumerate(texts)], "n int, answer string, error string")
    out = parsed(df, "entities array<struct<sourceName:string>>", ["entities"]).orderBy("n").collect()
    assert [r["error"] for r in out] == [None, None, "INVALID_JSON", "INVALID_JSON", "INVALID_JSON", "failed"]
    assert [len(r["parsed"]["entities"]) if r["parsed"] else None for r in out] == [0, 1, None, None, None, None]


def test_stages_give_error_rows(spark, book, tmp_path):
    chunks = spark.createDataFrame([(1, n, "TEXT", f"{n}", f"{n}", False) for n in (12, 13)], "job_id long, chunk_index long, chunk_type string, source_text string, translated_text string, protected boolean")
    made = client(tmp_path / "log")

    def make():
        inner = made()

        class Client:
            def chat(self, task, payload):
                return inner.chat(task, {"text": payload.get("sourceChunk") or payload.get("text") or payload.get("source")})

        return Client()

    out = {r["chunk_index"]: r for r in L.translate(chunks.drop("translated_text"), make, ledger=book).collect()}
    assert out[12]["translated_text"] == "translation 12" and out[13]["translated_text"] is None and out[13]["error"] == "refused"
    out = {r["chunk_index"]: r for r in L.summarised(chunks, make, book).collect()}
    assert out[12]["summary"] == "summary 12" and out[13]["error"] == "refused"
    out = {r["chunk_index"]: r for r in L.story_entities(chunks, make, book).collect()}
    assert out[12]["error"] == "INVALID_JSON" and out[13]["error"] == "refused"
