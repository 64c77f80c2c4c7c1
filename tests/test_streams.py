"""Streams with state against their batch forms and plain loops."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from codexloom.streaming import events as E
from codexloom.streaming import state as S

START = datetime(2024, 1, 1)
MOVES = "job_id long, kind string, owner string, created_at timestamp, seq long"


def run(spark, parts, schema, change, root):
    """One micro-batch for each part, the query stopped after each and begun again."""
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(schema).parquet(f"{root}/in")
        with S.rocksdb(spark):
            E.collect_available(change(stream), f"{root}/out", f"{root}/checkpoint")
    return [tuple(r) for r in spark.read.parquet(f"{root}/out").collect()]


def plain(moves, minutes, now):
    held, out = {}, []
    for job, kind, owner, at, _ in sorted(moves, key=lambda m: (m[3], m[4])):
        if job in held and held[job][1] < at:
            out.append((job, "EXPIRED", *held.pop(job)))
        if kind == "CLAIM" and job not in held:
            held[job] = owner, at + timedelta(minutes=minutes)
            out.append((job, "LEASED", owner, at))
        elif job in held and held[job][0] == owner and kind == "BEAT":
            held[job] = owner, at + timedelta(minutes=minutes)
        elif job in held and held[job][0] == owner and kind == "RELEASE":
            del held[job]
            out.append((job, "RELEASED", owner, at))
    return out + [(job, "EXPIRED", *lease) for job, lease in held.items() if lease[1] < now]


def test_leases_run_out_by_timers_and_equal_a_plain_loop(spark, tmp_path):
    rng = random.Random(4)
    moves = [(rng.randrange(6), rng.choice(["CLAIM", "BEAT", "BEAT", "RELEASE", "other"]), rng.choice("ab"), START + timedelta(minutes=7 * n), n) for n in range(60)]
    moves += [(100, "CLAIM", "a", START, -3), (100, "CLAIM", "b", START + timedelta(minutes=30), -2), (100, "BEAT", "a", START + timedelta(minutes=30), -1)]  # an end that is now is live
    moves.sort(key=lambda m: m[3])
    last = moves[-1][3]
    none = [(None, "CLAIM", "a", START, 0), (1, None, "a", START, 0), (1, "CLAIM", None, START, 0), (1, "CLAIM", "a", None, 0)]
    parts = [moves[:25] + none, moves[25:50], moves[50:]]
    got = run(spark, parts, MOVES, S.lease_states, tmp_path)
    micros = lambda t: round((t - datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    assert sorted(got) == sorted((j, s, o, micros(t)) for j, s, o, t in plain(moves, 30, last))
    assert {s for _, s, *_ in got} == {"LEASED", "RELEASED", "EXPIRED"} and (100, "EXPIRED", "a", micros(START + timedelta(minutes=60))) in got


def test_lease_runs_equal_the_stream(spark, tmp_path):
    rng = random.Random(5)
    beats = sorted({(rng.randrange(5), START + timedelta(minutes=rng.randrange(900))) for _ in range(80)}, key=lambda b: b[1])
    beats = [(j, t, n, rng.random() < 0.2) for n, (j, t) in enumerate(beats)]
    moves = [(j, k, "w", t, 3 * n + i) for j, t, n, out in beats for i, k in enumerate(["CLAIM", "BEAT", "RELEASE"][: 2 + out])]
    got = run(spark, [moves], MOVES, S.lease_states, tmp_path)
    rows = spark.createDataFrame(beats, "job_id long, created_at timestamp, seq long, release boolean")
    now = F.lit(max(t for _, t, *_ in beats)).cast("timestamp")
    assert sorted((j, s, at) for j, s, _, at in got) == sorted(map(tuple, S.lease_runs(rows, 30, now).collect()))


@pytest.mark.parametrize("parts", [1, 4])
def test_context_of_chunks_in_any_order_equals_batch(spark, tmp_path, parts):
    rows = [(j, n, f"text {j} {n}") for j in (1, 2, 3) for n in range(9)]
    follow = lambda source, previous: f"{previous}>{source[-1]}"
    schema = "job_id long, chunk_index int, source_text string"
    mixed = random.Random(parts).sample(rows, len(rows))
    sent = [mixed[n::parts] for n in range(parts)]
    sent[-1] = sent[-1] + [(1, 4, "again"), (None, 0, "x"), (2, None, "x"), (4, 1, "waits for ever")]
    if (1, 4, "text 1 4") in sent[-1]:  # the first to arrive counts, in one batch too
        sent[-1].remove((1, 4, "again"))
    got = run(spark, sent, schema, lambda s: S.ordered_context(s, follow), tmp_path)
    assert sorted(got) == sorted(map(tuple, E.carried_context(spark.createDataFrame(rows, schema), follow).collect()))


def test_jobs_of_a_bucket_share_their_calls_of_the_store():
    calls = []

    class Store:
        def __init__(self):
            self.value, self.map = None, {}

        def getValueState(self, *_):
            return self

        def getMapState(self, *_):
            return self

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

        def containsKey(self, key):
            calls.append("contains")
            return key in self.map

        def getValue(self, key):
            return self.map[key]

        def removeKey(self, key):
            del self.map[key]

        def updateValue(self, key, value):
            self.map[key] = value

    def sent(rows):
        calls.clear()
        return sorted(tuple(r) for r in made.handleInputRows((7,), iter([(7, *r) for r in rows]), None))

    made, store = S.Ordered(lambda source, previous: f"{previous or ''}{source}", 0, "bigint"), Store()
    made.init(store)
    assert len(sent([(job, n, "x") for n in (2, 0, 1) for job in range(100)])) == 300 and calls == ["get", "update"]
    assert sent([(1, 3, "a"), (2, 5, "c"), (2, 5, "late"), (2, 4, "b")]) == [(1, 3, "xxxa")] and calls == ["get", "update"]
    assert sent([(2, 4, "never"), (2, 3, "a"), (1, 4, "b"), (1, 0, "again")]) == [(1, 4, "xxxab"), (2, 3, "xxxa"), (2, 4, "xxxab"), (2, 5, "xxxabc")]
    assert store.map == {} and calls.count("get") == calls.count("update") == 1 and sent([(1, 0, "again")]) == [] and calls == ["get"]
