"""Work and files that grow with the input only."""

from __future__ import annotations

import threading
import time

import pyarrow as pa
from pyspark.sql import functions as F

from codexloom import schemas
from codexloom.functions import fixed as C
from codexloom.functions import text as X
from codexloom.operators import chunking as K
from codexloom.operators import models as L
from codexloom.operators import persist as P
from codexloom.operators import structure as S
from codexloom.operators.boundary import topics
from codexloom.operators.render import replay_records
from codexloom.operators.versions import edited
from codexloom.plans import QUERIES
from codexloom.sources import paged
from codexloom.sources import text as T
from codexloom.sources.versioned import VersionedStore


def test_blanks_inside_a_text_are_passed_once(spark):
    rows = spark.createDataFrame([(" " * 3 + "a" + " " * 300_000 + "b\n",)], "t string")
    began = time.monotonic()
    assert rows.select(F.length(X.strip(F.col("t")))).first()[0] == 300_002
    assert time.monotonic() - began < 20


def test_strip_is_that_of_the_pattern(spark):
    every = [chr(c) for c in range(0xD800)]
    texts = [f"{a}x{a}y{b}{a}" for a in every for b in ("", "\n")] + ["", " ", "\r\n", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert rows.where(~X.strip(F.col("t")).eqNullSafe(F.regexp_replace("t", f"^{C.SPACE}+|{C.SPACE}+$", ""))).count() == 0


def test_ranges_grow_with_the_files(tmp_path):
    for n in range(40):
        (tmp_path / f"f{n:02d}.md").write_bytes(b"x" * 50_000)
    tasks = lambda **o: len(paged.PagedReader({"path": str(tmp_path), **o}).partitions())
    assert tasks(tasks=8) == 8 and tasks(tasks=1) == 1 and tasks(tasks=10_000) > 40 and tasks(range_bytes=25_000) == 80


def test_small_files_share_batches(tmp_path):
    for n in range(50):
        (tmp_path / f"f{n:02d}.txt").write_text("a\fb" if n else "")
    reader = paged.PagedReader({"path": str(tmp_path)})
    batches = [b for part in reader.partitions() for b in reader.read(part)]
    assert len(batches) == 1 and batches[0].num_rows == 98


def test_tables_share_csv_files(spark, tmp_path):
    rows = [(k, "table", f"b{k}", f'| a | b |\n| --- | --- |\n| {k} | say "x", y |\n|  | z |') for k in range(300)]
    S.write_table_csv(spark.createDataFrame(rows, "doc_id long, kind string, block_id string, markdown string").coalesce(3), f"{tmp_path}/csv")
    assert len(list((tmp_path / "csv").rglob("*.txt"))) <= 3 and not [p for p in (tmp_path / "csv").iterdir() if p.is_dir()]
    found = S.read_table_csv(spark, f"file://{tmp_path}/csv").orderBy("table_id", "row").collect()
    assert len(found) == 900 and len({r["table_id"] for r in found}) == 300
    assert [r["row"] for r in found[:3]] == [0, 1, 2] and found[0]["line"] == "a,b" and found[1]["line"].endswith(',"say ""x"", y"') and found[2]["line"] == ",z"


def test_keys_of_a_change_are_made_once_and_rows_arent_sorted(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    store = VersionedStore(spark, f"file://{tmp_path}/store", 4)
    tx = store.begin()
    tx.replace("t", spark.range(100).select(F.col("id").alias("job_id"), F.lit("a").alias("x")))
    tx.commit()
    keys = spark.range(10).select(F.col("id").alias("job_id")).mapInArrow(counted, "job_id long")
    tx = store.begin()
    tx.replace("t", spark.range(5).select(F.col("id").alias("job_id"), F.lit("b").alias("x")), keys)
    tx.commit()
    assert made.value == 10 and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    assert sorted(map(tuple, store.snapshot().table("t").collect())) == [(k, "b") for k in range(5)] + [(k, "a") for k in range(10, 100)]


def test_texts_of_chunks_are_shuffled_twice_at_most(spark, tmp_path):
    rows = [(d, n, k, f"{k} {n}") for d in range(9) for n, k in enumerate(("title", "paragraph", "caption", "table", "paragraph", "formula"))]
    blocks = spark.createDataFrame(rows, "doc_id long, pos int, kind string, markdown string").withColumns({"text": F.col("markdown"), "block_id": F.format_string("b%d", "pos")})
    T.completed(blocks).write.parquet(f"{tmp_path}/blocks")
    chunks = K.build_chunks(spark.read.parquet(f"{tmp_path}/blocks"))
    plan = chunks._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2
    assert [(r["chunk_type"], r["source_text"], r["block_ids"]) for r in chunks.where("doc_id = 3").orderBy("chunk_index").collect()] == [
        ("TEXT", "title 0\n\nparagraph 1", ["b0", "b1"]), ("TABLE", "caption 2\n\ntable 3", ["b2", "b3"]), ("TEXT", "paragraph 4", ["b4"]), ("FORMULA", "formula 5", ["b5"])
    ]


def test_a_table_with_two_captions_is_one_chunk(spark):
    rows = [("caption", "Table 1. named", "#c", None), ("paragraph", "between", None, None), ("caption", "Table 2. before", None, None), ("table", "| a |\n| --- |\n| 1 |", None, ["#c"])]
    b = spark.createDataFrame([(1, n, *r) for n, r in enumerate(rows)], "doc_id long, pos int, kind string, markdown string, own string, refs array<string>").withColumn("block_id", F.format_string("b%d", "pos"))
    meta = F.col("metadata").withField("self_ref", F.col("own")).withField("caption_refs", F.col("refs"))
    b = T.completed(b.drop("own", "refs")).join(b.select("block_id", "own", "refs"), "block_id").withColumn("metadata", meta).drop("own", "refs")
    got = [(r["chunk_index"], r["chunk_type"], r["source_text"].split("\n")[0]) for r in K.build_chunks(b).orderBy("chunk_index").collect()]
    assert got == [(0, "TEXT", "between"), (1, "TABLE", "Table 2. before")]


def test_topics_deal_out_texts_and_not_words(spark):
    rows = spark.createDataFrame([(1, "bb aa aa the bb cc"), (2, None), (3, "x"), (1, "cc cc")], "k long, t string")
    found = topics(rows, "k", "t")
    assert {r["k"]: r["topic"] for r in found.collect()} == {1: "cc, bb, aa", 2: None, 3: None}
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "word" in line]


def test_texts_stay_out_of_the_join_of_replay_records(spark):
    chunks = spark.createDataFrame([(1, "c", 0, "TEXT", "s", "ab", "x" * 50, 0)], "job_id long, chunk_id string, chunk_index int, chunk_type string, status string, source_text string, translated_text string, revision_count long")
    empty = spark.createDataFrame([], "job_id long, chunk_id string, risk_type string, mode string, status string, node string, elapsed_ms long")
    found = replay_records(empty, chunks, empty, empty)
    join = next(line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line)
    below = found._jdf.queryExecution().optimizedPlan().toString().split(join)[1]
    assert "translationSha256" in below
    row = found.where("recordType = 'chunk'").first()
    assert (row["translationChars"], row["riskTypes"], row["jobId"]) == (50, [], 1)


def test_texts_of_edited_chunks_are_made_after_the_joins(spark):
    for name in ("chunk_edits", "chunk_restores"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        above, below = plan.split("Join ", 1)
        made = [line for line in below.splitlines() if "Project [" in line and "repeat(" in line]
        assert "repeat(" in above and not made, name
    chunks = spark.createDataFrame([(1, "a", "COMPLETED", 0, 7), (1, "b", "COMPLETED", 2, None), (1, "c", "PENDING", 1, 8)], "job_id long, chunk_id string, status string, revision_count long, n int")
    jobs = spark.createDataFrame([(1, "COMPLETED")], "job_id long, status string")
    edits = spark.createDataFrame([(1, k, " new ") for k in "abcd"], "job_id long, chunk_id string, new_text string")
    old = F.concat(F.lit("t"), "n")
    late = edited(chunks, jobs, edits, old)
    assert {r["chunk_id"]: (r["refused"], r["translated_text"], r["revision_count"]) for r in late.collect()} == {"a": (None, "new", 1), "b": ("INVALID_STATE", None, 2), "c": ("INVALID_STATE", "t8", 1), "d": ("NOT_FOUND", None, None)}
    stored = edited(chunks.withColumn("translated_text", old), jobs, edits)
    assert late.exceptAll(stored).count() == stored.exceptAll(late).count() == 0


def test_documents_share_json_files_and_are_gathered_once(spark, tmp_path):
    kinds = [("paragraph", None, "before"), ("title", 1, " T "), ("paragraph", None, "p"), ("heading", 2, "a"), ("heading", 4, "b"), ("table", None, "| x |"), ("heading", 2, "c")]
    rows = [(d, n, f"b{n}", k, t, f"{d} {t}", lv) for d in range(60) for n, (k, lv, t) in enumerate(kinds)] + [(99, 0, "b0", "paragraph", "x", "x", None)]
    blocks = T.completed(spark.createDataFrame(rows, "doc_id long, pos int, block_id string, kind string, text string, markdown string, heading_level int"))
    found = T.sectioned_json(S.sections(blocks, ids_too=True))
    own = S.section_rows(blocks)
    named = S.sections(blocks).join(blocks.select("doc_id", F.col("pos").alias("section_pos"), F.col("block_id").alias("h")), ["doc_id", "section_pos"], "left")
    named = named.join(own.select("doc_id", F.col("block_id").alias("h"), "section_id"), ["doc_id", "h"], "left")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, T.ir_json(named, own).collect()))
    T.write_ir(found.coalesce(2), f"{tmp_path}/ir", 50)
    assert 2 <= len(list((tmp_path / "ir").glob("part-*"))) <= 4
    read = T.ir_blocks(T.read_ir(spark, f"file://{tmp_path}/ir"))
    assert sorted(map(tuple, read.select("doc_id", "pos", "markdown", F.array_join("metadata.section_path", "/")).collect())) == sorted(map(tuple, S.sections(blocks).select("doc_id", "pos", "markdown", F.when(F.size("section_path") > 0, F.array_join("section_path", "/"))).collect()))
    parsed = T.ir_blocks(found.select(F.from_json("value", schemas.IR_DOCUMENT).alias("d")).select("d.*")).select("doc_id", "pos")
    assert parsed._jdf.queryExecution().optimizedPlan().toString().count("from_json") <= 1


def test_words_of_pairs_are_counted_in_batches(spark):
    sides = [(["b", "a", "b"], ["b", "c", "b", "b"]), ([], ["a"]), (["é"], ["é"]), (None, ["a"]), (["x"] * 700_000, ["x", "y"]), (["x"] * 400_000, ["x"]), (["a", "b"], ["b", "a"]), (["a"], ["b"])]
    found = X._counted(*(pa.array([None, *(s[k] for s in sides)], pa.list_(pa.string()))[1:] for k in (0, 1)))
    assert [tuple(r.values()) for r in found.to_pylist()] == [(6, 5, 10), (0, 0, 1), (1, 1, 1), (0, 0, 1), (700_000, 490_000_000_000, 2), (400_000, 160_000_000_000, 1), (2, 2, 2), (0, 1, 1)]
    assert X._counted(*(pa.array([], pa.list_(pa.string())) for _ in "ab")).to_pylist() == []
    rows = spark.createDataFrame([("The cat the", "the dog"), ("", "a b"), (None, "aa"), ("However it", "however it")], "l string, r string")
    cosines = [r[0] for r in rows.select(F.round(X.lexical_cosine(F.col("l"), F.col("r")), 6)).collect()]
    assert cosines == [0.632456, 0.0, 0.0, 1.0]
    assert "aggregate" not in rows.select(X.lexical_cosine(F.col("l"), F.col("r")))._jdf.queryExecution().optimizedPlan().toString()


def test_calls_are_made_in_turn_until_one_is_waited_for(monkeypatch):
    monkeypatch.setattr(L, "BATCH_S", 30)
    used: set = set()

    def one(n, pause=0.0):
        used.add(threading.get_ident())
        time.sleep(pause)
        return n

    with L.Pool() as pool:
        assert L.each(pool, one, list(range(3_000))) == list(range(3_000)) and L.each(pool, one, []) == []
        assert used == {threading.get_ident()} and not pool.waits
        monkeypatch.setattr(L, "BATCH_S", 0.01)
        assert L.each(pool, lambda n: one(n, 0.02), list(range(40))) == list(range(40))
        assert pool.waits and len(used) > 2
        used.clear()
        assert L.each(pool, one, list(range(40))) == list(range(40)) and threading.get_ident() not in used


class Careless:
    """Empties what it is told, and finds the same two issues in every text."""

    def chat(self, task, payload):
        if task == "quality":
            return '{"issues": [{"type": "a", "severity": "High"}, {"message": "m", "severity": "low"}]}'
        told = sum(len(i) for i in payload["issues"]) + len(payload["confirmedTerms"])
        for given in (*payload["issues"], payload["confirmedTerms"]):
            given.clear()
        return f"{payload['translation']}{told}"


def test_equal_answers_and_terms_are_parsed_once_and_not_shared(spark):
    rows = [(1, n, "s", f"t{n}" if n else None, {"a": "b", "c": "d"}) for n in range(50)]
    out = L.revised(spark.createDataFrame(rows, "job_id long, chunk_index int, source_text string, translated_text string, glossary map<string,string>").coalesce(1), Careless, 2)
    assert {r["chunk_index"]: (r["translated_text"], r["revision_count"], r["checks"], [tuple(i) for i in r["issues"]]) for r in out.collect()} == {n: (f"t{n}44", 2, 3, [("a", None, "High"), (None, "m", "low")]) for n in range(1, 50)}
    L._issues.cache_clear()
    L._terms.cache_clear()
    for _ in range(2):
        L._issues(Careless().chat("quality", {}))
        L._terms('{"a": "b"}')
    assert L._issues.cache_info().misses == 1 and L._terms.cache_info().misses == 1


def test_a_persisted_change_shuffles_no_drafts_to_find_refused_jobs(spark):
    jobs = spark.createDataFrame([(k, "PARSED") for k in range(4)], "job_id long, status string")
    chunks = spark.createDataFrame([(0, 0, "a", "PENDING"), (1, 0, "a", "PENDING"), (1, 1, "b", "COMPLETED"), (2, 0, "c", None)], "job_id long, chunk_index long, source_text string, status string")
    drafts = spark.createDataFrame([(0, 0, "x"), (1, 0, "x"), (2, 0, "x"), (9, 0, "x")], "job_id long, chunk_index long, source_text string")
    told = P.outcomes(jobs, chunks, drafts, drafts.select("job_id").unionByName(jobs.select("job_id")))
    assert sorted(map(tuple, told.collect())) == [(0, "APPLIED"), (1, "INVALID_STATE"), (2, "APPLIED"), (3, "VALIDATION_ERROR"), (9, "JOB_NOT_FOUND")]
    assert "FullOuter" not in told._jdf.queryExecution().optimizedPlan().toString()


def test_items_of_stored_tables_are_numbered_once(spark, monkeypatch):
    from codexloom.plans import adapters, stores

    made = []
    of = adapters.items
    monkeypatch.setattr(adapters, "items", lambda *a: made.append(1) or of(*a))
    stores._stored(spark, "/root/testdata/sf0.001")
    assert made == [1]
