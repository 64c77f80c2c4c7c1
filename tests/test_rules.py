"""Rules with edges, on small fixtures, and random comparisons with plain models."""

from __future__ import annotations

import math
import random
import uuid

import pytest
from pyspark.sql import functions as F

from codexloom.functions import ids
from codexloom.functions import text as X
from codexloom.operators import boundary, chunking, layout, metrics, models, quality, render, structure
from codexloom.operators import queue as Q
from codexloom.sources import text as T
from codexloom.streaming import events as E


def one(spark, column, *values):
    row = spark.createDataFrame([values], [f"c{i}" for i in range(len(values))])
    return row.select(column.alias("x")).first()["x"]


def blocks(spark, rows):
    """(kind, text[, level[, page[, box]]]) to blocks of document 1."""
    out = []
    for n, row in enumerate(rows):
        kind, text, level, page, box = (*row, None, None, None)[:5]
        mark = f"{'#' * level} {text}" if level else text
        out.append((1, n, f"block_{n:06d}", kind, text, mark, level, page, box))
    kinds = "doc_id long, pos int, block_id string, kind string, text string, markdown string, heading_level int, page_no int, bbox struct<left:double,top:double,right:double,bottom:double,page_width:double,page_height:double>"
    return T.completed(spark.createDataFrame(out, kinds))


def box(left, top, width=210.0, height=20.0):
    return (float(left), float(top), float(left + width), float(top + height), 600.0, 800.0)


def test_casefold_as_the_unicode_tables_have_it(spark):
    words = ["Straße", "STRASSE", "ﬁn", "ΣΊΣΥΦΟΣ", "ὈΔΥΣΣΕΎΣ", "ıİ", "ŉ", "Éa", "plain", "", "ǅ", "µ", "ſ"]
    rows = spark.createDataFrame([(n, w) for n, w in enumerate(words)], "n int, w string")
    assert [r["x"] for r in rows.orderBy("n").select(X.casefold(F.col("w")).alias("x")).collect()] == [w.casefold() for w in words]


def test_token_estimate(spark):
    for text in ("", "a", "abcd efgh", "中文 abc", "x\u00a0y\u3000z" * 9):
        cjk = sum("\u3400" <= c <= "\u4dbf" or "\u4e00" <= c <= "\u9fff" for c in text)
        other = sum(not c.isspace() for c in text) - cjk
        assert one(spark, X.estimate_tokens(F.col("c0")), text) == max(1, cjk + math.ceil(other / 4))


def test_name_uuid(spark):
    for name in ("a:1", "job:7", "ü:中"):
        assert one(spark, ids.name_uuid("chunk", F.col("c0")), name) == f"chunk_{uuid.uuid5(uuid.NAMESPACE_URL, name).hex}"


def test_two_columns(spark):
    rows = [("paragraph", "L1", None, 1, box(40, 100)), ("paragraph", "R1", None, 1, box(330, 100)), ("paragraph", "L2", None, 1, box(40, 110)), ("paragraph", "R2", None, 1, box(330, 110))]
    out = layout.normalize(blocks(spark, rows)).orderBy("pos").collect()
    assert [r["text"] for r in out] == ["L1", "L2", "R1", "R2"]
    assert all("STRUCTURE" in [x["risk_type"] for x in r["risks"]] for r in out)


def test_full_width_segments(spark):
    rows = [("title", "T", None, 1, box(40, 100, 500)), ("paragraph", "R1", None, 1, box(330, 150)), ("paragraph", "L1", None, 1, box(40, 150)), ("table", "W", None, 1, box(40, 200, 500)), ("paragraph", "R2", None, 1, box(330, 250)), ("paragraph", "L2", None, 1, box(40, 250))]
    out = layout.reading_order(blocks(spark, rows)).orderBy("pos").collect()
    assert [r["text"] for r in out] == ["T", "L1", "R1", "W", "L2", "R2"]


def test_furniture_counts_pages_not_occurrences(spark):
    head = [("paragraph", "Head", None, p, box(40, 10)) for p in (1, 2)]
    twice = [("paragraph", "Draft", None, 3, box(40, 10)), ("paragraph", "Draft", None, 3, box(40, 20))]
    body = [("paragraph", f"b{p}", None, p, box(40, 300)) for p in (1, 2, 3)]
    kept = {r["text"] for r in layout.remove_furniture(blocks(spark, head + twice + body)).collect()}
    assert kept == {"Draft", "b1", "b2", "b3"}


def test_section_paths_equal_a_heading_stack(spark):
    rng = random.Random(4)
    rows = [("heading", f"h{n}", rng.randint(1, 6)) if rng.random() < 0.5 else ("paragraph", f"p{n}") for n in range(120)]
    stack, want = [], []
    for row in rows:
        if row[0] == "heading":
            while stack and stack[-1][0] >= row[2]:
                stack.pop()
            stack.append((row[2], row[1]))
        want.append([t for _, t in stack])
    assert [r["section_path"] for r in structure.sections(blocks(spark, rows)).orderBy("pos").collect()] == want


def test_sentences_keep_formulas_and_citations(spark):
    text = "A sum $x. y$ is. See [1, 2]. Done! 中文。没有空格。"
    assert one(spark, chunking.split_sentences(F.col("c0")), text) == ["A sum $x. y$ is.", "See [1, 2].", "Done!", "中文。", "没有空格。"]


def test_packing_equals_a_sequential_fold(spark):
    rng = random.Random(8)
    rows = []
    for n in range(150):
        kind = rng.choices(["paragraph", "heading", "formula"], [8, 1, 1])[0]
        rows.append((kind, " ".join("word" for _ in range(rng.randint(1, 60))), 2 if kind == "heading" else None))
    b = blocks(spark, rows)
    pieces = b.withColumns({"piece": F.lit(0), "cjk": X.cjk_chars(F.col("markdown")).cast("int"), "other": X.other_chars(F.col("markdown")).cast("int"), "decision": F.lit(None).cast("string")})
    got = [(r["draft"], r["reason"]) for r in chunking.pack(pieces, 60, 100, 10).orderBy("pos").collect()]
    size = lambda t: math.ceil(len(t.replace(" ", "")) / 4)
    drafts, now, opened, reasons = [], -1, False, {}
    total = 0
    for kind, text, level in rows:
        mark = f"{'#' * level} {text}" if level else text
        other = len(mark.replace(" ", ""))
        why = None
        if opened:
            then = math.ceil((total + other) / 4)
            why = "SECTION_BOUNDARY" if kind == "heading" else "ATOMIC_BLOCK" if kind == "formula" else "TOKEN_HARD_LIMIT" if then > 100 else "TOKEN_SOFT_LIMIT" if then > 60 else None
        if not opened or why:
            if why:
                reasons[now] = why
            now, total = now + 1, 0
        total, opened = (0, False) if kind == "formula" else (total + other, True)
        if kind == "formula":
            reasons[now] = "ATOMIC_BLOCK"
        drafts.append(now)
    reasons.setdefault(now, "END_OF_DOCUMENT")
    assert size("ab") == 1
    assert got == [(d, reasons.get(d, "END_OF_DOCUMENT")) for d in drafts]


def test_table_groups_repeat_the_header(spark):
    table = "| a |\n| --- |\n" + "\n".join(f"| {n} |" for n in range(5))
    out = one(spark, chunking.table_groups(F.col("c0"), F.lit("Table 1."), rows_per_table=2), table)
    assert len(out) == 3 and out[0].startswith("Table 1.\n\n| a |") and out[1].startswith("Table 1. (continued)\n\n| a |\n| --- |\n| 2 |")


def test_caption_by_reference_leaves_its_place(spark):
    b = blocks(spark, [("caption", "Figure 1: x"), ("paragraph", "between"), ("picture", "")])
    meta = F.when(F.col("kind") == "caption", F.col("metadata").withField("self_ref", F.lit("#c"))).when(F.col("kind") == "picture", F.col("metadata").withField("caption_refs", F.array(F.lit("#c")))).otherwise(F.col("metadata"))
    chunks = chunking.build_chunks(b.withColumns({"metadata": meta, "markdown": F.when(F.col("kind") == "picture", "![]").otherwise(F.col("markdown"))})).orderBy("chunk_index").collect()
    assert [(c["chunk_type"], c["source_text"]) for c in chunks] == [("TEXT", "between"), ("PICTURE", "Figure 1: x\n\n![]")]


MARKDOWN = """# Title

Para one
goes on.
| a | b |
| --- | --- |
| 1 | 2 |
Table 3. words
```py
x = 1
```
$$ a + b $$
$$
c
$$
- item
2. other
## Next
Figure 2: caption
tail $x$ line
"""


def test_markdown_blocks():
    kinds = [b["kind"] for b in T.lex_markdown(MARKDOWN)]
    assert kinds == ["title", "paragraph", "table", "caption", "code", "formula", "formula", "list_item", "list_item", "heading", "caption", "paragraph"]
    assert T.lex_markdown("```\na\nb")[0]["text"] == "a" and T.lex_markdown("") == [] and T.lex_markdown("\n \n") == []


@pytest.mark.parametrize("seed", range(3))
def test_markdown_never_loses_lines(seed):
    rng = random.Random(seed)
    parts = ["# h", "text", "", "  ", "| a | b |", "| --- |", "---", "```", "$$", "$$ x $$", "- i", "Table 1. c", "1. n", "#no", "a | b"]
    for _ in range(300):
        lines = [rng.choice(parts) for _ in range(rng.randint(0, 12))]
        out = T.lex_markdown("\n".join(lines))
        assert [x.strip() for b in out for x in b["markdown"].split("\n") if x.strip()] == [x.strip() for x in lines if x.strip()]


def test_text_ids_skip_blank_paragraphs(spark):
    out = T.text_blocks(spark.createDataFrame([(1, "\n\na\n\n\n\nb")], "doc_id long, text string")).orderBy("pos").collect()
    assert [(r["block_id"], r["text"]) for r in out] == [("block_000001", "a"), ("block_000002", "b")]


def test_boundary_signals(spark):
    b = blocks(spark, [("paragraph", "an unfin-", None, 1), ("paragraph", "ished line.", None, 2), ("table", "t", None, 2), ("paragraph", "Whole.", None, 3)])
    assert [r["signals"] for r in boundary.boundary_candidates(b).collect()] == [["PAGE_BREAK", "INCOMPLETE_PUNCTUATION", "HYPHENATED_WORD", "LOWERCASE_CONTINUATION"]]


def test_language(spark):
    for text, want in (("der Hund und die Katze", "de"), ("こんにちは世界", "ja"), ("这是一个很长的中文句子", "zh"), ("qqq", "en"), ("привет мир", "ru")):
        assert one(spark, X.detect_language(F.col("c0")), text) == want


def test_findings(spark):
    pairs = spark.createDataFrame([("c", "TEXT", "See [1] and 模型3 costs 5%", "See and 模型4 costs 5%")], "chunk_id string, chunk_type string, source_text string, translated_text string")
    assert [r["risk_type"] for r in quality.findings(pairs).orderBy("nth").collect()] == ["NUMBER_MISMATCH", "CITATION_MISMATCH", "REFERENCE"]


def test_budget_limits(spark):
    jobs = spark.createDataFrame([(1, 100, 0.0), (2, 0, 0.5), (3, 0, 0.0), (4, 101, 0.0)], "job_id long, max_tokens long, max_cost double")
    spent = spark.createDataFrame([(n, 100, 0.5) for n in (1, 2, 3, 4)], "job_id long, total_tokens long, cost double")
    assert {r["job_id"]: r["exhausted"] for r in metrics.budget_check(jobs, spent).collect()} == {1: True, 2: True, 3: False, 4: False}


def test_queue_position_by_brute_force(spark):
    rng = random.Random(2)
    rows = [(n, "QUEUED" if rng.random() < 0.8 else "LEASED", rng.randint(0, 200) * 3600, rng.randint(0, 200) * 3600) for n in range(120)]
    q = spark.createDataFrame(rows, "job_id long, status string, c long, a long").select("job_id", "status", F.timestamp_seconds("c").alias("created_at"), F.timestamp_seconds("a").alias("available_at"))
    want = {n: 1 + sum(s2 == "QUEUED" and c2 < c and a2 <= a for _, s2, c2, a2 in rows) for n, s, c, a in rows if s == "QUEUED"}
    assert {r["job_id"]: r["position"] for r in Q.queue_positions(q).collect()} == want


def test_html(spark):
    assert one(spark, render.table_html(F.col("c0")), "Cap\n| a<b | c |\n| --- | --- |\n| 1 | 2 |").endswith("<tbody><tr><td>1</td><td>2</td></tr></tbody></table></div>")
    assert 'class="author-grid"' in one(spark, render.table_html(F.col("c0")), "| a@x.org | b@y.org |\n| --- | --- |")
    assert one(spark, render.text_html(F.col("c0")), "## H & x\n\nline $a<b$\nnext") == '<h2>H &amp; x</h2>\n<p>line <code class="inline-math">a&lt;b</code><br>next</p>'
    assert one(spark, X.duration(F.col("c0")), 3_725_000) == "1 小时 2 分"


def test_safe_paths(spark):
    for path, want in (("a/b.md", True), ("../x", False), ("/etc", False), ("a/../b", False), ("s3a://x", False)):
        assert one(spark, X.safe_path(F.col("c0")), path) is want


def test_retries():
    pauses, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise models.Transient
        return "ok"

    assert models.with_retries(call, sleep=pauses.append) == "ok" and pauses == [1.0, 2.0]

    def down():
        raise models.Transient

    assert models.fail_over([down, lambda: "second"], retries=0, sleep=pauses.append) == "second"
    with pytest.raises(models.Rejected):
        models.with_retries(lambda: "")


def test_protected_chunks_call_nothing(spark):
    rows = spark.createDataFrame([(1, 0, "CODE", "x = 1", False), (1, 1, "TEXT", "words", False)], "job_id long, chunk_index int, chunk_type string, source_text string, protected boolean")
    out = {r["chunk_index"]: r["translated_text"] for r in models.translate(rows, models.EchoClient).collect()}
    assert out == {0: "x = 1", 1: "[zh] words"}


def test_stream_context_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(j, n, f"text {j} {n}") for j in (1, 2) for n in range(4)], "job_id long, chunk_index int, source_text string")
    follow = lambda source, previous: f"{previous}>{source[-1]}"
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    E.collect_available(E.stream_context(stream, follow), str(tmp_path / "out"), str(tmp_path / "check"))
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(tuple, E.carried_context(rows, follow).collect()))


def test_ir_version_gate(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"version": "9", "docId": 1}')
    with pytest.raises(Exception, match="unsupported version"):
        T.read_ir(spark, str(tmp_path)).select("version").collect()


def test_long_blocks_and_tables_are_grouped_in_linear_time(spark):
    import time

    rng = random.Random(4)
    spans = ["", " see [1, 2]", " $a. b$", " 中文"]

    def plain(items, limit, most, base=0):
        """Groups by a loop: tokens of a sum of characters without blanks, CJK ones whole."""
        out, held, cjk, other = [], [], 0, 0
        for text in items:
            c = sum("一" <= x <= "鿿" for x in text)
            o = sum(not x.isspace() for x in text) - c
            if held and (cjk + c - -(base + other + o) // 4 > limit or (most and len(held) >= most)):
                out, held, cjk, other = [*out, held], [], 0, 0
            held.append(text)
            cjk, other = cjk + c, other + o
        return [*out, held]

    took = {}
    for n in (5_000, 50_000):
        said = [f"Word {k} of it{rng.choice(spans)} is {'x' * rng.randrange(1, 30)}." for k in range(n)]
        blocks = spark.createDataFrame([("d", "b", 0, "paragraph", " ".join(said))], "doc_id string, block_id string, pos long, kind string, markdown string").withColumn("text", F.col("markdown"))
        rows = [f"| {k} | {'y' * rng.randrange(1, 60)} |" for k in range(n)]
        table = spark.createDataFrame([("\n".join(["| a | b |", "| --- | --- |", *rows]),)], "t string")
        began = time.perf_counter()
        found = [r["markdown"] for r in chunking.split_blocks(blocks, 200).orderBy("piece").collect()]
        groups = table.select(F.explode(chunking.table_groups(F.col("t"), F.lit(""), 100, 12)).alias("g")).collect()
        took[n] = time.perf_counter() - began
        assert found == [" ".join(g) for g in plain(said, 200, None)]
        head = sum(not x.isspace() for x in "| a | b || --- | --- |")
        assert [r["g"] for r in groups] == ["\n".join(["| a | b |", "| --- | --- |", *g]) for g in plain(rows, 100, 12, head)]
    assert took[50_000] < 30 * max(1, took[5_000])


def test_uploads_fail_their_first_check(spark):
    good = ("a.PDF", "paper", "force", "ar", 1)
    cases = {(*good[:k], bad, *good[k + 1 :]): name for k, bad, name in ((0, "a.doc", "UNSUPPORTED_FILE"), (1, "poem", "INVALID_MODE"), (2, "on", "INVALID_OCR_MODE"), (3, "xx", "INVALID_LANGUAGE"), (4, 52_428_801, "FILE_TOO_LARGE"))}
    cases |= {good: None, ("", None, None, None, 1): "UNSUPPORTED_FILE", (*good[:3], None, 1): "INVALID_LANGUAGE", (None, *good[1:]): "UNSUPPORTED_FILE"}
    rows = spark.createDataFrame([(n, *c) for n, c in enumerate(cases)], "n int, filename string, mode string, ocr_mode string, target_language string, bytes long")
    assert [r["error"] for r in quality.upload_errors(rows).orderBy("n").collect()] == list(cases.values())


def test_coherence_risks_of_each_answer(spark):
    suspects = spark.createDataFrame([("d", n) for n in range(5)], "doc_id string, chunk_index int")
    answers = [("d", 0, "CONTINUE", None), ("d", 1, "SPLIT", None), ("d", 2, None, "timeout"), ("d", 3, "CONTINUE", "late"), ("d", 9, "CONTINUE", None)]
    out = boundary.coherence_risks(suspects, spark.createDataFrame(answers, "doc_id string, chunk_index int, decision string, error string")).collect()
    failed = ("BOUNDARY_MODEL_FAILED", "MEDIUM")
    assert {r["chunk_index"]: (r["risk_type"], r["severity"]) for r in out} == {0: ("SEMANTIC_DISCONTINUITY", "HIGH"), 2: failed, 3: failed, 4: failed}
    assert all(r["message"] for r in out) and boundary.coherence_risks(suspects.limit(0), suspects.selectExpr("*", "'SPLIT' decision", "null error")).count() == 0
