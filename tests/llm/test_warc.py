"""WARC archives and their index: round trips and plain code."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from codexloom.llm import _store, warc
from codexloom.llm.warc import archive_and_read, fetch, lookup, parsed, scan, typed, url_key, write_archives, write_index
from tests.test_oracle import same_rows

PAGE = "page_id long, url string, html string, payload string, type string, id string, digest string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], PAGE).repartition(3)


def some_pages():
    rng = random.Random(4)
    bodies = ["", None, "<p>é</p>", "x" * 70_000, "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nb", "\x00\x01", "same " * 40]
    rows = [(k, f"https://{rng.choice(['www', 'blog', 'm'])}.site{k % 5}.example.com/{rng.choice('abc')}/{k % 40}", rng.choice(bodies) if k % 3 else f"page {k}") for k in range(200)]
    rows += [(7, rows[7][1], rows[7][2]), (900, None, "no url"), (901, "", "no url"), (902, "http://h/ x\r\ny", "odd url"), (None, "http://h/n", "same " * 40), (None, "http://h/m", "only null"), (None, "http://h/m", "only null"), (903, "urn:isbn:1", "urn")]
    return rows


def plain(rows, least=0):
    last = {}
    for i, _, p in rows:
        if i is not None and len((p or "").encode()) >= least:
            last[p or ""] = max(i, last.get(p or "", i))
    out = []
    for i, _, p in rows:
        data, top = (p or "").encode(), last.get(p or "")
        again = top is not None and i != top
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", top if again else None, None if again else p or ""))
    return sorted(out, key=repr)


def read(df):
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else r["payload"].decode()) for r in df.collect()), key=repr)


def test_query_equals_sql(spark):
    assert same_rows(spark, "op12_warc") == 50


@pytest.mark.parametrize("least", [0, 10])
def test_round_trip(spark, least):
    rows = some_pages()
    out = archive_and_read(pages(spark, rows), least)
    assert out.columns == ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]
    assert read(out) == plain(rows, least)


def test_no_pages(spark):
    assert archive_and_read(pages(spark, [])).collect() == []


def test_url_keys():
    assert url_key("http://user@Blog.Example.com:80/path?q=1&r=#part") == "com,example,blog)/path?q=1&r="
    assert url_key("HTTPS://example.com.") == "com,example)/" and url_key("https://example.com?x") == "com,example)/?x"
    assert url_key("http://h:8080/a b") == "h:8080)/a%20b" and url_key(None) == url_key("  ") == "-" and url_key("urn:isbn:1") == "urn:isbn:1"


def written(spark, tmp_path, rows, limit=1 << 30, **index):
    captures = write_archives(typed(pages(spark, rows)), f"file://{tmp_path}/a", limit=limit)
    captures.write.parquet(f"{tmp_path}/captures")
    captures = spark.read.parquet(f"{tmp_path}/captures")
    parts = write_index(captures, f"file://{tmp_path}/i", **index)
    parts.write.parquet(f"{tmp_path}/parts")
    return captures, spark.read.parquet(f"{tmp_path}/parts")


def test_lookup_in_small_blocks_and_parts(spark, tmp_path):
    rows = [*some_pages(), *((2000 + k, "http://hot.example.com/", f"hot {k % 3}") for k in range(60))]
    captures, parts = written(spark, tmp_path, rows, 5000, block_lines=4, part_lines=10)
    assert parts.agg(F.sum("lines")).first()[0] == len(rows) and parts.count() > 20
    expected = {}
    for i, u, _ in rows:
        expected.setdefault(url_key(u), []).append(i)
    for key in ("com,example,hot)/", "-", "com,example,site1,www)/a/1", "h)/m"):
        url = next(u for _, u, _ in rows if url_key(u) == key)
        found = lookup(parts, spark.createDataFrame([(url,), (url,), ("http://none.example.com/",), ("http://zzz.zzz/",)], "url string"))
        assert sorted((r["id"] for r in found.collect()), key=repr) == sorted((None if i is None else str(i) for i in expected[key]), key=repr)
    everything = lookup(parts, spark.createDataFrame([(u,) for _, u, _ in rows], "url string"))
    assert sorted(everything.select(captures.columns).collect(), key=repr) == sorted(captures.collect(), key=repr)


def test_archives_are_plain_gzip_and_scan_equals_fetch(spark, tmp_path):
    rows = some_pages()
    captures, _ = written(spark, tmp_path, rows, 5000)
    assert captures.select("file").distinct().count() > 5
    row = captures.where("id = '901'").first()
    with open(row["file"].removeprefix("file://"), "rb") as f:
        whole = f.read()
    assert gzip.decompress(whole).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    one = gzip.decompress(whole[row["offset"] : row["offset"] + row["length"]])
    assert one.endswith(b"no url\r\n\r\n") and parsed(one).payload == b"no url"
    a, b = (sorted(map(tuple, df.collect()), key=repr) for df in (fetch(captures), scan(captures, verify=True)))
    assert a == b and len(a) == len(rows)


def test_scan_of_plain_records(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\nhe\r\n\r"
    records = [b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 0\r\n\r\n\r\n\r\n"]
    for n in range(3):
        records.append(b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:%d>\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (n, len(http), http))
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    out = scan(spark.createDataFrame([(str(tmp_path / "a.warc"),)], "file string")).collect()
    assert [(r["id"], r["payload"], r["payload_bytes"]) for r in out] == [(f"<urn:uuid:{n}>", b"he\r\n\r", 5) for n in range(3)]


def test_damaged_records_raise():
    good = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    digest = base64.b32encode(hashlib.sha1(b"ab").digest())
    assert parsed(good % digest).payload == b"ab"
    for bad in (good % b"WRONG", (good % digest)[:-6], b"no record", b""):
        with pytest.raises(ValueError):
            parsed(bad)
    assert parsed(good % b"WRONG", verify=False).payload == b"ab"


def test_ranges_that_lie_near_are_read_together(tmp_path, monkeypatch):
    data = bytes(range(256)) * 40
    for n in "ab":
        (tmp_path / n).write_bytes(data)
    wanted = [(str(tmp_path / n), o, 7, (n, o)) for n in "ab" for o in (0, 7, 14, 500, 5000, 10_233, 3)]
    for gap in (0, 100, 1 << 20):
        monkeypatch.setattr(_store, "GAP_BYTES", gap)
        assert list(_store.read_ranges(wanted)) == [((n, o), data[o : o + 7]) for n in "ab" for o in (0, 7, 14, 500, 5000, 10_233, 3)]
    with pytest.raises(ValueError, match="ends inside"):
        list(_store.read_ranges([(str(tmp_path / "a"), 10_239, 7, None)]))


def test_names_of_ids():
    for i in (None, "", "null", "7", "a b>é"):
        assert warc._from_urn(warc._urn(i)) == i
    assert warc._from_urn("<urn:uuid:5>") == "<urn:uuid:5>" and warc._from_urn(None) is None
